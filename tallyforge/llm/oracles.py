"""Corpus queries in DuckDB's SQL, written from their contracts and not from the operators' plans."""

from __future__ import annotations

import string

from . import licenses, quality_rules, secret_scan, url_filter


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lower(x: str) -> str:
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def near_duplicates(size: int, percent: int) -> str:
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array({_lower("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size - 2}), lambda i: list_slice(w, i, i + {size - 1})) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
    ), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)
    ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
    ), r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
    ), c AS (SELECT a, min(b) AS component FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""


def quality() -> str:
    """A repeat of at least k words is where a window of k words comes twice; the longest one is
    the longest run of such windows at one distance."""
    k, size = quality_rules.MIN_REPEAT, 3
    space = "[\\x20\\x09-\\x0D]+"
    return f"""
    WITH w AS (
      SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda x: x <> '') AS w FROM documents
    ), b AS (
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w
    ), li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
    ), dl AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM li WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1
    ), g AS (SELECT doc_id, unnest(range(1, len(w) - {size - 2})) AS i, w FROM w WHERE len(w) >= {size}
    ), g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g
    ), gc AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g2, (SELECT unnest(range(0, {size})) AS o) WHERE n > 1 GROUP BY 1
    ), h AS (SELECT doc_id, unnest(range(1, len(w) - {k - 2})) AS i, w FROM w WHERE len(w) >= {k}
    ), h2 AS (SELECT doc_id, i, hash(list_slice(w, i, i + {k - 1})) AS key FROM h
    ), h3 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM h2
    ), hc AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM h3, (SELECT unnest(range(0, {k})) AS o) WHERE n > 1 GROUP BY 1
    ), hp AS (SELECT x.doc_id, x.i, y.i - x.i AS apart FROM h3 x JOIN h3 y ON x.doc_id = y.doc_id AND x.key = y.key AND x.i < y.i AND x.n > 1
    ), hr AS (SELECT doc_id, apart, i - row_number() OVER (PARTITION BY doc_id, apart ORDER BY i) AS island FROM hp
    ), hl AS (SELECT doc_id, max(n) + {k - 1} AS n FROM (SELECT doc_id, count(*) AS n FROM hr GROUP BY doc_id, apart, island) GROUP BY 1
    ), a AS (
      SELECT b.*, coalesce(dl.n, 0) AS n_dup_lines, coalesce(gc.n, 0) AS n_repeat_words, coalesce(hc.n, 0) AS n_covered_words, CAST(coalesce(hl.n, 0) AS BIGINT) AS longest_repeat
      FROM b LEFT JOIN dl USING (doc_id) LEFT JOIN gc USING (doc_id) LEFT JOIN hc USING (doc_id) LEFT JOIN hl USING (doc_id)
    ), f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
    SELECT *, NOT (base_failed OR n_covered_words > {quality_rules.MAX_COVERED}::DOUBLE * n_words OR longest_repeat > {quality_rules.MAX_LONGEST}::DOUBLE * n_words) AS kept FROM f"""


def urls() -> str:
    rule = "NULL"
    verdict = "NULL"
    for text, said in sorted(url_filter.RULES, key=lambda r: (len(r[0]), r[0])):
        own, start = text.split("/", 1)
        fits = f"(host = '{own}' OR host LIKE '%.{own}') AND starts_with(path, '/{start}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{said}' ELSE {verdict} END"

    u, levels = url_filter, []
    for i in range(1, u.LEVELS + 1):
        here = f"segs[{i}]" if i < u.LEVELS else f"array_to_string(list_transform(segs[{i}:], lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '*' ELSE x END), '/')"
        levels.append(f"""x{i} AS MATERIALIZED (SELECT *, CASE WHEN len(segs) >= {i} THEN {here} END AS seg FROM l{i - 1} WHERE len(segs) >= {i - 1}),
        d{i} AS MATERIALIZED (SELECT host, t, count(DISTINCT seg) AS different, sum(CASE WHEN seg IS NOT NULL THEN pages END) AS whole, sum(bad) AS nb, sum(good) AS ng FROM x{i} GROUP BY 1, 2),
        o{i} AS MATERIALIZED (SELECT host, t, seg, sum(pages) AS own FROM x{i} GROUP BY 1, 2, 3),
        l{i} AS MATERIALIZED (SELECT x.host, path, pages, bad, good, segs, x.t || '/' || CASE WHEN x.seg = '' THEN '' WHEN (different > {u.MANY} AND different * {u.PAGES_EACH} > whole) OR (own < {u.RARE} AND different > 1) OR regexp_full_match(x.seg, '[0-9]+') THEN '*' ELSE x.seg END AS t, x.t AS above,
          CASE WHEN nb + ng > 0 THEN nb ELSE ob END AS ob, CASE WHEN nb + ng > 0 THEN ng ELSE og END AS og
          FROM x{i} x JOIN d{i} d ON d.host = x.host AND d.t = x.t JOIN o{i} o ON o.host = x.host AND o.t = x.t AND o.seg = x.seg)""")
    ended = " UNION ALL ".join(f"SELECT * FROM l{i} WHERE len(segs) {'=' if i < u.LEVELS else '>='} {i}" for i in range(u.LEVELS + 1))
    smooth = lambda bad, n: f"CAST({bad} * 1000 + {u.PRIOR} * overall AS DOUBLE) / CAST(({n} + {u.PRIOR}) * 1000 AS DOUBLE)"
    apart = "CAST(bad * ab_n - ab * n AS DOUBLE)"
    return f"""
    WITH u AS (SELECT page_id, {_lower("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
    ), b AS MATERIALIZED (SELECT *, {rule} AS rule, {verdict} AS said FROM u
    ), l0 AS MATERIALIZED (SELECT host, path, count(*) AS pages, count(*) FILTER (WHERE said = 'block') AS bad, count(*) FILTER (WHERE said = 'allow') AS good, string_split(path, '/')[2:] AS segs, '' AS t, '' AS above, 0::HUGEINT AS ob, 0::HUGEINT AS og FROM b GROUP BY host, path
    ), {", ".join(levels)}, w AS MATERIALIZED ({ended}
    ), al AS (SELECT CAST(1000 * coalesce(sum(bad), 0) AS BIGINT) // greatest(1, CAST(coalesce(sum(bad + good), 0) AS BIGINT)) AS overall FROM l0
    ), br AS (SELECT host, t, above, sum(bad) AS bad, sum(bad + good) AS n, max(ob) AS ob, max(og) AS og FROM w GROUP BY 1, 2, 3
    ), bt AS MATERIALIZED (SELECT *, CASE WHEN n > 0 THEN floor(10 * CAST(bad * 1000 + {u.PRIOR} * overall AS DOUBLE) / CAST((n + {u.PRIOR}) * 1000 AS DOUBLE)) END AS tenth FROM br, al
    ), co AS (SELECT host, above, tenth, sum(bad) AS ab, sum(n) AS ab_n FROM bt WHERE n > 0 GROUP BY 1, 2, 3
    ), tr AS MATERIALIZED (SELECT bt.*, {apart} * {apart} <= 4.0::DOUBLE * n * ab * (ab_n - ab) AS alike FROM bt JOIN co USING (host, above, tenth)
    ), me AS (SELECT host, above, tenth, sum(bad) AS mb, sum(n) AS mn, count(*) AS members FROM tr WHERE alike GROUP BY 1, 2, 3
    ), j AS (SELECT tr.host, t, tr.above, {smooth("mb", "mn")} AS share, mn AS labels, CASE WHEN members > 1 THEN tr.above || '/~' || CAST(CAST(tr.tenth AS BIGINT) AS VARCHAR) ELSE t END AS template FROM tr JOIN me USING (host, above, tenth) WHERE alike
      UNION ALL SELECT host, t, above, {smooth("bad", "n")}, n, t FROM tr WHERE NOT alike
      UNION ALL SELECT host, t, above, {smooth("ob", "(ob + og)")}, ob + og, t FROM bt WHERE n = 0)
    SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.said, CASE WHEN j.labels > 0 AND j.share >= {u.PURITY} THEN 'block' ELSE 'allow' END) AS verdict, left(j.template, {u.SHOWN}) AS template, j.share, CAST(j.labels AS BIGINT) AS labels
    FROM b JOIN w ON w.host = b.host AND w.path = b.path JOIN j ON j.host = w.host AND j.t = w.t AND j.above = w.above"""


def secret_spans() -> str:
    kinds = [("assign", secret_scan.ASSIGN, 2, 6, 0), ("access", secret_scan.ACCESS, 0, 0, 20), ("hex", secret_scan.HEX, 0, 0, 24), *((k, r, 0, 0, 0) for k, r, _ in secret_scan.MORE)]
    parts = []
    for i, (kind, regex, group, part, whole) in enumerate(kinds):
        r = _text(regex)
        test = f"length(part) >= {part} AND length(value) >= {whole}"
        parts.append(f"""SELECT doc_id, source, lang, {i} AS kind, '{kind}' AS name, part, pos, pos + length(value) AS stop FROM (
          SELECT *, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(value)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (
            SELECT doc_id, source, lang, unnest(range(len(v))) AS i, unnest(v) AS value, unnest(p) AS part, unnest(list_slice(g, 1, len(v))) AS gap FROM (
              SELECT doc_id, source, lang, regexp_extract_all(t, {r}) AS v, regexp_extract_all(t, {r}, {group}) AS p, string_split_regex(t, {r}) AS g FROM d WHERE regexp_matches(t, {r})))) WHERE {test}""")
    word = " OR ".join(f"contains(lower(left(part, {secret_scan.LOOK})), {_text(w)})" for w in secret_scan.PLACEHOLDERS)
    return f"""
    WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}
    ), s AS (SELECT *, len(list_distinct(string_split(left(part, {secret_scan.LOOK}), ''))) >= {secret_scan.MIN_CHARACTERS} AND NOT ({word}) AS looks FROM f
      WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.kind < 3 AND b.doc_id = f.doc_id AND b.pos <= f.pos AND b.stop >= f.stop)
    ), o AS (SELECT part FROM s GROUP BY 1 HAVING count(DISTINCT coalesce(source, '')) >= {secret_scan.MIN_OWNERS} OR count(DISTINCT (coalesce(source, ''), concat_ws('/', source, lang))) >= {secret_scan.MIN_REPOSITORIES}
    ), k AS (SELECT *, name || ':' || CAST(pos AS BIGINT) || ':' || CAST(stop AS BIGINT) AS shown, looks AND part NOT IN (SELECT part FROM o) AS live FROM s)
    SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
      sha256(coalesce(string_agg(shown, ',' ORDER BY pos, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
      coalesce(string_agg(shown, ',' ORDER BY pos, kind) FILTER (WHERE kind < 3 OR live), '') AS spans, coalesce(string_agg(shown, ',' ORDER BY pos, kind) FILTER (WHERE live), '') AS live
    FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""


def license_labels() -> str:
    rows = ", ".join(f"({_text(k)}, {_text(f' ({p}) ')}, {_text(label)}, {rank}, {c}::DOUBLE)" for k, p, label, rank, c in licenses.rules())
    keywords = ", ".join(f"({_text(k)}, {before}, {after})" for k, (before, after) in sorted(licenses.reach(licenses.rules()).items()))
    return f"""
    WITH r(keyword, pattern, label, priority, confidence) AS (VALUES {rows}
    ), kw(word, before, behind) AS (VALUES {keywords}
    ), w AS (SELECT doc_id, list_filter(regexp_split_to_array({_lower("coalesce(text, '')")}, '{licenses.NOT_WORD}'), lambda x: x <> '') AS w FROM documents
    ), h AS (SELECT * FROM (SELECT doc_id, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) JOIN kw USING (word)
    ), win AS (SELECT doc_id, word, i - 1 AS pos, ' ' || array_to_string(list_slice(w, greatest(1, i - before), i - 1), ' ') || ' ~' || word || ' ' || array_to_string(list_slice(w, i + 1, i + behind), ' ') || ' ' AS win FROM h
    ), m AS (SELECT doc_id, pos, label, priority, confidence, regexp_extract(win, pattern, 1) AS found FROM win JOIN r ON keyword = word
    ), x AS (SELECT doc_id, label, priority, confidence, pos - (length(split_part(found, '~', 1)) - length(replace(split_part(found, '~', 1), ' ', ''))) AS start, 1 + length(found) - length(replace(found, ' ', '')) AS size FROM m WHERE found <> ''
    ), y AS (SELECT *, {", ".join(f"max(start + size) FILTER (WHERE priority <= {p}) OVER (PARTITION BY doc_id ORDER BY start, -size, priority, label, confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e{p}" for p in range(4))} FROM x
    ), k AS (SELECT * FROM y WHERE priority = 0 OR NOT coalesce(CASE priority WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END >= start + size, false))
    SELECT w.doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(k.doc_id) FILTER (WHERE priority = 0) AS n_base, min(start) FILTER (WHERE priority = 0) AS first_word, max(start) FILTER (WHERE priority = 0) AS last_word,
      coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE priority = 0)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels, coalesce(max(confidence), 0.0::DOUBLE) AS score
    FROM w LEFT JOIN k ON k.doc_id = w.doc_id GROUP BY w.doc_id"""
