"""Secret scans with corpus-wide ownership frequency, in Spark's own expressions only.

Each text gives spans of the base kinds (assign, access, hex), which always stay, and candidates of
further kinds of credentials; a candidate within a base span is none. All values, the base ones'
too, are hashed, and for each hash the distinct owners and repositories that hold it are counted
over the whole corpus. A value that several owners share, or that lies in many repositories, is a
copied example; so is one that looks like a placeholder (few different characters, or a word such
as ``example``). What few hold and what looks like a credential is *live*: live candidates are added
to the spans, and ``live`` names all live spans.

One pass over the texts leaves a table of spans without texts in the shared folder; counts, verdicts
and results come from that. Counts are kept per (hash, owner, repository) before they meet by
hash, and hashes that a large part of all spans hold are broadcast to them (see ``skew``), so no
task holds all of a widely copied value.

A private key's span is its whole block, and its value the key in it, so that different keys under
one header are different values.

Defined results: null and empty texts have no spans; null owners count as one owner; repeated
rows give a row each; in a very long text every span counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import contains_any, let, match_spans
from .shared import save
from .skew import join_keys

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind, pattern, texts of which one must be there for the pattern to match
MORE = [
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{30,}", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]),
    ("chat_token", r"xox[abeprs]-[A-Za-z0-9-]{10,}", ["xox"]),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ["eyJ"]),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ["PRIVATE KEY-----"]),
    ("payment_key", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", ["k_live_", "k_test_"]),
    ("map_key", r"AIza[A-Za-z0-9_-]{35}", ["AIza"]),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}=*", ["earer "]),
    ("url_password", r"[a-z][a-z0-9+.-]{0,20}://[^\x00-\x20:/@]+:[^\x00-\x20:/@]+@", ["://"]),
    ("mail_key", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", ["SG."]),
    ("package_token", r"(?:npm_|pypi-|glpat-|dop_v1_)[A-Za-z0-9_-]{20,}", ["npm_", "pypi-", "glpat-", "dop_v1_"]),
    ("hook_url", r"https://hooks\.[a-z0-9.-]+/[A-Za-z0-9/_-]{20,}", ["https://hooks."]),
    ("upper_hex", r"[0-9A-F]{32,}", []),
]
_MARK = r"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----"
#: what stands between the lines of a key: white space, its escapes, quotes, marks of comments
_SEP = r"""(?:\\++[nrt]|[\s"',>|#*])"""
#: a key's block runs to its END line, with no other mark between; without one, over its headers and
#: lines of base64, of which the last may be short. All loops are possessive, which Java runs without
#: recursion.
_BLOCK = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_SEP}*+[A-Z][A-Za-z-]*+: [^\r\n\\]*+)*+(?:{_SEP}*+[A-Za-z0-9+/=]{{16,}}+)*+"
    rf"""(?:{_SEP}++[A-Za-z0-9+/]{{1,15}}+={{1,2}}+|(?:\r?\n|\\++n)[\x20\t"']*+[A-Za-z0-9+/]{{1,15}}+(?![\x20\t]*+[^\s\\"']))?+)"""
)
#: patterns of whole secrets, where those above, which are the SQL's too, stop short or recurse
WHOLE = {"private_key": _BLOCK, "url_password": r"[a-z][a-z0-9+.-]{0,20}://[^\x00-\x20:/@]++:[^\x00-\x20:/@]++@"}
KINDS = ["assign", "access", "hex", *(k for k, _, _ in MORE)]
#: a value is copied from so many owners on, or from so many repositories of however few owners
MIN_OWNERS, MIN_REPOSITORIES = 3, 10
#: values with fewer different characters, or with one of these words, are placeholders
MIN_CHARACTERS = 6
PLACEHOLDERS = ["example", "changeme", "placeholder", "dummy", "sample", "xxxx", "redacted", "your_", "your-", "123456"]
#: characters of a value that the SQL judges its look by; ``looks_live`` judges by all of them
LOOK = 1024
_SPAN = "array<struct<start:int,kind:int,end:int,hash:bigint,looks:boolean>>"


def _key_body(block: Column) -> Column:
    """The key in a block, however its lines are broken; a block without one is its own value."""
    body = F.regexp_replace(block, rf"{_MARK}|\\+[nrt]|[^A-Za-z0-9+/=]", "")
    return F.when(body == "", block).otherwise(body)


def looks_live(value: Column) -> Column:
    """By the whole of a value, however long. Something is left of one with enough different characters
    when that which it then begins with is taken out of it everywhere, once less than their number."""
    rest = F.aggregate(F.sequence(F.lit(2), F.lit(MIN_CHARACTERS)), value, lambda left, _: F.replace(left, F.substring(left, 1, 1), F.lit("")))
    return (rest != "") & ~let(F.lower(value), lambda lower: contains_any(lower, PLACEHOLDERS))


def _spans(text: Column, kind: int, regex: str, gate: Column, group: int, test, value=lambda part: part) -> Column:
    found = F.filter(match_spans(text, regex, group), test)
    shaped = F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(kind).alias("kind"), m.end.alias("end"), F.xxhash64(value(m.part)).alias("hash"), looks_live(value(m.part)).alias("looks")))
    return F.coalesce(F.when(gate, shaped), F.array()).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind. A match that is too short is dropped as a match: what
    it covers isn't searched again."""
    assign, access, hexes = _gates(text)
    return F.array_sort(F.concat(
        _spans(text, 0, ASSIGN, assign, 2, lambda m: F.length(m.part) >= 6),
        _spans(text, 1, ACCESS, access, 0, lambda m: F.length(m.value) >= 20),
        # runs of hex digits below the least length can be no part of a longer run
        _spans(text, 2, r"[0-9a-f]{24,}", hexes, 0, lambda m: F.lit(True)),
    ))


def more_spans(text: Column, base: Column) -> Column:
    """Candidates of the further kinds, but those within a span of ``base``."""
    found = F.concat(*(
        _spans(text, i + 3, WHOLE.get(kind, regex), _gate(text, regex, parts), 0, lambda m: F.lit(True), *([_key_body] if kind == "private_key" else []))
        for i, (kind, regex, parts) in enumerate(MORE)
    ))
    return F.array_sort(F.filter(found, lambda m: ~F.exists(base, lambda b: (b.start <= m.start) & (b.end >= m.end))))


def _gate(text: Column, regex: str, parts: list[str]) -> Column:
    return contains_any(text, parts) if parts else F.rlike(text, F.lit(regex))


def _gates(text: Column) -> list[Column]:
    return [contains_any(text, [":", "="]) & F.rlike(text, F.lit(ASSIGN)), F.contains(text, F.lit("AKIA")), F.rlike(text, F.lit(r"[0-9a-f]{24}"))]


def may_hold(text: Column) -> Column:
    """False only for texts without any span."""
    out = F.lit(False)
    for gate in [*_gates(text), *(_gate(text, regex, parts) for _, regex, parts in MORE)]:
        out = out | gate
    return F.coalesce(out, F.lit(False))


def _scan(docs: DataFrame, owner: str, repository: Column) -> DataFrame:
    def both(text: Column) -> Column:
        return let(base_spans(text), lambda base: F.struct(base.alias("base"), more_spans(text, base).alias("more"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")))

    found = let(F.coalesce(docs["text"], F.lit("")), lambda t: F.when(may_hold(t), both(t)).otherwise(
        F.struct(F.array().cast(_SPAN).alias("base"), F.array().cast(_SPAN).alias("more"), F.xxhash64(t).alias("t1"), F.xxhash64(t, F.lit(1)).alias("t2"))
    ))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[owner].cast("string").alias("owner"), repository.alias("repository"), found.alias("found"))
    return rows.select("doc_id", "owner", "repository", "found.*", F.monotonically_increasing_id().alias("row"))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repositories (how many distinct ones hold each value) and hits of (hash, owner,
    repository)."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    each = spans.select("hash", text("owner"), text("repository")).groupBy("hash", "owner", "repository").agg(F.count("*").alias("hits"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.sum("hits").alias("hits"))


def secrets(docs: DataFrame, owner: str = "source", repository: Column | None = None, min_owners: int = MIN_OWNERS, min_repositories: int = MIN_REPOSITORIES) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), base spans, added spans and live spans, base or added
    (start, kind, end, hash, looks), of each row of ``docs`` (doc_id, text and the owner's column).
    A repository is by default the owner's part in one language."""
    if repository is None:
        repository = F.concat_ws("/", docs[owner], docs["lang"])
    scan = save(_scan(docs, owner, repository), "spans")
    holding, none = F.size("base") + F.size("more") > 0, F.array().cast(_SPAN)
    each = scan.where(holding).select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span")).select("*", "span.hash")
    counts = save(ownership(each).select("hash", "hits", ((F.col("owners") >= min_owners) | (F.col("repositories") >= min_repositories)).alias("copied")), "owned")
    judged = join_keys(each.select("row", "span", "hash"), counts, ["hash"], "hits").where("span.looks and not copied")
    live = judged.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_set("span")).alias("live"))
    with_spans = scan.where(holding).join(live, F.col("row") == F.col("of"), "left").withColumn("live", F.coalesce("live", none))
    added = F.filter("live", lambda s: s.kind > 2)
    columns = ["doc_id", "t1", "t2", "base"]
    return with_spans.select(*columns, added.alias("added"), "live").unionByName(scan.where(~holding).select(*columns, none.alias("added"), none.alias("live")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and written spans of ``secrets``' rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "added"))).alias("spans"), _written(F.col("live")).alias("live"),
    )


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every base and every live span of its texts replaced by ``mask``; overlapping
    spans become one. Only texts that may hold spans are dealt by id and text for it."""
    found = secrets(docs).withColumn("all", F.array_sort(F.concat("base", "added"))).where(F.size("all") > 0)
    spans = found.groupBy("doc_id", "t1", "t2").agg(F.first("all").alias("all"))
    names = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].cast("long").alias("d"), F.xxhash64("text").alias("u1"), F.xxhash64("text", F.lit(1)).alias("u2"))
    may = may_hold(F.col("row.text"))
    joined = row.where(may).join(spans, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2")), "left")
    merged = F.aggregate(
        "all",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc.out, F.when(s.start >= acc["at"], F.concat(F.substring("row.text", acc["at"] + 1, s.start - acc["at"]), F.lit(mask))).otherwise("")).alias("out"),
            F.greatest(acc["at"], s.end).alias("at"),
        ),
        lambda acc: F.concat(acc.out, F.substring(F.col("row.text"), acc["at"] + 1, F.length("row.text"))),
    )
    text = F.when(F.col("all").isNull(), F.col("row.text")).otherwise(merged)
    out = joined.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names])
    return out.unionByName(row.where(~may).select("row.*"))
