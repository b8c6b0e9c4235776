"""URL verdicts from a tree of path templates per host, in Spark's own expressions only.

Fixed rules (host and path) come first. Their verdicts are also the labels from which the rest
is judged:

1. A path is cut into segments, to its whole depth: from the host down, one level after the other, up
   to ``LEVELS``; the segments of the last level and all below it count as one, in which each
   segment of digits is a wildcard.
2. A node's segments that look like a variable become one wildcard: all of them if the node has many
   different ones for its pages, else those that are rare or all digits.
3. Labelled branches under one node whose smoothed shares of blocks lie in the same tenth are
   candidates to be merged; each that is within two standard errors of what they have in common
   joins the merged branch, the others stay alone.
4. A branch without labels is judged by its nearest ancestor that has some. Where a host has none
   at all, nothing is rejected.
5. A template, or merged branch, is rejected if its share of blocks, smoothed with ``PRIOR`` pages
   of the whole table's share, is at least ``PURITY``: if more of it is blocked than not.

Nodes, segments and paths are keyed by pairs of 64-bit hashes, so what is shuffled is of fixed width.
Counts are aggregated before they meet by node; joins back go through ``skew``, so a host, node or
url with a third of all pages stays spread.

Defined results: a url that is null or without ``://`` has an empty host and path, no rule, and
the verdict of the empty host's own branch; a path of any length and depth has a template, of which
``template`` shows up to ``SHOWN`` characters. Rows are judged one by one; repeated rows count as
pages each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import lower_ascii
from .shared import save
from .skew import join_keys

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: A node's segments are a variable if it has over MANY different ones and over one for every PAGES_EACH pages.
MANY, PAGES_EACH, RARE = 20, 5, 3
LEVELS = 6
PRIOR, PURITY = 10, 0.5
SHOWN = 256


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, start = text.split("/", 1)
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{start}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _key(name: str, *columns) -> list[Column]:
    """Two 64-bit hashes of the columns, ``name``1 and ``name``2."""
    return [F.xxhash64(*columns).alias(f"{name}1"), F.xxhash64(F.lit(1), *columns).alias(f"{name}2")]


NODE, SEGMENT, PARENT, PAGE = (["n1", "n2"], ["s1", "s2"], ["p1", "p2"], ["u1", "u2"])
_DIGITS = "^[0-9]+$"


def _deeper(tree: DataFrame, level: int) -> DataFrame:
    """The paths of ``tree`` that go on below their node ``level`` - 1, with their node at ``level``."""
    here = F.get("segments", F.lit(level - 1))
    if level == LEVELS:
        rest = F.transform(F.slice("segments", level, F.size("segments")), lambda s: F.when(F.rlike(s, F.lit(_DIGITS)), F.lit("*")).otherwise(s))
        here = F.when(F.size("segments") >= level, F.array_join(rest, "/"))
    tree = tree.withColumn("segment", here)
    each = tree.select("*", *_key("s", "segment")).groupBy(*NODE, *SEGMENT).agg(
        F.first(F.col("segment").isNotNull()).alias("there"), F.sum("pages").alias("own"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("rows")
    )
    each = save(each, "segments")
    node = each.groupBy(*NODE).agg(
        F.count_if("there").alias("different"), F.sum(F.when(F.col("there"), F.col("own"))).alias("whole"), F.sum("bad").alias("node_bad"), F.sum("good").alias("node_good")
    ).where("different > 0")
    wild = ((F.col("different") > MANY) & (F.col("different") * PAGES_EACH > F.col("whole"))) | ((F.col("own") < RARE) & (F.col("different") > 1))
    known = join_keys(each.where("there"), save(node, "nodes"), NODE, "different").select(*NODE, *SEGMENT, "rows", wild.alias("wild"), "node_bad", "node_good")
    live = tree.where(F.col("segment").isNotNull()).select("*", *_key("s", "segment"))
    met = join_keys(live, save(known, "known"), [*NODE, *SEGMENT], "rows")
    shown = F.when(F.col("segment") == "", "").when(F.col("wild") | F.rlike("segment", F.lit(_DIGITS)), "*").otherwise(F.col("segment"))
    labelled = F.col("node_bad") + F.col("node_good") > 0
    over = lambda c: F.when(labelled, F.col(f"node_{c}")).otherwise(F.col(f"over_{c}")).alias(f"over_{c}")
    below = met.select(
        "host", "path", "pages", "bad", "good", "segments", F.concat("template", F.lit("/"), shown).alias("template"), F.col("template").alias("above"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), over("bad"), over("good")
    )
    return save(below.select("*", *_key("n", "host", "template")), "level")


def _share(bad: Column, n: Column, prior: int, overall: int) -> tuple[Column, Column]:
    """Numerator and denominator of a smoothed share, both whole, so that every engine has the same."""
    return bad * 1000 + prior * overall, (n + prior) * 1000


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, purity: float = PURITY, prior: int = PRIOR) -> DataFrame:
    """page_id, host, path, rule, verdict, template, share and labels (how many pages with a label it
    comes from) of each row of ``pages`` (page_id, url)."""
    url = F.coalesce(pages["url"], F.lit(""))
    parts = pages.select(pages["page_id"].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = parts.select("*", rule.alias("rule"), verdict.alias("said"), *_key("u", "host", "path"))

    # the tree is built on distinct paths with their counts of pages and labels
    counted = base.groupBy("host", "path").agg(F.count("*").alias("pages"), F.count_if(F.col("said") == "block").alias("bad"), F.count_if(F.col("said") == "allow").alias("good"))
    segments = F.slice(F.split("path", "/"), 2, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    none = F.lit(0).cast("long")
    tree = counted.select("*", segments.alias("segments"), F.lit("").alias("template"), F.lit("").alias("above"), *_key("p", "host", F.lit("")), none.alias("over_bad"), none.alias("over_good"))
    tree = save(tree.select("*", *_key("n", "host", "template")), "paths")
    top = tree.agg(F.max(F.size("segments")).alias("depth"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    # the share of all labelled pages, in whole thousandths
    overall = 1000 * (top.bad or 0) // max(1, (top.bad or 0) + (top.good or 0))
    whole = tree.where(F.size("segments") == 0)
    for level in range(1, min(top.depth or 0, LEVELS) + 1):
        tree = _deeper(tree, level)
        whole = whole.unionByName(tree if level == LEVELS else tree.where(F.size("segments") == level))
        tree = tree.where(F.size("segments") > level)

    branch = whole.groupBy(*NODE, *PARENT).agg(*[F.sum(c).alias(c) for c in ("bad", "good")], F.max("over_bad").alias("over_bad"), F.max("over_good").alias("over_good"), F.count("*").alias("rows"))
    bad, n = F.col("bad"), F.col("bad") + F.col("good")
    above, below = _share(bad, n, prior, overall)
    branch = save(branch.withColumn("tenth", F.when(n > 0, F.floor(10 * above / below))), "branches")
    tenth = [*PARENT, "tenth"]
    common = save(branch.where(n > 0).groupBy(*tenth).agg(F.sum("bad").alias("all_bad"), F.sum(n).alias("all"), F.count("*").alias("branches")), "common")
    # |bad/n - all_bad/all| within two standard errors
    apart = (bad * F.col("all") - F.col("all_bad") * n).cast("double")
    alike = apart * apart <= F.lit(4.0) * n * F.col("all_bad") * (F.col("all") - F.col("all_bad"))
    tried = save(join_keys(branch.where(n > 0), common, tenth, "branches").withColumn("alike", alike), "tried")
    merged = tried.where("alike").groupBy(*tenth).agg(F.sum("bad").alias("merged_bad"), F.sum(n).alias("merged"), F.count("*").alias("members"))
    joined = join_keys(tried.where("alike").select(*NODE, *tenth, "rows"), save(merged, "merged"), tenth, "members")
    pooled = _share(F.col("merged_bad"), F.col("merged"), prior, overall)
    alone = _share(bad, n, prior, overall)
    inherited = _share(F.col("over_bad"), F.col("over_bad") + F.col("over_good"), prior, overall)
    own = lambda share, labels, several: [*NODE, *PARENT, "rows", (share[0] / share[1]).alias("share"), labels.alias("labels"), several.alias("several")]
    single = F.lit(None).cast("long")
    judged = joined.select(*own(pooled, F.col("merged"), F.when(F.col("members") > 1, F.col("tenth"))))
    judged = judged.unionByName(tried.where("not alike").select(*own(alone, n, single))).unionByName(branch.where(n == 0).select(*own(inherited, F.col("over_bad") + F.col("over_good"), single)))

    of_path = join_keys(whole, save(judged, "judged"), [*NODE, *PARENT], "rows")
    named = F.when(F.col("several").isNotNull(), F.concat("above", F.lit("/~"), F.col("several").cast("string"))).otherwise(F.col("template"))
    of_path = save(of_path.select(*_key("u", "host", "path"), "pages", F.left(named, F.lit(SHOWN)).alias("template"), "share", "labels"), "verdicts")
    method = F.when((F.col("labels") > 0) & (F.col("share") >= purity), "block").otherwise("allow")
    return join_keys(base, of_path, PAGE, "pages").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", "share", "labels")
