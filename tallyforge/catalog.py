"""The engine's queries on the driver's tables, and the same in plain SQL.

An event is a row of ``orders`` with its lineitems as objects; its run is the month and its
lumiblock the day of the order. Floating sums are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import lorentz as L
from .functions import objects as O
from .functions.axis import Axis, VariableAxis
from .operators import blocks as B
from .operators import inspect, reshape, results, reweight, run_lists, variants
from .operators.aggregates import Aggregate
from .operators.fill import Store
from .plans.processor import Processor, analyse
from .sources import streams, tables, texts
from .sources.scratch import new_path
from .streaming.fills import running_cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def bin_sql(x: str, a: Axis) -> str:
    return f"CAST(CASE WHEN {x} < {d(a.low)} THEN 0 WHEN {x} > {d(a.high)} THEN {a.bins + 1} ELSE 1 + floor(({x} - {d(a.low)}) / {d(a.width)}) END AS INTEGER)"


def edges_sql(x: str, a: VariableAxis) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {x} >= {d(e)} THEN 1 ELSE 0 END" for e in a.edges) + " AS INTEGER)"


def shown(cells: DataFrame, *columns: str, path: bool = False) -> DataFrame:
    """Bins and rounded sums of cells."""
    return cells.select(*(["path"] * path), *columns, F.round("sumw", 4).alias("sumw"), F.round("sumw2", 4).alias("sumw2"), "entries")


SUMS = "round(sum(w), 4) AS sumw, round(sum(w * w), 4) AS sumw2, count(*) AS entries"
PRICE, QUANTITY, PART_PRICE = Axis(100, 0, 100000), Axis(10, 0, 50), Axis(20, 900, 2000)
DISCOUNT = VariableAxis([0, 0.01, 0.02, 0.05, 0.08, 0.1])
LOG = VariableAxis.log_bins(12, 100, 100000)

W = "1.0::DOUBLE - l_discount"


# Columns need a session, so nothing below makes one before a query runs.


def weight():
    return F.lit(1.0) - F.col("l_discount")


def _h1(spark, sf_dir, axis, value="l_extendedprice", weighted=True) -> DataFrame:
    store = Store("h/", weight() if weighted else 1.0)
    store.h1("x", axis, F.col(value))
    return store.run(read(spark, sf_dir, "lineitem"))


@query(f"SELECT {bin_sql('l_extendedprice', PRICE)} AS bx, {SUMS} FROM (SELECT *, {W} AS w FROM lineitem) GROUP BY 1")
def h1_weighted(spark, sf_dir):
    return shown(_h1(spark, sf_dir, PRICE), "bx")


@query(f"SELECT {edges_sql('l_discount', DISCOUNT)} AS bx, {SUMS} FROM (SELECT *, 1.0::DOUBLE AS w FROM lineitem) GROUP BY 1")
def h1_variable(spark, sf_dir):
    return shown(_h1(spark, sf_dir, DISCOUNT, "l_discount", False), "bx")


@query(f"SELECT {edges_sql('l_extendedprice', LOG)} AS bx, {SUMS} FROM (SELECT *, {W} AS w FROM lineitem) GROUP BY 1")
def h1_log_bins(spark, sf_dir):
    return shown(_h1(spark, sf_dir, LOG), "bx")


@query(f"SELECT {bin_sql('l_extendedprice', PRICE)} AS bx, {bin_sql('l_quantity', QUANTITY)} AS by, {SUMS} FROM (SELECT *, {W} AS w FROM lineitem) GROUP BY 1, 2")
def h2_fill(spark, sf_dir):
    cells = Store("h/", weight()).h2("xy", PRICE, F.col("l_extendedprice"), QUANTITY, F.col("l_quantity")).run(read(spark, sf_dir, "lineitem"))
    return shown(cells, "bx", "by")


TAX = Axis(4, 0, 0.08)


@query(f"SELECT {bin_sql('l_extendedprice', Axis(20, 0, 100000))} AS bx, {bin_sql('l_quantity', QUANTITY)} AS by, {bin_sql('l_tax', TAX)} AS bz, {SUMS} FROM (SELECT *, {W} AS w FROM lineitem) GROUP BY 1, 2, 3")
def h3_fill(spark, sf_dir):
    cells = Store("h/", weight()).h3("xyz", Axis(20, 0, 100000), F.col("l_extendedprice"), QUANTITY, F.col("l_quantity"), TAX, F.col("l_tax")).run(read(spark, sf_dir, "lineitem"))
    return shown(cells, "bx", "by", "bz")


HALF = Axis(50, 10000, 60000)
_CELLS = f"c AS (SELECT {bin_sql('l_extendedprice', HALF)} AS bx, sum(w) AS sumw, sum(w * w) AS sumw2, count(*) AS entries FROM (SELECT *, {W} AS w FROM lineitem) GROUP BY 1)"


@query(f"WITH {_CELLS} SELECT 'h/x' AS path, round(sum(CASE WHEN bx BETWEEN 1 AND 50 THEN sumw ELSE 0 END), 4) AS integral, CAST(sum(entries) AS BIGINT) AS entries FROM c")
def h1_integral(spark, sf_dir):
    out = results.integral(_h1(spark, sf_dir, HALF), {"h/x": [50]})
    return out.select("path", F.round("integral", 4).alias("integral"), "entries")


@query(f"WITH {_CELLS} SELECT bx, round(sumw * 0.37::DOUBLE, 4) AS sumw, round(sumw2 * 0.37::DOUBLE * 0.37::DOUBLE, 4) AS sumw2, CAST(floor(entries * 0.37::DOUBLE) AS BIGINT) AS entries FROM c")
def h1_scale(spark, sf_dir):
    return shown(results.scale(_h1(spark, sf_dir, HALF), 0.37), "bx")


@query(f"SELECT {bin_sql('l_extendedprice', HALF)} AS bx, round(sum(w), 4) AS sumw, round(sum(w * w), 4) AS sumw2, count(*) AS entries FROM (SELECT *, {W} AS w FROM lineitem) GROUP BY 1")
def h1_merge(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    parts = [Store("h/", weight()).h1("x", HALF, F.col("l_extendedprice")).run(items.where(F.col("l_orderkey") % 3 == i)) for i in range(3)]
    return shown(results.merge(*parts), "bx")


@query(f"WITH {_CELLS} SELECT CAST(CASE WHEN bx = 0 THEN 0 WHEN bx > 50 THEN 11 ELSE floor((bx - 1) / 5) + 1 END AS INTEGER) AS bx, round(sum(sumw), 4) AS sumw, round(sum(sumw2), 4) AS sumw2, CAST(sum(entries) AS BIGINT) AS entries FROM c GROUP BY 1")
def h1_rebin(spark, sf_dir):
    return shown(results.rebin(_h1(spark, sf_dir, HALF), 5, 50), "bx")


@query(f"WITH {_CELLS} SELECT CAST(greatest(1, least(50, bx)) AS INTEGER) AS bx, round(sum(sumw), 4) AS sumw, round(sum(sumw2), 4) AS sumw2, CAST(sum(entries) AS BIGINT) AS entries FROM c GROUP BY 1")
def h1_fold_overflow(spark, sf_dir):
    return shown(results.fold_overflow(_h1(spark, sf_dir, HALF), 50), "bx")


@query(f"""WITH {_CELLS}, s AS (SELECT CAST(unnest(range(0, 52)) AS INTEGER) AS i), t AS (SELECT i, coalesce(sumw, 0) AS v FROM s LEFT JOIN c ON bx = i)
SELECT 'h/x' AS path, CAST(count(*) AS BIGINT) AS cells, round(sum(v * i), 3) AS moment, (SELECT CAST(sum(entries) AS BIGINT) FROM c) AS entries FROM t""")
def h1_dense(spark, sf_dir):
    out = results.dense(_h1(spark, sf_dir, HALF), 50)
    moment = F.aggregate(F.transform("data", lambda v, i: v * i), F.lit(0.0), lambda a, b: a + b)
    return out.select("path", F.size("data").cast("long").alias("cells"), F.round(moment, 3).alias("moment"), "entries")


# counters

CUTS = ["all", "returned", "large", "discounted"]


def _tests():
    return {"all": None, "returned": F.col("l_returnflag") == "R", "large": (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25), "discounted": (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25) & (F.col("l_discount") > 0.05)}


_SQL_TESTS = {"all": "true", "returned": "l_returnflag = 'R'", "large": "l_returnflag = 'R' AND l_quantity > 25", "discounted": "l_returnflag = 'R' AND l_quantity > 25 AND l_discount > 0.05::DOUBLE"}


def _flow(spark, sf_dir) -> DataFrame:
    store = Store("", weight())
    for name, test in _tests().items():
        store.passed("cuts", name, test)
    return store.run(read(spark, sf_dir, "lineitem"))


_FLOW = " UNION ALL ".join(f"SELECT '{n}' AS cut, {i} AS ordinal, sum({W}) AS sumw, sum(({W}) * ({W})) AS sumw2, count(*) AS entries FROM lineitem WHERE {t}" for i, (n, t) in enumerate(_SQL_TESTS.items()))


@query(f"SELECT cut, CAST(ordinal AS INTEGER) AS ordinal, round(sumw, 4) AS sumw, round(sumw2, 4) AS sumw2, entries FROM ({_FLOW})")
def cutflow_basic(spark, sf_dir):
    return shown(results.cut_flow(_flow(spark, sf_dir)), "cut", "ordinal")


@query(f"""WITH f AS ({_FLOW}), o AS (SELECT * FROM (VALUES ('never', 0), ('all', 1), ('discounted', 2)) t(cut, ordinal))
SELECT o.cut, CAST(o.ordinal AS INTEGER) AS ordinal, round(coalesce(sumw, 0), 4) AS sumw, round(coalesce(sumw2, 0), 4) AS sumw2, coalesce(entries, 0) AS entries FROM o LEFT JOIN f ON f.cut = o.cut""")
def cutflow_ordered(spark, sf_dir):
    return shown(results.ordered_cut_flow(_flow(spark, sf_dir), "cuts", ["never", "all", "discounted"]), "cut", "ordinal")


@query(f"SELECT cut, round(100 * sumw / lag(sumw) OVER (ORDER BY ordinal), 4) AS efficiency FROM ({_FLOW})")
def cutflow_efficiency(spark, sf_dir):
    return results.efficiency(results.cut_flow(_flow(spark, sf_dir))).select("cut", F.round("efficiency", 4).alias("efficiency"))


# named stores

MANY = [("price", PRICE, "l_extendedprice"), ("quantity", QUANTITY, "l_quantity"), ("tax", TAX, "l_tax"), ("discount", DISCOUNT, "l_discount"), ("log", LOG, "l_extendedprice")]


def _groups():
    return {"": None, "returned/": F.col("l_returnflag") == "R", "open/": F.col("l_linestatus") == "O"}


_SQL_GROUPS = {"": "true", "returned/": "l_returnflag = 'R'", "open/": "l_linestatus = 'O'"}


def _whole_orders(spark, sf_dir) -> DataFrame:
    """Orders with their items, and of these what the fills need."""
    item = F.struct("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))


def _many(events: DataFrame, plan: str) -> DataFrame:
    root = Store("all/", weight())
    for group, test in _groups().items():
        for name, axis, value in MANY:
            root(group).h1(name, axis, F.col(value), where=test)
    return root.run(events, plan)


_MANY = " UNION ALL ".join(
    f"SELECT 'all/{g}{n}' AS path, {(edges_sql if isinstance(a, VariableAxis) else bin_sql)(v, a)} AS bx, {SUMS} FROM (SELECT *, {W} AS w FROM lineitem WHERE {t}) GROUP BY 1, 2" for g, t in _SQL_GROUPS.items() for n, a, v in MANY
)


@query(_MANY)
def store_many_histograms(spark, sf_dir):
    return shown(_many(read(spark, sf_dir, "lineitem"), "once"), "bx", path=True)


@query(_MANY)
def store_many_exploded(spark, sf_dir):
    """The same of an input that is costly to make: items that come out of their orders' arrays."""
    items = _whole_orders(spark, sf_dir).select(F.explode("items").alias("i")).select("i.*")
    return shown(_many(items, "once"), "bx", path=True)


@query(_MANY)
def store_many_union(spark, sf_dir):
    return shown(_many(read(spark, sf_dir, "lineitem"), "union"), "bx", path=True)


@query("SELECT * FROM (VALUES " + ", ".join(f"('all/{g}{n}', 'H1')" for g in _SQL_GROUPS for n, *_ in MANY) + ") t(path, kind)")
def store_paths(spark, sf_dir):
    return results.paths(_many(read(spark, sf_dir, "lineitem"), "once"))


@query(f"SELECT concat('flag/', l_returnflag, '/x') AS path, {bin_sql('l_extendedprice', PRICE)} AS bx, {SUMS} FROM (SELECT *, ({W}) * 2.0::DOUBLE AS w FROM lineitem) GROUP BY 1, 2")
def store_dynamic_path(spark, sf_dir):
    store = Store("flag/", weight())(F.col("l_returnflag"), "/").mul_weight(2.0)
    return shown(store.h1("x", PRICE, F.col("l_extendedprice")).run(read(spark, sf_dir, "lineitem")), "bx", path=True)


# variants

ORDER_PRICE = Axis(50, 0, 500000)
NARROW = Axis(20, 100000, 300000)


class _Analysis(Processor):
    """Order prices, by channel and with shifted prices."""

    def channels(self):
        return {"urgent": F.col("o_orderpriority") == "1-URGENT", "finished": F.col("o_orderstatus") == "F"}

    def systematics(self):
        return {"up": {"o_totalprice": F.col("o_totalprice") * 1.1}, "down": {"o_totalprice": F.col("o_totalprice") * 0.9}}

    def process(self, store):
        store.h1("price", ORDER_PRICE, F.col("o_totalprice"))

    def keep(self):
        return F.col("o_totalprice") > 300000


_SYS = "(VALUES ('', 1.0::DOUBLE), ('systematic/up/', 1.1::DOUBLE), ('systematic/down/', 0.9::DOUBLE)) s(sys, f)"
_FAN = f"""SELECT o_orderkey, o_orderpriority, o_orderstatus, concat(sys, ch) AS variant, CASE WHEN sys = '' THEN o_totalprice ELSE o_totalprice * f END AS price
FROM orders, {_SYS}, (VALUES (''), ('channel/urgent/'), ('channel/finished/')) c(ch)
WHERE ch = '' OR (ch = 'channel/urgent/' AND o_orderpriority = '1-URGENT') OR (ch = 'channel/finished/' AND o_orderstatus = 'F')"""


@query(f"SELECT concat(variant, 'price') AS path, {bin_sql('price', ORDER_PRICE)} AS bx, {SUMS} FROM (SELECT *, 1.0::DOUBLE AS w FROM ({_FAN})) GROUP BY 1, 2")
def systematic_fanout(spark, sf_dir):
    return shown(analyse(_Analysis(), read(spark, sf_dir, "orders")).results, "bx", path=True)


@query(f"SELECT concat('channel/', o_orderpriority, '/price') AS path, {bin_sql('o_totalprice', ORDER_PRICE)} AS bx, {SUMS} FROM (SELECT *, 1.0::DOUBLE AS w FROM orders) GROUP BY 1, 2 UNION ALL SELECT 'price' AS path, {bin_sql('o_totalprice', ORDER_PRICE)} AS bx, {SUMS} FROM (SELECT *, 1.0::DOUBLE AS w FROM orders) GROUP BY 1, 2")
def channel_fanout(spark, sf_dir):
    rows = variants.fan_out(read(spark, sf_dir, "orders"), channel_name=F.col("o_orderpriority"))
    return shown(Store(F.col("variant")).h1("price", ORDER_PRICE, F.col("o_totalprice")).run(rows), "bx", path=True)


_BINNED = f"b AS (SELECT s.sys, {bin_sql('CASE WHEN sys = chr(32) THEN o_totalprice ELSE o_totalprice * f END', ORDER_PRICE)} AS bx, CAST(count(*) AS DOUBLE) AS n FROM orders, (VALUES (' ', 1.0::DOUBLE), ('up', 1.1::DOUBLE), ('down', 0.9::DOUBLE)) s(sys, f) GROUP BY 1, 2)"


#: a source's bins and the nominal's; what one of the two lacks is 0 there
_SHIFTS = f"{_BINNED}, g AS (SELECT DISTINCT s.sys, b.bx FROM b, (SELECT DISTINCT sys FROM b WHERE sys <> ' ') s WHERE b.sys IN (s.sys, ' ')), sh AS (SELECT g.sys, g.bx, coalesce(v.n, 0) - coalesce(c.n, 0) AS shift FROM g LEFT JOIN b v ON v.sys = g.sys AND v.bx = g.bx LEFT JOIN b c ON c.sys = ' ' AND c.bx = g.bx)"


@query(f"WITH {_SHIFTS} SELECT 'price' AS path, bx, sys AS source, shift FROM sh")
def systematic_shift(spark, sf_dir):
    rows = variants.fan_out(read(spark, sf_dir, "orders"), systematics=_Analysis().systematics())
    return variants.shifted(Store(F.col("variant")).h1("price", ORDER_PRICE, F.col("o_totalprice")).run(rows))


@query(f"WITH {_SHIFTS} SELECT 'price' AS path, bx, round(sqrt(sum(shift * shift)), 6) AS syst FROM sh GROUP BY 1, 2")
def systematic_error(spark, sf_dir):
    rows = variants.fan_out(read(spark, sf_dir, "orders"), systematics=_Analysis().systematics())
    shifts = variants.shifted(Store(F.col("variant")).h1("price", ORDER_PRICE, F.col("o_totalprice")).run(rows))
    return results.systematic_error(shifts, ["path", "bx"]).select("path", "bx", F.round("syst", 6).alias("syst"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000 OR o_totalprice * 1.1::DOUBLE > 300000 OR o_totalprice * 0.9::DOUBLE > 300000")
def skim_once(spark, sf_dir):
    return analyse(_Analysis(), read(spark, sf_dir, "orders")).skim.select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice * 1.1::DOUBLE > 300000")
def skim_by_variant(spark, sf_dir):
    keep = (F.col("o_totalprice") > 300000) & (F.col("channel") == "urgent")
    return variants.skim_events(read(spark, sf_dir, "orders"), keep, _Analysis().systematics(), _Analysis().channels()).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice * 1.1::DOUBLE AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice * 1.1::DOUBLE > 300000")
def skim_first_variant(spark, sf_dir):
    """The values of the variant by which an event passes first, which needs the fanned out rows."""
    rows = variants.fan_out(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), _Analysis().channels(), _Analysis().systematics())
    keep = (F.col("o_totalprice") > 300000) & (F.col("channel") == "urgent") & (F.col("systematic") == "up")
    return variants.skim(rows, keep, "o_orderkey", ["o_totalprice"])


# blocks

_ORDERS = "o AS (SELECT *, CAST(o_custkey % 8 AS INTEGER) AS segment, date_trunc('month', o_orderdate) AS month FROM orders)"


def _orders(spark, sf_dir) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate")
    return read(spark, sf_dir, "orders").withColumns({"segment": F.pmod(F.col("o_custkey"), F.lit(8)).cast("int"), "month": month, "run": (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int"), "lb": F.dayofmonth("o_orderdate")})


def _blocks(spark, sf_dir, every=None) -> DataFrame:
    return B.assign(_orders(spark, sf_dir), ["segment"], ["o_orderkey"], ["o_orderstatus"], every)


_BLOCK = f"{_ORDERS}, n AS (SELECT *, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY segment ORDER BY o_orderkey)), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY segment ORDER BY o_orderkey) - 1 AS BIGINT) AS block FROM n)"


@query(f"WITH {_BLOCK} SELECT o_orderkey, segment, block FROM b")
def block_assign(spark, sf_dir):
    return _blocks(spark, sf_dir).select("o_orderkey", "segment", "block")


@query(f"WITH {_ORDERS}, n AS (SELECT *, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w OR (row_number() OVER w - 1) % 10 = 0 THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY segment ORDER BY o_orderkey)) SELECT o_orderkey, CAST(sum(new) OVER (PARTITION BY segment ORDER BY o_orderkey) - 1 AS BIGINT) AS block FROM n")
def block_every_n(spark, sf_dir):
    return _blocks(spark, sf_dir, 10).select("o_orderkey", "block")


_STREAM = "e AS (SELECT event_id, CAST(user_id % 5 AS INTEGER) AS segment, CASE WHEN event_id % 7 = 0 THEN event_type END AS md FROM events)"


def _stream(spark, sf_dir) -> DataFrame:
    md = F.when(F.col("event_id") % 7 == 0, F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(5)).cast("int").alias("segment"), md.alias("md"))


@query(f"WITH {_STREAM} SELECT event_id, CASE WHEN segment % 2 = 0 THEN last_value(md IGNORE NULLS) OVER (PARTITION BY segment ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE first_value(md IGNORE NULLS) OVER (PARTITION BY segment ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS current FROM e")
def block_asof(spark, sf_dir):
    return B.with_metadata(_stream(spark, sf_dir), ["segment"], ["event_id"], "md", F.col("segment") % 2 == 0).select("event_id", "current")


@query(f"WITH {_BLOCK} SELECT o_orderkey, segment FROM b WHERE new = 1")
def block_new_metadata(spark, sf_dir):
    return B.changes(_blocks(spark, sf_dir), ["segment"], ["o_orderkey"]).where("new_metadata").select("o_orderkey", "segment")


@query(f"WITH {_BLOCK} SELECT min(o_orderkey) AS o_orderkey, segment, block FROM b GROUP BY 2, 3")
def salient_first(spark, sf_dir):
    return B.salient(_blocks(spark, sf_dir), ["segment"], ["o_orderkey"]).select("o_orderkey", "segment", "block")


def _metadata(spark, sf_dir) -> DataFrame:
    """A row for each block: what its orders sum up to."""
    rows = _blocks(spark, sf_dir)
    return rows.groupBy("segment", "block").agg(
        F.first("o_orderstatus").alias("status"), F.count("*").cast("long").alias("event_count"), F.collect_set("run").alias("runs"), F.concat_ws("", F.min("o_orderpriority")).alias("tags"),
        F.array_sort(F.collect_list("lb")).alias("lbs"), (F.max("o_totalprice") > 400000).alias("error"), (F.count("*") % 3 + 1).cast("double").alias("factor"), F.min("o_orderkey").alias("first_key"),
    )


HOW = {"event_count": "add", "runs": "union", "tags": "add", "lbs": "append", "error": "and", "factor": "multiply", "first_key": "drop"}
_MD = f"{_BLOCK}, md AS (SELECT segment, block, any_value(o_orderstatus) AS status, count(*) AS event_count, list_distinct(list(CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER))) AS runs, min(o_orderpriority) AS tags, list_sort(list(CAST(day(o_orderdate) AS INTEGER))) AS lbs, max(o_totalprice) > 400000 AS error, CAST(count(*) % 3 + 1 AS DOUBLE) AS factor, min(o_orderkey) AS first_key FROM b GROUP BY 1, 2)"
_MERGED = "CAST(sum(event_count) AS BIGINT) AS event_count, array_to_string(list_sort(list_distinct(flatten(list(runs)))), ',') AS runs, string_agg(tags, '' ORDER BY block) AS tags, array_to_string(flatten(list(lbs ORDER BY block)), ',') AS lbs, bool_and(error) AS error, round(log10(product(factor)), 6) AS factor, arg_min(first_key, block) AS first_key"


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({"runs": F.array_join(F.col("runs").cast("array<string>"), ","), "lbs": F.array_join(F.col("lbs").cast("array<string>"), ","), "factor": F.round(F.log10("factor"), 6)}).drop("block", "merged")


@query(f"WITH {_MD} SELECT segment, status, {_MERGED} FROM md GROUP BY 1, 2")
def meta_merge_global(spark, sf_dir):
    return _as_text(B.merge(_metadata(spark, sf_dir), ["segment", "status"], "block", HOW))


@query(f"WITH {_MD}, i AS (SELECT *, (status = 'O') AS key FROM md), j AS (SELECT *, CASE WHEN key IS DISTINCT FROM lag(key) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM i WINDOW w AS (PARTITION BY segment ORDER BY block)), k AS (SELECT *, sum(new) OVER (PARTITION BY segment ORDER BY block) AS island FROM j) SELECT segment, key, {_MERGED} FROM k GROUP BY segment, island, key")
def meta_merge_per_adjacent(spark, sf_dir):
    blocks = _metadata(spark, sf_dir).withColumn("key", F.col("status") == "O").drop("status")
    return _as_text(B.merge_per(blocks, "key", ["segment"], "block", HOW))


def _one_field(field: str, text: bool = False):
    def run(spark, sf_dir):
        rows = _metadata(spark, sf_dir).select("segment", "block", field)
        merged = B.merge(rows, ["segment"], "block", {field: HOW[field]}).drop("block")
        return merged.withColumn(field, F.array_join(F.col(field).cast("array<string>"), ",")) if text else merged

    return run


for _name, _field, _sql, _text in [
    ("meta_add", "event_count", "CAST(sum(event_count) AS BIGINT) AS event_count", False), ("meta_and", "error", "bool_and(error) AS error", False), ("meta_append", "lbs", "array_to_string(flatten(list(lbs ORDER BY block)), ',') AS lbs", True),
    ("meta_union", "runs", "array_to_string(list_sort(list_distinct(flatten(list(runs)))), ',') AS runs", True), ("meta_drop", "first_key", "arg_min(first_key, block) AS first_key", False), ("meta_add_text", "tags", "string_agg(tags, '' ORDER BY block) AS tags", False),
]:
    QUERIES[_name], ORACLES[_name] = _one_field(_field, _text), f"WITH {_MD} SELECT segment, {_sql} FROM md GROUP BY 1"


@query(f"WITH {_MD} SELECT segment, round(log10(product(factor)), 6) AS factor FROM md GROUP BY 1")
def meta_product(spark, sf_dir):
    return _one_field("factor")(spark, sf_dir).withColumn("factor", F.round(F.log10("factor"), 6))


@query("SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS run, count(*) AS event_count, round(sum(o_totalprice), 2) AS sum_mc_weights, array_to_string(list_sort(list_distinct(list(CAST(day(o_orderdate) AS INTEGER)))), ',') AS lumiblocks FROM orders GROUP BY 1")
def meta_summary(spark, sf_dir):
    out = B.summary(_orders(spark, sf_dir), ["run"], "o_totalprice", "lb")
    return out.withColumns({"sum_mc_weights": F.round("sum_mc_weights", 2), "lumiblocks": F.array_join(F.col("lumiblocks").cast("array<string>"), ",")})


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def split_per(spark, sf_dir):
    path = new_path(spark, "split")
    B.split_per(read(spark, sf_dir, "orders"), "o_orderstatus", path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


# run lists

_RUNS = "r AS (SELECT CAST(y * 100 + m AS INTEGER) AS run, CAST(3 + m AS INTEGER) AS lo, CAST(12 + m AS INTEGER) AS hi FROM (SELECT unnest(range(1992, 1999)) AS y), (SELECT unnest(range(1, 12, 2)) AS m)), r2 AS (SELECT CAST(y * 100 + m AS INTEGER) AS run, CAST(10 AS INTEGER) AS lo, CAST(15 AS INTEGER) AS hi FROM (SELECT unnest(range(1994, 2000)) AS y), (SELECT unnest(range(1, 12, 3)) AS m) UNION ALL SELECT CAST(y * 100 + 1 AS INTEGER), 17, 20 FROM (SELECT unnest(range(1994, 2000)) AS y))"


def _lists(spark) -> tuple[DataFrame, DataFrame]:
    a = [(y * 100 + m, 3 + m, 12 + m) for y in range(1992, 1999) for m in range(1, 12, 2)]
    b = [(y * 100 + m, 10, 15) for y in range(1994, 2000) for m in range(1, 12, 3)] + [(y * 100 + 1, 17, 20) for y in range(1994, 2000)]
    make = lambda rows: spark.createDataFrame(rows, "run int, lo int, hi int")
    return make(a), make(b)


_EX = "x AS (SELECT DISTINCT run, unnest(range(lo, hi + 1)) AS lb FROM r), x2 AS (SELECT DISTINCT run, unnest(range(lo, hi + 1)) AS lb FROM r2)"


@query(f"WITH {_RUNS} SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM r WHERE run = year(o_orderdate) * 100 + month(o_orderdate) AND day(o_orderdate) BETWEEN lo AND hi)")
def grl_semi(spark, sf_dir):
    return run_lists.passing(_orders(spark, sf_dir), _lists(spark)[0], "run", "lb").select("o_orderkey")


@query(f"WITH {_RUNS}, {_EX}, b AS (SELECT * FROM x INTERSECT SELECT * FROM x2), i AS (SELECT *, lb - row_number() OVER (PARTITION BY run ORDER BY lb) AS g FROM b) SELECT run, CAST(min(lb) AS INTEGER) AS lo, CAST(max(lb) AS INTEGER) AS hi FROM i GROUP BY run, g")
def grl_and(spark, sf_dir):
    return run_lists.intersection(*_lists(spark))


@query(f"WITH {_RUNS}, p AS (SELECT DISTINCT run FROM r), q AS (SELECT DISTINCT run FROM r2) SELECT run, 'a' AS only_in FROM (SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL SELECT run, 'b' FROM (SELECT * FROM q EXCEPT SELECT * FROM p)")
def grl_diff(spark, sf_dir):
    return run_lists.difference(*_lists(spark))


@query("WITH b AS (SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate) AS run, day(o_orderdate) AS lb FROM orders WHERE o_orderstatus = 'F'), i AS (SELECT *, lb - row_number() OVER (PARTITION BY run ORDER BY lb) AS g FROM b) SELECT CAST(run AS INTEGER) AS run, CAST(min(lb) AS INTEGER) AS lo, CAST(max(lb) AS INTEGER) AS hi FROM i GROUP BY run, g")
def grl_compress(spark, sf_dir):
    rows = _orders(spark, sf_dir).where("o_orderstatus = 'F'")
    return run_lists.compress(rows.select("run", F.col("lb").alias("lumiblock")))


# reweighting

_XS = "x AS (SELECT n_name AS sample, CAST(n_nationkey AS DOUBLE) * 0.5::DOUBLE + 1 AS xs FROM nation WHERE n_nationkey % 5 <> 0)"
_SAMPLES = "s AS (SELECT n_name AS sample, n_regionkey <> 1 AS simulation, sum(o_totalprice) AS sum_w, count(*) AS event_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
_WEIGHTS = f"{_XS}, {_SAMPLES}, w AS (SELECT s.*, xs, CASE WHEN simulation THEN coalesce(coalesce(xs, 0) * 1000::DOUBLE / sum_w, 0) ELSE 1.0::DOUBLE END AS weight FROM s LEFT JOIN x USING (sample))"


def _sample_orders(spark, sf_dir) -> DataFrame:
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    orders = read(spark, sf_dir, "orders")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "sample")


def _samples(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    samples = _sample_orders(spark, sf_dir).groupBy("sample", (F.col("n_regionkey") != 1).alias("simulation")).agg(F.sum("o_totalprice").alias("sum_w"), F.count("*").alias("event_count"))
    xs = read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("sample"), (F.col("n_nationkey").cast("double") * 0.5 + 1).alias("xs"))
    return samples, xs


@query(f"WITH {_WEIGHTS} SELECT sample, simulation, event_count, round(weight, 10) AS weight FROM w")
def xs_lookup_reweight(spark, sf_dir):
    out = reweight.sample_weights(*_samples(spark, sf_dir), 1000.0)
    return out.select("sample", "simulation", "event_count", F.round("weight", 10).alias("weight"))


_SETS = "t AS (SELECT n_name AS sample, r_name AS set_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
_PER_SAMPLE = f"c AS (SELECT n_name AS sample, {bin_sql('o_totalprice', ORDER_PRICE)} AS bx, CAST(count(*) AS DOUBLE) AS sumw, count(*) AS entries FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


@query(f"WITH {_WEIGHTS}, {_SETS}, {_PER_SAMPLE} SELECT set_name, bx, round(sum(sumw * weight), 6) AS sumw, round(sum(sumw * weight * weight), 6) AS sumw2, CAST(sum(CAST(floor(entries * weight) AS BIGINT)) AS BIGINT) AS entries FROM c JOIN w USING (sample) JOIN t USING (sample) GROUP BY 1, 2")
def sample_sets(spark, sf_dir):
    samples, xs = _samples(spark, sf_dir)
    cells = Store("").h1("price", ORDER_PRICE, F.col("o_totalprice")).run(_sample_orders(spark, sf_dir), keys=["sample"])
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    sets = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("sample"), F.col("r_name").alias("set_name"))
    out = reweight.postprocess(cells, samples, xs, sets, 1000.0)
    return out.select("set_name", "bx", F.round("sumw", 6).alias("sumw"), F.round("sumw2", 6).alias("sumw2"), "entries")


@query(f"WITH {_XS}, {_SAMPLES} SELECT sample, round(sum_w / (1000 * xs * 1.2::DOUBLE), 4) AS effective_lumi FROM s JOIN x USING (sample)")
def effective_lumi(spark, sf_dir):
    samples, xs = _samples(spark, sf_dir)
    joined = samples.join(xs, "sample").withColumns({"k": F.lit(1.2), "filter": F.lit(None).cast("double")})
    return reweight.effective_luminosity(joined).select("sample", F.round("effective_lumi", 4).alias("effective_lumi"))


@query("WITH m AS (SELECT CAST(y * 100 + m AS INTEGER) AS run, concat(chr(CAST(65 + y - 1992 AS INTEGER)), m) AS sub FROM (SELECT unnest(range(1992, 1996)) AS y), (SELECT unnest(range(1, 13)) AS m)) SELECT coalesce(sub, 'UNK') AS subperiod, coalesce(substr(sub, 1, 1), 'UNK') AS period, count(*) AS n FROM orders LEFT JOIN m ON run = year(o_orderdate) * 100 + month(o_orderdate) GROUP BY 1, 2")
def period_lookup(spark, sf_dir):
    rows = [(y * 100 + m, f"{chr(65 + y - 1992)}{m}") for y in range(1992, 1996) for m in range(1, 13)]
    mapping = spark.createDataFrame(rows, "run int, subperiod string")
    return reweight.periods(_orders(spark, sf_dir), mapping, "run").groupBy("subperiod", "period").agg(F.count("*").alias("n"))


# four-vectors

_P = "v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py, CAST(embedding[3] AS DOUBLE) AS pz, abs(CAST(embedding[4] AS DOUBLE)) + 2 AS e FROM embeddings), k AS (SELECT *, sqrt(px * px + py * py) AS pt, sqrt(px * px + py * py + pz * pz) AS p FROM v), h AS (SELECT *, 0.5 * ln((p + pz) / (p - pz)) AS eta, atan2(py, px) AS phi FROM k)"
_PI = "3.141592653589793::DOUBLE"


def _vectors(spark, sf_dir) -> DataFrame:
    g = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return read(spark, sf_dir, "embeddings").select("vec_id", L.vector(g(0), g(1), g(2), F.abs(g(3)) + 2).alias("v"))


@query(f"WITH {_P} SELECT vec_id, round(pt, 6) AS pt, round(p, 6) AS p, round(CASE WHEN (e - p) * (e + p) < 0 THEN -sqrt(-((e - p) * (e + p))) ELSE sqrt((e - p) * (e + p)) END, 5) AS m, round(sqrt((e - pz) * (e + pz)), 6) AS mt, round(0.5 * ln((e + pz) / (e - pz)), 6) AS y, round(eta, 6) AS eta, round(phi, 6) AS phi, round(atan2(pt, pz), 6) AS theta, round(e / p * pt, 6) AS et FROM h")
def lorentz_kinematics(spark, sf_dir):
    v = F.col("v")
    r = lambda c, n=6: F.round(c, n)
    return _vectors(spark, sf_dir).select("vec_id", r(L.pt(v)).alias("pt"), r(L.p(v)).alias("p"), r(L.m(v), 5).alias("m"), r(L.mt(v)).alias("mt"), r(L.rapidity(v)).alias("y"), r(L.eta(v)).alias("eta"), r(L.phi(v)).alias("phi"), r(L.theta(v)).alias("theta"), r(L.et(v)).alias("et"))


def _pairs(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")


@query(f"WITH {_P}, q AS (SELECT a.vec_id, a.px + b.px AS px, a.py + b.py AS py, a.pz + b.pz AS pz, a.e + b.e AS e FROM v a JOIN v b ON b.vec_id = a.vec_id + 1), m AS (SELECT vec_id, e * e - px * px - py * py - pz * pz AS m2 FROM q) SELECT vec_id, round(CASE WHEN m2 < 0 THEN -sqrt(-m2) ELSE sqrt(m2) END, 5) AS m FROM m")
def lorentz_pair_mass(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(L.m(L.add(F.col("v"), F.col("u"))), 5).alias("m"))


@query(f"WITH {_P}, q AS (SELECT a.vec_id, a.eta - b.eta AS de, a.phi - b.phi AS dp FROM h a JOIN h b ON b.vec_id = a.vec_id + 1), r AS (SELECT vec_id, de, CASE WHEN dp >= {_PI} THEN dp - 2 * {_PI} WHEN dp < -{_PI} THEN dp + 2 * {_PI} ELSE dp END AS dp FROM q) SELECT vec_id, round(dp, 6) AS delta_phi, round(sqrt(de * de + dp * dp), 6) AS delta_r FROM r")
def delta_r(spark, sf_dir):
    v, u = F.col("v"), F.col("u")
    return _pairs(spark, sf_dir).select("vec_id", F.round(L.delta_phi(v, u), 6).alias("delta_phi"), F.round(L.delta_r(v, u), 6).alias("delta_r"))


# objects within events


def _events(spark, sf_dir) -> DataFrame:
    item = F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_quantity >= 20) AS kept, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity >= 20), 0), 2) AS price FROM lineitem GROUP BY 1")
def objects_filter(spark, sf_dir):
    kept = O.remove_if(F.col("items"), lambda o: o["l_quantity"] < 20)
    return _events(spark, sf_dir).select("l_orderkey", kept.alias("k")).select("l_orderkey", F.size("k").cast("long").alias("kept"), F.round(O.total(F.col("k"), lambda o: o["l_extendedprice"]), 2).alias("price"))


@query("SELECT l_orderkey, max(l_extendedprice) AS leading, min(l_extendedprice) AS lowest, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS leading_line FROM lineitem GROUP BY 1")
def objects_sort_leading(spark, sf_dir):
    price = lambda o: o["l_extendedprice"]
    items = F.col("items")
    return _events(spark, sf_dir).select("l_orderkey", O.leading(items, price)["l_extendedprice"].alias("leading"), F.get(O.sort_key(items, price), F.lit(0))["l_extendedprice"].alias("lowest"), O.max_element(items, price)["l_linenumber"].alias("leading_line"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_quantity > 5) AS all_large FROM lineitem GROUP BY 1")
def objects_any_all(spark, sf_dir):
    return _events(spark, sf_dir).select("l_orderkey", O.any_of(F.col("items"), lambda o: o["l_returnflag"] == "R").alias("any_returned"), O.all_of(F.col("items"), lambda o: o["l_quantity"] > 5).alias("all_large"))


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), '' ORDER BY l_linenumber) AS lines, concat('order ', l_orderkey, ' has ', count(*), ' items') AS text FROM lineitem GROUP BY 1")
def strings_of_fields(spark, sf_dir):
    lines = F.transform("items", lambda o: o["l_linenumber"])
    return _events(spark, sf_dir).select("l_orderkey", O.field_as_string(lines, True).alias("lines"), O.str_printf("order %d has %d items", F.col("l_orderkey"), F.size("items")).alias("text"))


# looking into tables

_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query(" UNION ALL ".join(
    f"SELECT '{f}' AS field, count(x) AS n, round(sum(x), 2) AS total, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS stddev, min(x) AS min, max(x) AS max, min(x) FILTER (WHERE x > (SELECT min(CAST({f} AS DOUBLE)) FROM lineitem)) AS min1, max(x) FILTER (WHERE x < (SELECT max(CAST({f} AS DOUBLE)) FROM lineitem)) AS max1 FROM (SELECT CAST({f} AS DOUBLE) AS x FROM lineitem)" for f in _FIELDS
))
def field_stats(spark, sf_dir):
    out = inspect.field_stats(read(spark, sf_dir, "lineitem"), _FIELDS)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def class_counts(spark, sf_dir):
    return inspect.class_counts(read(spark, sf_dir, "events"), "event_type")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def dump_select(spark, sf_dir):
    return inspect.select_equal(read(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 100) WHERE o_orderstatus = 'O'")
def offset_limit(spark, sf_dir):
    return inspect.dump(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 100, 200, o_orderstatus="O")


@query("SELECT event_id, event_type FROM events WHERE event_id IN (3, 17, 400, 999999999)")
def pick_events(spark, sf_dir):
    return inspect.pick(read(spark, sf_dir, "events"), "event_id", [3, 17, 400, 999999999]).select("event_id", "event_type")


@query("SELECT '-' AS side, * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT '+' AS side, * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber = 2 EXCEPT ALL SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber = 1)")
def diff_tables(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    side = lambda n: items.where(F.col("l_linenumber") == n).select("l_returnflag", "l_linestatus", "l_quantity")
    return inspect.difference(side(1), side(2))


# comparing results

_SIDE = lambda s: f"SELECT {bin_sql('o_totalprice', ORDER_PRICE)} AS bx, sum(w) AS v, sum(w * w) AS v2 FROM (SELECT *, {s} FROM orders) GROUP BY 1"
_BOTH = f"a AS ({_SIDE('''CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w''')}), b AS ({_SIDE('''CASE WHEN o_orderstatus = 'O' THEN 1.05::DOUBLE ELSE 0.0::DOUBLE END AS w''')}), j AS (SELECT coalesce(a.bx, b.bx) AS bx, coalesce(a.v, 0) AS d, coalesce(a.v2, 0) AS d2, coalesce(b.v, 0) AS m, coalesce(b.v2, 0) AS m2 FROM a FULL JOIN b ON a.bx = b.bx)"


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    side = lambda s, w: Store("", F.when(F.col("o_orderstatus") == s, w).otherwise(0.0)).h1("p", ORDER_PRICE, F.col("o_totalprice")).run(orders)
    return side("F", 1.0), side("O", 1.05)


@query(f"WITH {_BOTH} SELECT bx, CASE WHEN m > 0 THEN round(d / m, 6) ELSE 0 END AS ratio FROM j")
def ratio_panel(spark, sf_dir):
    return results.ratio(*_two(spark, sf_dir)).select("bx", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {_BOTH} SELECT bx, CASE WHEN d > 0 THEN round((d - m) / sqrt(m2 + greatest(d2, 1)), 6) ELSE 0 END AS pull FROM j")
def pull_panel(spark, sf_dir):
    return results.pull(*_two(spark, sf_dir)).select("bx", F.round("pull", 6).alias("pull"))


@query(f"SELECT 'sum' AS path, bx, round(sum(greatest(v, 0)), 4) AS sumw FROM (SELECT o_orderstatus, {bin_sql('o_totalprice', ORDER_PRICE)} AS bx, sum(CASE WHEN o_orderkey % 3 = 0 THEN -1.0::DOUBLE ELSE 0.4::DOUBLE END) AS v FROM orders GROUP BY 1, 2) GROUP BY 2")
def mc_sum_clamped(spark, sf_dir):
    weight = F.when(F.col("o_orderkey") % 3 == 0, -1.0).otherwise(0.4)
    cells = Store(F.concat(F.col("o_orderstatus"), F.lit("/")), weight).h1("p", ORDER_PRICE, F.col("o_totalprice")).run(read(spark, sf_dir, "orders"))
    return results.clamped_sum(cells, F.lit("sum")).select("path", "bx", F.round("sumw", 4).alias("sumw"))


@query("SELECT o_orderpriority, round(s / sqrt(b + 0.01::DOUBLE * b * b + b), 6) AS significance FROM (SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE o_orderstatus <> 'P') AS DOUBLE) AS b FROM orders GROUP BY 1)")
def significance(spark, sf_dir):
    s, b = (F.count_if(F.col("o_orderstatus") == "P").cast("double"), F.count_if(F.col("o_orderstatus") != "P").cast("double"))
    out = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(s.alias("s"), b.alias("b"))
    return out.select("o_orderpriority", F.round(results.significance(F.col("s"), F.col("b"), F.lit(0.1) * F.col("b"), F.sqrt("b")), 6).alias("significance"))


@query("SELECT n_regionkey, round(sum(n), 4) AS value, round(sqrt(sum(n)), 6) AS stat FROM (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def uncertainty_combine(spark, sf_dir):
    counts = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("value")).withColumn("stat", F.sqrt("value"))
    joined = counts.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return results.combine(joined, ["n_regionkey"]).select("n_regionkey", F.round("value", 4).alias("value"), F.round("stat", 6).alias("stat"))


# reshaping

ORDER_SCHEMA = T.StructType([
    T.StructField("key", T.LongType(), metadata={"source_column": "o_orderkey"}),
    T.StructField("price", T.StructType([T.StructField("total", T.DoubleType(), metadata={"source_column": "totalprice"}), T.StructField("missing", T.DoubleType())]), metadata={"source_prefix": "o_"}),
    T.StructField("status", T.StringType(), metadata={"source_column": "o_orderstatus"}),
])


@query("SELECT o_orderkey AS key, o_totalprice AS total, o_orderstatus AS status, -999.0::DOUBLE AS missing FROM orders")
def nest_columns(spark, sf_dir):
    nested = reshape.nest(read(spark, sf_dir, "orders"), ORDER_SCHEMA)
    return nested.select("key", F.col("price.total").alias("total"), "status", F.coalesce("price.missing", F.lit(-999.0)).alias("missing"))


@query("SELECT o_orderkey AS key, o_totalprice AS price_total, -999.0::DOUBLE AS price_missing FROM orders")
def flatten_nested(spark, sf_dir):
    return reshape.flatten(reshape.nest(read(spark, sf_dir, "orders"), ORDER_SCHEMA))


@query("SELECT l_orderkey, string_agg(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, l_quantity, l_extendedprice) AS prices FROM lineitem GROUP BY 1")
def zip_columns(spark, sf_dir):
    items = _events(spark, sf_dir).select("l_orderkey", F.transform("items", lambda o: o["l_linenumber"]).alias("number"), F.transform("items", lambda o: o["l_extendedprice"]).alias("price"))
    records = reshape.zipped({"number": F.col("number"), "price": F.col("price")}, ["number", "price"], {"number": T.IntegerType(), "price": T.DoubleType()})
    return items.select("l_orderkey", records.alias("r")).select("l_orderkey", F.array_join(F.transform("r", lambda o: F.floor(o["price"]).cast("string")), ",").alias("prices"))



# more of looking into tables and events


@query(f"WITH {_STREAM} SELECT event_id, segment, md FROM e WHERE md IS NOT NULL")
def metadata_only(spark, sf_dir):
    return tables.metadata_only(_stream(spark, sf_dir), "md")


@query("SELECT CAST(user_id % 3 AS INTEGER) AS segment, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def footers(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    parts = [events.where(F.col("user_id") % 3 == i) for i in range(3)]
    return tables.footers(tables.concatenate(*parts), "event_type")


@query("SELECT CAST(o_custkey % 9 + 100000 AS VARCHAR) AS run, count(*) AS n, round(sum(o_totalprice), 2) AS sum_w FROM orders GROUP BY 1")
def run_counts(spark, sf_dir):
    name = F.concat(F.lit("mc."), (F.col("o_custkey") % 9 + 100000).cast("string"), F.lit(".root"))
    out = inspect.run_counts(read(spark, sf_dir, "orders").withColumn("name", name), "name", "o_totalprice")
    return out.withColumn("sum_w", F.round("sum_w", 2))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN props IS NULL THEN 0 ELSE 1 END + CASE WHEN value IS NULL THEN 0 ELSE 1 END)::BIGINT AS fields FROM events GROUP BY 1")
def class_fields(spark, sf_dir):
    return inspect.class_sizes(read(spark, sf_dir, "events").select("event_type", "value", "props"), "event_type").select("event_type", "n", "fields")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice) >= 15000 AND abs(l_discount * 40::DOUBLE) <= 2.5::DOUBLE AND l_quantity >= 1 AND l_linenumber >= 4")
def track_selection(spark, sf_dir):
    test = O.good_track(F.col("l_extendedprice"), F.col("l_discount") * 40.0, F.col("l_quantity"), F.col("l_linenumber"))
    return read(spark, sf_dir, "lineitem").where(test).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE abs(p_partkey) < 10 OR p_partkey = 21 OR (abs(p_partkey) < 9999 AND (p_partkey // 10) % 10 = 0)")
def coloured(spark, sf_dir):
    return read(spark, sf_dir, "part").where(O.is_coloured(F.col("p_partkey"))).select("p_partkey")


@query("SELECT l_orderkey, round(coalesce(-sum(l_extendedprice) FILTER (WHERE l_quantity < 15), 0), 2) AS central, round(coalesce(-sum(l_extendedprice) FILTER (WHERE l_quantity >= 15 AND l_quantity < 32), 0), 2) AS endcap FROM lineitem GROUP BY 1")
def regional_sums(spark, sf_dir):
    part = lambda lo, hi: F.round(O.regional_sum(F.col("items"), lambda o: o["l_extendedprice"], lambda o: o["l_quantity"], lo, hi), 2)
    return _events(spark, sf_dir).select("l_orderkey", part(0, 15).alias("central"), part(15, 32).alias("endcap"))


@query("SELECT a.l_orderkey, count(*) AS matched FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R' AND abs(b.l_quantity - a.l_quantity) < 3) GROUP BY 1")
def object_matching(spark, sf_dir):
    items = F.col("items")
    returned = F.filter(items, lambda o: o["l_returnflag"] == "R")
    found = O.matched(items, returned, lambda a, b: F.abs(a["l_quantity"] - b["l_quantity"]), 3.0)
    return _events(spark, sf_dir).select("l_orderkey", F.size(found).cast("long").alias("matched")).where("matched > 0")


@query(f"SELECT cut, CAST(ordinal AS INTEGER) AS ordinal, round(sum(CASE WHEN s = 'O' THEN w ELSE 0 END), 4) AS \"O\", round(sum(CASE WHEN s = 'F' THEN w ELSE 0 END), 4) AS \"F\", round(sum(w), 4) AS background, round(sqrt(sum(w)), 6) AS error FROM ({' UNION ALL '.join(f"SELECT '{n}' AS cut, {i} AS ordinal, l_linestatus AS s, count(*)::DOUBLE AS w FROM lineitem WHERE {t} GROUP BY 3" for i, (n, t) in enumerate(_SQL_TESTS.items()))}) GROUP BY 1, 2")
def cutflow_table(spark, sf_dir):
    store = Store()
    for name, test in _tests().items():
        store.passed("cuts", name, test)
    cells = store.run(read(spark, sf_dir, "lineitem").withColumn("sample", F.col("l_linestatus")), keys=["sample"])
    out = results.cut_table(cells, ["O", "F"], ["O", "F"])
    return out.select("cut", "ordinal", *[F.round(c, 4).alias(c) for c in ("O", "F", "background")], F.round("error", 6).alias("error"))


@query(f"WITH c AS (SELECT concat(o_orderstatus, '/p') AS path, (count(*) FILTER (WHERE {bin_sql('o_totalprice', NARROW)} BETWEEN 1 AND 20))::DOUBLE AS integral FROM orders GROUP BY 1) SELECT path, integral, CAST(row_number() OVER (ORDER BY path <> 'P/p', integral, path) AS INTEGER) AS place FROM c")
def stack_order(spark, sf_dir):
    cells = Store(F.concat(F.col("o_orderstatus"), F.lit("/"))).h1("p", NARROW, F.col("o_totalprice")).run(read(spark, sf_dir, "orders"))
    return results.stacked(cells, 20, "P/p")


@query("SELECT o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice, '' AS comment, 0 AS flags FROM orders")
def with_defaults(spark, sf_dir):
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("comment", T.StringType()), T.StructField("flags", T.IntegerType())])
    return reshape.with_defaults(read(spark, sf_dir, "orders"), schema)


@query("SELECT n_name AS sample, r_name AS set_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0")
def missing_samples(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    sets = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("sample"), F.col("r_name").alias("set_name"))
    return reweight.missing_samples(sets, _samples(spark, sf_dir)[1].select("sample"))


# results and aggregates


@query(f"WITH f AS ({_FLOW}) SELECT cut, CAST(ordinal AS INTEGER) AS ordinal, round(2 * sumw * 0.5::DOUBLE, 4) AS sumw, round(2 * sumw2 * 0.25::DOUBLE, 4) AS sumw2, CAST(floor(2 * entries * 0.5::DOUBLE) AS BIGINT) AS entries FROM f")
def cutflow_merge_scale(spark, sf_dir):
    flow = _flow(spark, sf_dir)
    return shown(results.cut_flow(results.scale(results.merge(flow, flow), 0.5)), "cut", "ordinal")


@query(f"WITH {_CELLS} SELECT 'h/x' AS path, bx, round(sqrt(sumw2), 4) AS error, round(sumw, 4) AS sumw FROM c")
def cell_listing(spark, sf_dir):
    return results.listing(_h1(spark, sf_dir, HALF)).select("path", "bx", F.round("error", 4).alias("error"), F.round("sumw", 4).alias("sumw"))


@query(f"WITH {_CELLS} SELECT 'h/x' AS path, bx, round(sumw, 4) AS sumw, round(sumw2, 4) AS sumw2, entries FROM c")
def results_on_disk(spark, sf_dir):
    path = new_path(spark, "results")
    tables.write_results(_h1(spark, sf_dir, HALF), path)
    return shown(tables.read_results(spark, path, "H1"), "bx", path=True)


@query(f"WITH {_CELLS}, f AS ({_FLOW}) SELECT 'H1' AS kind, CAST(count(*) AS BIGINT) AS cells, round(sum(sumw), 3) AS total FROM c UNION ALL SELECT 'CUTFLOW', CAST(count(*) AS BIGINT), round(max(sumw), 3) FROM f")
def results_by_kind(spark, sf_dir):
    both = _h1(spark, sf_dir, HALF).unionByName(_flow(spark, sf_dir))
    one = lambda f: lambda cells: cells.groupBy("kind").agg(F.count("*").alias("cells"), F.round(f("sumw"), 3).alias("total"))
    return tables.by_kind(both, {"H1": one(F.sum), "CUTFLOW": one(F.max)})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000")
def skim_on_disk(spark, sf_dir):
    path = new_path(spark, "skim")
    tables.write_events(read(spark, sf_dir, "orders").where("o_totalprice > 300000"), path, ["o_orderstatus"])
    return tables.read_events(spark, [path]).select("o_orderkey", "o_custkey")


@query("SELECT 'range/' || o_orderstatus AS path, count(*) AS n, round(sum(o_totalprice) * 0.5::DOUBLE, 2) AS total, round(min(o_totalprice), 2) AS lowest, round(max(o_totalprice), 2) AS highest, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def user_aggregate(spark, sf_dir):
    price = F.col("o_totalprice")
    kind = Aggregate("RANGE", {"n": (F.lit(1).cast("long"), "sum"), "total": (price, "sum"), "lowest": (price, "min"), "highest": (price, "max"), "priorities": (F.col("o_orderpriority"), "union")}, {"total": 1})
    orders, path = read(spark, sf_dir, "orders"), F.concat(F.lit("range/"), F.col("o_orderstatus"))
    whole = kind.merge(*[kind.fill(orders, path, F.col("o_orderkey") % 2 == i) for i in range(2)])
    out = kind.scale(whole, 0.5)
    return out.select("path", "n", F.round("total", 2).alias("total"), F.round("lowest", 2).alias("lowest"), F.round("highest", 2).alias("highest"), F.array_join("priorities", ",").alias("priorities"))


@query(f"SELECT {bin_sql('o_totalprice', ORDER_PRICE)} AS bx, count(*) AS entries FROM orders GROUP BY 1")
def stream_fills(spark, sf_dir):
    """The fills of a stream that ends, as its sink has them."""
    orders = read(spark, sf_dir, "orders")
    source = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    name = f"cells_{uuid.uuid4().hex}"
    cells = running_cells(source, Store().h1("p", ORDER_PRICE, F.col("o_totalprice")))
    cells.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("bx", "entries")


# more of blocks


@query(f"WITH {_MD} SELECT segment, status, any_value(status) AS kind, CAST(sum(event_count) AS BIGINT) AS event_count FROM md GROUP BY 1, 2")
def meta_block(spark, sf_dir):
    rows = _metadata(spark, sf_dir).select("segment", "status", "block", F.col("status").alias("kind"), "event_count")
    return B.merge(rows, ["segment", "status"], "block", {"kind": "block", "event_count": "add"}).drop("block")


@query(f"WITH {_BLOCK} SELECT o_orderkey, segment, block FROM b")
def block_stitched(spark, sf_dir):
    rows = B.assign_stitched(_orders(spark, sf_dir), ["segment"], "o_orderkey", ["o_orderstatus"], 500)
    return rows.select("o_orderkey", "segment", "block")


class _Manual(Processor):
    """A block for each order in progress and what follows it."""

    metadata, segment, order, per_block = "MANUAL_FORWARD", ("segment",), ("o_orderkey",), True

    def block_marks(self):
        return F.col("o_orderstatus") == "P", F.struct("o_orderkey", "run")

    def process(self, store):
        store.passed("orders", "all")


_MARKED = f"{_ORDERS}, m AS (SELECT *, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY o_orderkey) AS BIGINT) AS block FROM o)"


@query(f"WITH {_MARKED} SELECT segment, block, count(*) AS entries FROM m GROUP BY 1, 2")
def results_per_block(spark, sf_dir):
    return analyse(_Manual(), _orders(spark, sf_dir)).results.select("segment", "block", "entries")


@query(f"WITH {_MARKED} SELECT segment, block, o_orderkey AS first, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS run FROM m WHERE o_orderstatus = 'P'")
def manual_blocks(spark, sf_dir):
    return analyse(_Manual(), _orders(spark, sf_dir)).metadata.select("segment", "block", F.col("metadata.o_orderkey").alias("first"), "metadata.run")


@query(f"WITH {_ORDERS}, m AS (SELECT *, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block FROM o) SELECT o_orderkey, block FROM m")
def manual_blocks_backward(spark, sf_dir):
    return B.manual(_orders(spark, sf_dir), ["segment"], ["o_orderkey"], F.col("o_orderstatus") == "P", F.col("run"), forward=False)[0].select("o_orderkey", "block")


@query("WITH e AS (SELECT CAST(user_id % 7 AS INTEGER) AS run, CASE WHEN event_id % 3 = 0 THEN ['all', 'even'] WHEN event_id % 3 = 1 THEN ['all', 'odd'] ELSE ['all'] END AS s, value FROM events) SELECT run, count(*) AS event_count, round(sum(value), 4) AS sum_mc_weights, CASE WHEN count(*) = count(*) FILTER (WHERE list_contains(s, 'all')) THEN 'all' ELSE '' END AS streams FROM e GROUP BY 1")
def meta_streams(spark, sf_dir):
    tags = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("all"), F.lit("even"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("all"), F.lit("odd"))).otherwise(F.array(F.lit("all")))
    rows = read(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(7)).cast("int").alias("run"), "value", "event_id", tags.alias("tags"))
    out = B.summary(rows, ["run"], "value", "event_id", "tags")
    return out.select("run", "event_count", F.round("sum_mc_weights", 4).alias("sum_mc_weights"), F.array_join("streams", ",").alias("streams"))


# the stream format

_RECORDS = f"{_BLOCK}, h AS (SELECT segment, block, min(o_orderkey) AS first, any_value(o_orderstatus) AS status FROM b GROUP BY 1, 2)"


def _as_records(spark, sf_dir) -> str:
    """Orders and their blocks as streams: a file a segment, each block's metadata before its orders."""
    rows = B.changes(_blocks(spark, sf_dir), ["segment"], ["o_orderkey"])
    about = F.struct(F.col("block").alias("number"), F.col("o_orderstatus").alias("status"), (F.col("block") % 2 == 0).alias("even"))
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.array("run", "lb").alias("at"))
    # a row's records are written in the order of its columns
    rows = rows.select("segment", "o_orderkey", F.when(F.col("new_metadata"), about).alias("Block"), order.alias("Order"))
    path = new_path(spark, "records")
    streams.write_streams(rows, path, "segment", ["o_orderkey"], ["Block"])
    return path


def _of_class(spark, path: str, stream: DataFrame, name: str) -> DataFrame:
    return streams.of_class(stream, name, streams.class_schemas(path)[name])


@query(f"WITH {_RECORDS} SELECT o_orderkey AS key, o_totalprice AS price, concat(CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER), ',', day(o_orderdate)) AS at, status FROM b JOIN h USING (segment, block)")
def stream_round_trip(spark, sf_dir):
    """Written, read back, and each order with the metadata of its block."""
    path = _as_records(spark, sf_dir)
    stream = streams.read_streams(spark, path)
    about = F.when(F.col("is_metadata"), F.get_json_object("json", "$.status"))
    known = B.with_metadata(stream.withColumn("status", about), ["path", "segment"], ["position"], "status", F.col("forward"))
    schema = streams.class_schemas(path)["Order"]
    orders = known.where("class_name = 'Order'").select(streams.parsed(F.col("json"), schema).alias("r"), "current")
    return orders.select("r.key", "r.price", F.array_join(F.col("r.at").cast("array<string>"), ",").alias("at"), F.col("current").alias("status"))


@query(f"WITH {_RECORDS} SELECT block AS number, status, block % 2 = 0 AS even, count(*) AS blocks FROM h GROUP BY ALL")
def stream_metadata(spark, sf_dir):
    """All metadata, read by the footers' offsets, without the orders between."""
    path = _as_records(spark, sf_dir)
    blocks = _of_class(spark, path, streams.read_streams(spark, path, metadata_only=True), "Block")
    return blocks.groupBy("number", "status", "even").agg(F.count("*").alias("blocks"))


@query(f"WITH {_RECORDS} SELECT o_orderkey AS key FROM b WHERE block = 3")
def stream_block(spark, sf_dir):
    """The fourth block of each segment, sought without reading those before."""
    path = _as_records(spark, sf_dir)
    return _of_class(spark, path, streams.read_streams(spark, path, block=3), "Order").select("key")


@query(f"WITH {_RECORDS} SELECT 'Order' AS class_name, count(*) AS records FROM b UNION ALL SELECT 'Block', count(*) FROM h")
def stream_footers(spark, sf_dir):
    found = streams.footers(spark, _as_records(spark, sf_dir)).where("class_name IS NOT NULL")
    return found.groupBy("class_name").agg(F.sum("count").alias("records"))


@query(f"WITH {_RECORDS}, z AS (SELECT segment, count(*) AS n, (SELECT count(*) FROM h WHERE h.segment = b.segment) AS blocks FROM b GROUP BY 1) SELECT CAST(sum(n + blocks) AS BIGINT) AS shown, CAST(count(*) AS BIGINT) AS headers, CAST(2 * count(*) AS BIGINT) AS classes, CAST(sum(blocks) AS BIGINT) AS sections FROM z")
def stream_internal(spark, sf_dir):
    """The stream's own records too: a header a segment, its classes, a compressed section a block."""
    stream = streams.read_streams(spark, _as_records(spark, sf_dir), internal=True, json=False)
    own = lambda *ids: F.count_if(F.col("class_id").isin(*ids))
    return stream.agg(F.count_if(F.col("class_id") > 200).alias("shown"), own(streams.HEADER).alias("headers"), own(streams.CLASS).alias("classes"), own(streams.START_COMPRESSED).alias("sections"))


# text inputs


@query(f"WITH {_RUNS} SELECT CAST(run AS BIGINT) AS run, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM r2")
def run_list_xml(spark, sf_dir):
    path = new_path(spark, "xml")
    spark.createDataFrame([(texts.run_list_to_xml(_lists(spark)[1]),)], "value string").coalesce(1).write.text(path)
    return texts.run_list_from_xml(spark, path)


def _set_file(spark, sf_dir) -> DataFrame:
    nations, path = read(spark, sf_dir, "nation").orderBy("n_regionkey", "n_nationkey").collect(), new_path(spark, "sets")
    lines = []
    for region in sorted({r.n_regionkey for r in nations}):
        lines += [f":set{region}:Region {region}", *(f"{r.n_nationkey} x 2.0 0.5 {r.n_nationkey + 1}.5 a b" for r in nations if r.n_regionkey == region)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return texts.sample_sets(spark, path)


_SET_ROWS = "t AS (SELECT concat('set', n_regionkey) AS set_name, CAST(n_nationkey AS VARCHAR) AS sample, n_nationkey + 1.5::DOUBLE AS xs, 2.0::DOUBLE AS k, 0.5::DOUBLE AS filter FROM nation)"
_SET_COUNTS = "s AS (SELECT CAST(c_nationkey AS VARCHAR) AS sample, c_nationkey % 2 = 0 AS simulation, count(*) AS event_count, sum(c_acctbal) AS sum_w FROM customer WHERE c_nationkey <> 3 GROUP BY 1, 2)"


def _set_counts(spark, sf_dir) -> DataFrame:
    customers = read(spark, sf_dir, "customer").where("c_nationkey <> 3").withColumns({"sample": F.col("c_nationkey").cast("string"), "simulation": F.col("c_nationkey") % 2 == 0})
    return customers.groupBy("sample", "simulation").agg(F.count("*").alias("event_count"), F.sum("c_acctbal").alias("sum_w"))


@query(f"WITH {_SET_ROWS} SELECT set_name, concat('Region ', substr(set_name, 4)) AS title, sample, xs, k, filter FROM t")
def set_file(spark, sf_dir):
    # lines of seven cells have the cross section in the fifth
    return _set_file(spark, sf_dir)


@query(f"WITH {_SET_ROWS} SELECT set_name, string_agg(sample, ' ' ORDER BY sample) AS samples FROM t GROUP BY 1")
def set_listing(spark, sf_dir):
    return reweight.set_listing(_set_file(spark, sf_dir))


@query(f"WITH {_SET_ROWS}, {_SET_COUNTS} SELECT set_name, sample, xs * k AS xs, event_count, round(sum_w, 4) AS sum_w, round(sum_w / (1000 * xs * k * filter), 6) AS lumi, sum(xs * k) OVER (PARTITION BY set_name) AS set_xs FROM t LEFT JOIN s USING (sample)")
def luminosity_table(spark, sf_dir):
    out = reweight.luminosity_table(_set_file(spark, sf_dir), _set_counts(spark, sf_dir))
    return out.withColumns({"sum_w": F.round("sum_w", 4), "lumi": F.round("lumi", 6)})


@query(f"WITH {_SET_COUNTS} SELECT CASE WHEN simulation THEN 'simulated' ELSE 'data' END AS part, CAST(sum(event_count) AS BIGINT) AS entries FROM s GROUP BY 1")
def split_by_simulation(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").where("c_nationkey <> 3").withColumn("sample", F.col("c_nationkey").cast("string"))
    cells = Store().h1("balance", Axis(10, -1000, 10000), F.col("c_acctbal")).run(customers, keys=["sample"])
    parts = zip(("data", "simulated"), reweight.split_by_simulation(cells, _set_counts(spark, sf_dir)), strict=True)
    data, simulated = (df.agg(F.sum("entries").alias("entries")).select(F.lit(n).alias("part"), "entries") for n, df in parts)
    return data.unionByName(simulated)


# more functions


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS known, concat('order ', o_orderkey, '/', o_orderstatus) AS text FROM orders")
def maps_and_texts(spark, sf_dir):
    mapping = F.create_map(F.lit("F"), F.lit(1), F.lit("P"), F.lit(2))
    return read(spark, sf_dir, "orders").select("o_orderkey", O.in_map(mapping, F.col("o_orderstatus")).alias("known"), O.str_cat("order ", F.col("o_orderkey"), "/", F.col("o_orderstatus")).alias("text"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 25 AS id, l_extendedprice AS pt, l_linenumber % 3 <> 0 AS final FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN id = 11 THEN 'electron' WHEN id = 13 THEN 'muon' ELSE 'neutrino' END AS kind FROM t WHERE id IN (11, 12, 13, 14, 16, 18) AND final AND pt > 5000")
def truth_selection(spark, sf_dir):
    vertex = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey"))
    kind = O.truth_kind(F.col("l_partkey") % 25, vertex, F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind")).where("kind IS NOT NULL")


@query(f"""WITH {_P}, r AS (SELECT vec_id, CASE WHEN dp >= {_PI} THEN dp - 2 * {_PI} WHEN dp < -{_PI} THEN dp + 2 * {_PI} ELSE dp END AS phi, px, py, pz, pt, p, eta, e FROM (SELECT *, phi + 1.0::DOUBLE AS dp FROM h))
SELECT vec_id, round(pt, 5) AS pt, round(eta, 5) AS eta, round(phi, 5) AS phi, round(sqrt(p * p + 4), 5) AS e, round(e, 5) AS given, round(sqrt(px * px + py * py), 5) AS met, round(px - 2 * px, 5) AS difference, round(e / p * pt, 5) AS transverse FROM r""")
def lorentz_constructors(spark, sf_dir):
    v = F.col("v")
    parts = (L.pt(v), L.eta(v), L.phi(v) + 1.0)
    made, given = L.from_pt_eta_phi_m(*parts, F.lit(2.0)), L.from_pt_eta_phi_e(*parts, v["e"])
    r = lambda c: F.round(c, 5)
    return _vectors(spark, sf_dir).select(
        "vec_id", r(L.pt(made)).alias("pt"), r(L.eta(made)).alias("eta"), r(L.phi(made)).alias("phi"), r(made["e"]).alias("e"), r(given["e"]).alias("given"),
        r(L.from_met(v["px"], v["py"])["e"]).alias("met"), r(L.subtract(v, L.scale(v, 2.0))["px"]).alias("difference"), r(L.transverse(v)["e"]).alias("transverse"),
    )


@query("SELECT o_orderkey, o_custkey % 2 <> 0 AS odd, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders")
def conversions(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 2).cast("int").alias("odd"), F.year("o_orderdate").alias("year"))
    wanted = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("odd", T.BooleanType()), T.StructField("year", T.LongType())])
    return reshape.nest(rows, wanted)


@query("""SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS line FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 10)""")
def dump_lines(spark, sf_dir):
    return inspect.lines(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 10, 50)
