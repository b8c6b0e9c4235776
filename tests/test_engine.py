"""Behaviours of the engine's parts."""

import datetime
import io
import math
import os
import random

import pytest
from pyspark.sql import functions as F
from tallyforge.functions import lorentz, objects
from tallyforge.functions.axis import Axis, VariableAxis
from tallyforge.operators import blocks, inspect, reshape, results, reweight, run_lists, variants
from tallyforge.operators.fill import Store
from tallyforge.sources import streams, tables, texts
from tallyforge.streaming.fills import running_cells


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def bins(spark, axis, values):
    return [r.b for r in numbers(spark, values).select(axis.bin(F.col("x")).alias("b")).collect()]


def test_regular_axis(spark):
    axis = Axis(100, 0, 1)
    assert bins(spark, axis, [-0.1, 0.0, 0.1, 0.999, 1.0, 1.1, math.inf, -math.inf, math.nan, None]) == [0, 1, 11, 100, 101, 101, 101, 0, 101, 1]
    with pytest.raises(ValueError):
        Axis(0, 0, 1)


def test_bins_come_from_the_width(spark):
    axis = Axis(60, -math.pi, math.pi)
    edges = [axis.low + i * axis.width for i in range(60)]
    assert bins(spark, axis, edges) == [1 + math.floor((e - axis.low) / axis.width) for e in edges]


def test_variable_axis(spark):
    axis = VariableAxis([1, 2, 4, 8, 16])
    assert bins(spark, axis, [0.5, 1, 1.1, 2, 4, 15, 16, 99, math.nan]) == [0, 1, 1, 2, 3, 4, 5, 5, 5]
    assert axis.high == 16 and VariableAxis.log_bins(3, 1, 1000).edges == pytest.approx([1, 10, 100, 1000])
    with pytest.raises(ValueError):
        VariableAxis([1, 1])


def test_integrals(spark):
    events = numbers(spark, [1, 1.1, 4, 8, 9, 10, 11, 15])
    axis = VariableAxis([1, 2, 4, 8, 16])
    x = F.col("x")
    store = Store().h1("a", axis, x).h2("b", axis, x, axis, x).h3("c", axis, x, axis, x, axis, x)
    got = results.integral(store.run(events), {"a": [4], "b": [4, 4], "c": [4, 4, 4]}).collect()
    assert {(r.path, r.integral, r.entries) for r in got} == {("a", 8.0, 8), ("b", 8.0, 8), ("c", 8.0, 8)}


def test_store_paths(spark):
    s = Store()
    s("test1/").h1("goo", Axis(2, 0, 1), F.col("x"))
    assert s.find("test1/goo", "H1") and s.find("test1/goo", "H2") is None and s.find("x", "H1") is None
    assert s.list() == ["test1/goo"]
    with pytest.raises(TypeError):
        s.h1("test1/goo", Axis(3, 0, 1), F.col("x"))


def test_sub_stores_inherit_weights(spark):
    s = Store("", 2.0)
    s("a/").mul_weight(3.0).h1("h", Axis(1, 0, 1), F.col("x"))
    s.h1("h", Axis(1, 0, 1), F.col("x"), weight=F.lit(0.5))
    got = {r.path: (r.sumw, r.sumw2, r.entries) for r in s.run(numbers(spark, [0.5, 0.6])).collect()}
    assert got == {"a/h": (12.0, 72.0, 2), "h": (2.0, 2.0, 2)}


def test_plans_agree(spark):
    rng = random.Random(1)
    events = numbers(spark, [rng.random() for _ in range(500)])
    s = Store("p/", F.col("x"))
    for i in range(5):
        s.h1(f"h{i}", Axis(4 + i, 0, 1), F.col("x"), where=F.col("x") > i / 10).passed("c", f"cut{i}", F.col("x") > i / 10)
    key = lambda r: (r.path, r.kind, r.bx, r.by, r.bz, r.cut, r.ordinal, r.entries, round(r.sumw, 9), round(r.sumw2, 9))
    s.h2("two", Axis(3, 0, 1), F.col("x"), VariableAxis([0, 0.2, 2]), F.col("x"), weight=F.lit(2.0)).h3("three", Axis(2, 0, 1), F.col("x"), Axis(3, 0, 2), F.col("x"), Axis(4, 0, 1), F.col("x"))
    s.h1("h0", Axis(4, 0, 1), F.col("x") / 2, weight=F.lit(3.0))
    s(F.when(F.col("x") > 0.5, "high").otherwise("low"), "/").h1("h", Axis(2, 0, 1), F.col("x")).passed("c", "cut")
    rows = lambda df: sorted(map(str, map(key, df.collect())))
    assert rows(s.run(events, "once")) == rows(s.run(events, "union"))
    keyed = events.withColumn("cell", F.floor(F.col("x") * 3))
    with_key = lambda r: (r.cell, *key(r))
    both = [sorted(map(str, map(with_key, s.run(keyed, plan, ["cell"]).collect()))) for plan in ("once", "union")]
    assert both[0] == both[1] and len(both[0]) > len(rows(s.run(events, "once")))


def test_merge_in_any_order(spark):
    events = numbers(spark, [i / 10 for i in range(10)])
    fill = lambda df: Store().h1("h", Axis(3, 0, 1), F.col("x")).run(df)
    a, b, c = (fill(events.where(F.floor(F.col("x") * 10) % 3 == i)) for i in range(3))
    rows = lambda df: sorted((r.bx, r.sumw, r.entries) for r in df.collect())
    assert rows(results.merge(results.merge(a, b), c)) == rows(results.merge(a, results.merge(c, b))) == rows(fill(events))
    with pytest.raises(TypeError):
        results.check_axes({"h": ("H1", Axis(3, 0, 1))}, {"h": ("H1", Axis(4, 0, 1))})


def test_scaled_entries_are_cut(spark):
    cells = Store().h1("h", Axis(1, 0, 1), F.col("x")).run(numbers(spark, [0.5] * 5))
    row = results.scale(cells, 0.5).first()
    assert (row.sumw, row.sumw2, row.entries) == (2.5, 1.25, 2)


def test_dense(spark):
    cells = Store().h2("h", Axis(2, 0, 2), F.col("x"), Axis(3, 0, 3), F.col("x")).run(numbers(spark, [0.5, 1.5, 9]))
    data = results.dense(cells, 2, 3).first()["data"]
    assert len(data) == 20 and data[1 + 4 * 1] == 1 and data[2 + 4 * 2] == 1 and data[3 + 4 * 4] == 1 and sum(data) == 3


def test_empty_cut_flow(spark):
    flow = results.ordered_cut_flow(Store().passed("c", "a", F.col("x") > 5).run(numbers(spark, [1])), "c", ["a", "b"]).orderBy("ordinal").collect()
    assert [(r.cut, r.sumw, r.entries) for r in flow] == [("a", 0.0, 0), ("b", 0.0, 0)]


def test_fan_out_is_separate_runs(spark):
    events = numbers(spark, [1, 2, 3])
    rows = variants.fan_out(events, {"big": F.col("x") > 1.5}, {"up": {"x": F.col("x") * 2}})
    got = sorted((r.variant, r.x) for r in rows.collect())
    assert got == sorted([("", 1), ("", 2), ("", 3), ("channel/big/", 2), ("channel/big/", 3), ("systematic/up/", 2), ("systematic/up/", 4), ("systematic/up/", 6), ("systematic/up/channel/big/", 2), ("systematic/up/channel/big/", 4), ("systematic/up/channel/big/", 6)])


def test_an_emptied_bin_is_a_shift(spark):
    rows = variants.fan_out(numbers(spark, [0.5, 1.5, 1.5]), None, {"up": {"x": F.col("x") + 1}, "same": {"x": F.col("x") + 0}})
    cells = Store(F.col("variant")).h1("a", Axis(3, 0, 3), F.col("x")).run(rows)
    alone = Store().h1("b", Axis(3, 0, 3), F.col("x")).run(numbers(spark, [0.5]))
    shifts = variants.shifted(cells.unionByName(alone))
    want = [("a", 1, "same", 0.0), ("a", 1, "up", -1.0), ("a", 2, "same", 0.0), ("a", 2, "up", -1.0), ("a", 3, "up", 2.0)]
    assert sorted(map(tuple, shifts.collect())) == want
    errors = results.systematic_error(shifts, ["path", "bx"])
    assert sorted(map(tuple, errors.collect())) == [("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 2.0)]


def test_skim_is_once(spark):
    events = spark.createDataFrame([(i, float(i)) for i in range(4)], "k int, x double")
    rows = variants.fan_out(events, None, {"up": {"x": F.col("x") + 2}})
    assert sorted((r.k, r.x) for r in variants.skim(rows, F.col("x") >= 3, "k").collect()) == [(1, 3.0), (2, 4.0), (3, 3.0)]


def stream_rows(forward, first, meta):
    events = [(None, first * 1000 + i) for i in range(3)]
    return [(meta, None), *events] if forward else [*events, (meta, None)]


@pytest.mark.parametrize("order", [(True, True), (False, False), (True, False), (False, True)])
def test_events_find_their_metadata(spark, order):
    rows = []
    for segment, forward in enumerate(order):
        both = stream_rows(forward, 1, 1) + stream_rows(forward, 2, 2)
        rows += [(segment, i, forward, m, e) for i, (m, e) in enumerate(both)]
    df = spark.createDataFrame(rows, "segment int, pos int, forward boolean, md int, event int")
    got = blocks.with_metadata(df, ["segment"], ["pos"], "md", F.col("forward")).where("event is not null").collect()
    assert len(got) == 12 and all(r.event // 1000 == r.current for r in got)


def test_metadata_of_long_backward_segments(spark):
    """No frame ends with its segment: such a one is filled anew for each row."""
    rows = spark.range(3000).select("id", (F.col("id") % 2).alias("segment"), F.when(F.col("id") % 700 < 2, F.col("id")).alias("md"))
    got = blocks.with_metadata(rows, ["segment"], ["id"], "md", F.col("segment") == 0)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    for r in got.collect():
        at = r.id // 700 * 700 if r.segment == 0 else -(-(r.id - 1) // 700) * 700 + 1
        assert r.current == (at if at < 3000 else None)


def merge_input(spark):
    rows = [(0, i, i % 5, [i], i >= 5, 1.5, "t", [i, i], i > 2) for i in range(10)]
    return spark.createDataFrame(rows, "segment int, pos int, run int, period array<int>, simulation boolean, efficiency double, tags string, comments array<int>, error boolean")


HOW = {"run": "drop", "period": "union", "efficiency": "multiply", "tags": "add", "comments": "append", "error": "and"}


def test_merging_blocks(spark):
    got = blocks.merge_per(merge_input(spark), "simulation", ["segment"], "pos", HOW).orderBy("pos").collect()
    assert [(r.simulation, r.merged, r.period, r.tags, r.run) for r in got] == [(False, 5, [0, 1, 2, 3, 4], "ttttt", 0), (True, 5, [5, 6, 7, 8, 9], "ttttt", 0)]
    assert got[0].comments == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4] and got[0].error is False and got[1].error is True
    assert got[0].efficiency == pytest.approx(1.5**5)


def test_blocks_that_differ_dont_merge(spark):
    with pytest.raises(Exception, match="blocks differ in simulation"):
        blocks.merge(merge_input(spark), ["segment"], "pos", HOW).collect()


def test_strategies_from_the_schema(spark):
    df = blocks.annotated(merge_input(spark).select("run", "period"), run="add", period="union")
    assert blocks.strategies(df.schema) == {"run": "add", "period": "union"}
    with pytest.raises(blocks.MergeError):
        blocks.strategies(blocks.annotated(df, period="add").schema)
    with pytest.raises(blocks.MergeError):
        blocks.strategies(blocks.annotated(df, run="no such").schema)


def test_absent_fields_read_as_defaults(spark):
    df = spark.createDataFrame([(0, 0, 2.0, None), (0, 1, None, None)], "segment int, pos int, efficiency double, error boolean")
    row = blocks.merge(df, ["segment"], "pos", {"efficiency": "multiply", "error": "and"}).first()
    assert row.efficiency == 0.0 and row.error is None


def test_split_refuses_several_values(spark, tmp_path):
    df = spark.createDataFrame([([1],), ([2],)], "run array<int>")
    blocks.split_per(df.withColumn("n", F.lit(0)), "run", str(tmp_path / "ok"))
    assert sorted(p.name for p in (tmp_path / "ok").glob("run=*")) == ["run=1", "run=2"]
    with pytest.raises(blocks.MergeError):
        blocks.split_per(spark.createDataFrame([([1, 2],)], "run array<int>"), "run", str(tmp_path / "no"))


def test_overlapping_ranges_pass(spark):
    ranges = spark.createDataFrame([(1, 1, 100), (1, 5, 6)], "run int, lo int, hi int")
    events = spark.createDataFrame([(1, 50), (1, 101), (2, 50)], "run int, lb int")
    for rows in (None, 10**9):
        assert [tuple(r) for r in run_lists.passing(events, ranges, "run", "lb", rows).collect()] == [(1, 50)]


def test_run_lists_from_text_and_xml(spark, tmp_path):
    (tmp_path / "list").write_text("180710 699 711\n180710 720 721\n5 1 2\n")
    got = texts.run_list(spark, str(tmp_path / "list"))
    (tmp_path / "list.xml").write_text(texts.run_list_to_xml(got))
    back = texts.run_list_from_xml(spark, str(tmp_path / "list.xml"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, got.collect())) == [(5, 1, 2), (180710, 699, 711), (180710, 720, 721)]


def test_sets_and_cross_sections(spark, tmp_path):
    (tmp_path / "xs").write_text("# comment\n107280 1 1\n107281 2 3 0.5 # more\n")
    assert sorted(map(tuple, texts.cross_sections(spark, str(tmp_path / "xs")).collect())) == [("107280", 1.0), ("107281", 3.0)]
    (tmp_path / "sets").write_text(":top:Top quarks\n1 2.0 3.0 0.5 a b c d\n2 x 3.0 0.5 2.0 y z\n\n#no\n:qcd:QCD\n3 a b c d 3.0 0.5 2.0 e\n")
    got = sorted(map(tuple, texts.sample_sets(spark, str(tmp_path / "sets")).collect()))
    assert got == [("qcd", "QCD", "3", 2.0, 3.0, 0.5), ("top", "Top quarks", "1", 2.0, 3.0, 0.5), ("top", "Top quarks", "2", 2.0, 3.0, 0.5)]


def test_reweighting(spark):
    cells = spark.createDataFrame([("a", 2.0, 4.0, 3), ("b", 1.0, 1.0, 1), ("d", 1.0, 1.0, 1)], "sample string, sumw double, sumw2 double, entries long")
    samples = spark.createDataFrame([("a", True, 10.0, 1), ("b", True, 1.0, 1), ("d", False, 1.0, 1)], "sample string, simulation boolean, sum_w double, event_count long")
    weights = reweight.sample_weights(samples, spark.createDataFrame([("a", 5.0)], "sample string, xs double"), 3.0)
    out = reweight.reweight(cells, weights)
    assert {r.sample: (r.sumw, r.sumw2, r.entries) for r in out.collect()} == {"a": (3.0, 9.0, 4), "b": (0.0, 0.0, 0), "d": (1.0, 1.0, 1)}
    with pytest.raises(ValueError):
        reweight.reweight(out, weights)
    with pytest.raises(Exception, match="several weights of sample"):
        reweight.reweight(cells, weights.union(weights)).collect()


def test_vectors(spark):
    v = lorentz.from_pt_eta_phi_m(F.lit(3.0), F.lit(0.5), F.lit(1.0), F.lit(2.0))
    null = lorentz.vector(0.0, 0.0, 0.0, 0.0)
    row = spark.range(1).select(lorentz.pt(v), lorentz.eta(v), lorentz.phi(v), lorentz.m(v), lorentz.theta(null), lorentz.eta(null), lorentz.m(lorentz.vector(3.0, 0.0, 0.0, 0.0)), lorentz.wrap_phi(F.lit(math.pi))).first()
    assert list(row)[:4] == pytest.approx([3.0, 0.5, 1.0, 2.0]) and row[4] == 0.0 and row[5] is None and row[6] == -3.0 and row[7] == pytest.approx(-math.pi)


def test_objects(spark):
    df = spark.createDataFrame([([(1, 5.0), (2, 9.0), (3, 9.0)],), ([],)], "o array<struct<i:int,p:double>>")
    o, p = F.col("o"), lambda x: x["p"]
    got = df.select(
        F.size(objects.remove_if(o, lambda x: x["p"] > 6)).alias("n"), objects.max_element(o, p)["i"].alias("m"), objects.leading(o, p)["p"].alias("l"),
        objects.any_of(o, lambda x: x["p"] > 6).alias("any"), objects.all_of(o, lambda x: x["p"] > 6).alias("all"), objects.str_printf("%d-%s!", F.lit(1), F.lit("x"), F.lit("y")).alias("s"),
    ).collect()
    assert [tuple(r) for r in got] == [(1, 2, 9.0, True, False, "1-x!y"), (0, None, None, False, True, "1-x!y")]


def test_statistics_skip_sentinels(spark):
    row = inspect.field_stats(numbers(spark, [-999, -5, -3, -3, None])).first()
    assert (row.n, row.total, row["min"], row["max"], row.min1, row.max1) == (3, -11.0, -5.0, -3.0, -3.0, -5.0)


def test_limit_comes_before_selection(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "i int, odd int")
    assert [r.i for r in inspect.dump(df, ["i"], 2, 3, odd="1").collect()] == [3]


def test_columns_of_other_sizes_are_skipped(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([([1, 2], [3.0, 4.0]), ([1], [3.0, 4.0])], "a array<int>, b array<double>")
    kinds = {"a": T.IntegerType(), "b": T.DoubleType()}
    got = [r.z for r in df.select(reshape.zipped({"a": F.col("a"), "b": F.col("b")}, ["a", "b"], kinds).alias("z")).collect()]
    assert [[tuple(x) for x in z] for z in got] == [[(1, 3.0), (2, 4.0)], [(1, None)]]
    with pytest.raises(TypeError):
        reshape.converted(F.col("a"), T.StringType(), T.IntegerType())


def test_flattening(spark):
    df = spark.createDataFrame([((1.0, None), [(2.0, "t")], "s")], "p struct<x:double,y:double>, o array<struct<v:double,t:string>>, s string")
    row = reshape.flatten(df).first()
    assert row.asDict() == {"p_x": 1.0, "p_y": -999.0, "o_v": [2.0]}


def test_inputs_named_twice(spark):
    with pytest.raises(ValueError):
        tables.read_events(spark, ["a", "a"])


def test_results_on_disk(spark, tmp_path):
    cells = Store().h1("h", Axis(2, 0, 1), F.col("x")).run(numbers(spark, [0.5]))
    tables.write_results(cells, str(tmp_path / "r"))
    assert tables.read_results(spark, str(tmp_path / "r"), "H1").count() == 1
    assert tables.read_results(spark, str(tmp_path / "r"), "H2").count() == 0


def test_native_streams(spark, tmp_path):
    from google.protobuf.timestamp_pb2 import Timestamp
    from google.protobuf.wrappers_pb2 import Int64Value

    messages = []
    for block in (1, 2):
        messages += [Timestamp(seconds=block), *[Int64Value(value=block * 1000 + i) for i in range(5)]]
    for name, compression in (("plain", None), ("zlib", streams.ZLIB), ("gzip", streams.GZIP), ("snappy", streams.SNAPPY), ("lz4", streams.LZ4)):
        streams.write_stream(messages, str(tmp_path / name), {"google.protobuf.Timestamp"}, compression=compression)
    (tmp_path / "both").write_bytes((tmp_path / "zlib").read_bytes() + (tmp_path / "plain").read_bytes())
    got = streams.read_streams(spark, [str(tmp_path / n) for n in ("plain", "zlib", "gzip", "snappy", "lz4", "both")]).cache()
    assert got.count() == 7 * 12
    md = got.withColumn("md", F.when(F.col("is_metadata"), F.col("record")))
    events = blocks.with_metadata(md, ["path", "segment"], ["position"], "md").where("not is_metadata").collect()
    assert len(events) == 70
    for r in events:
        assert Int64Value.FromString(bytes(r.record)).value // 1000 == Timestamp.FromString(bytes(r.current)).seconds
    (tmp_path / "bad").write_bytes(b"no stream")
    with pytest.raises(Exception, match="no stream begins here"):
        streams.read_streams(spark, str(tmp_path / "bad")).count()


def test_stream_offsets(spark, tmp_path):
    """Blocks and metadata by offsets, forward and backward, and a file that wasn't closed."""
    from google.protobuf.timestamp_pb2 import Timestamp
    from google.protobuf.wrappers_pb2 import Int64Value

    def value(r):
        return Int64Value.FromString(bytes(r.record)).value

    for forward in (True, False):
        messages = []
        for block in range(3):
            own = [Int64Value(value=block * 1000 + i) for i in range(3000)]
            messages += [Timestamp(seconds=block), *own] if forward else [*own, Timestamp(seconds=block)]
        path = str(tmp_path / f"blocks-{forward}")
        streams.write_stream(messages, path, {"google.protobuf.Timestamp"}, forward)
        assert [s.footer > s.start for s in streams.segments(path)] == [True]
        got = streams.read_streams(spark, path, block=1).collect()
        assert sorted(value(r) for r in got if not r.is_metadata) == [1000 + i for i in range(3000)] and sum(r.is_metadata for r in got) == 1
        heads = streams.read_streams(spark, path, metadata_only=True).collect()
        assert [Timestamp.FromString(bytes(r.record)).seconds for r in heads] == [0, 1, 2]
        assert {(r.class_name, r["count"]) for r in streams.footers(spark, path).collect() if r.class_name} == {("google.protobuf.Timestamp", 3), ("google.protobuf.Int64Value", 9000)}
    raw = (tmp_path / "blocks-True").read_bytes()
    (tmp_path / "torn").write_bytes(raw[: len(raw) - 5])
    with pytest.raises(Exception, match="ends within a record|damaged footer"):
        streams.read_streams(spark, str(tmp_path / "torn")).count()


@pytest.mark.parametrize("compression", [streams.ZLIB, streams.SNAPPY, streams.LZ4])
def test_long_compressed_sections(tmp_path, compression):
    from google.protobuf.wrappers_pb2 import BytesValue

    rng = random.Random(2)
    messages = [BytesValue(value=bytes(rng.randrange(rng.choice([2, 256])) for _ in range(rng.randrange(3000))) * rng.randrange(1, 60)) for _ in range(40)]
    path = str(tmp_path / "long")
    streams.write_stream(messages, path, compression=compression)
    with open(path, "rb") as file:
        got = list(streams.records(streams._Source(file), path, 0))
    assert [BytesValue.FromString(r["record"]).value for r in got] == [m.value for m in messages]


def test_short_sections_are_not_read_again(tmp_path):
    """What is read of a file grows with it, however short its sections, and a footer's size needs no offsets."""
    from google.protobuf.timestamp_pb2 import Timestamp
    from google.protobuf.wrappers_pb2 import Int64Value

    class Counted(io.FileIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken += len(out)
            return out

    path = str(tmp_path / "short")
    streams.write_stream([m for i in range(2000) for m in (Timestamp(seconds=i), Int64Value(value=i))], path, {"google.protobuf.Timestamp"})
    with Counted(path) as file:
        got = list(streams.records(streams._Source(file), path, 0, internal=True, json=False))
        assert len(got) == 1 + 2 + 4 * 2000 + 1
        assert Counted.taken < 10 * os.path.getsize(path)


def test_records_as_json_and_rows():
    """As protobuf and pyarrow give them."""
    import pyarrow as pa
    from google.protobuf import json_format
    from pyspark.sql import types as T
    from tallyforge.sources import records

    inner = T.StructType().add("x", T.DoubleType()).add("t", T.ArrayType(T.StringType())).add("raw", T.BinaryType()).add("f", T.BooleanType())
    schema = T.StructType().add("k", T.LongType()).add("i", T.IntegerType()).add("o", inner).add("l", T.ArrayType(inner)).add("n", T.ArrayType(T.LongType()))
    one = {"x": float("nan"), "t": ["é😀\"\\\n", ""], "raw": b"\x00\xff", "f": False}
    rows = [
        {"k": -(2**63), "i": 0, "o": one, "l": [one, {"x": -0.0, "t": [], "raw": b"", "f": True}], "n": [1, 2**60]},
        {"k": None, "i": None, "o": None, "l": None, "n": None}, None,
        {"k": 1, "i": -7, "o": {"x": 1e300, "t": None, "raw": None, "f": None}, "l": [], "n": []},
    ]
    kind = pa.struct([("x", pa.float64()), ("t", pa.list_(pa.string())), ("raw", pa.binary()), ("f", pa.bool_())])
    column = pa.array(rows, pa.struct([("k", pa.int64()), ("i", pa.int32()), ("o", kind), ("l", pa.list_(kind)), ("n", pa.list_(pa.int64()))]))
    for part in (column, column.slice(1), column.slice(2, 0)):
        assert repr(records.rows_of(part)) == repr(part.to_pylist())
    classes = records.Classes()
    classes.add(records.descriptor("Event", schema))
    classes.names[202] = "Event"
    for row in filter(None, rows):
        raw = records.encoded(classes.of("Event")(), row)
        assert classes.json(202, raw) == json_format.MessageToJson(classes.of("Event").FromString(raw), preserving_proto_field_name=True, indent=None)


def test_schemas_of_records():
    from pyspark.sql import types as T
    from tallyforge.sources import records

    schema = T.StructType().add("a", T.LongType()).add("b", T.ArrayType(T.StructType().add("x", T.DoubleType()).add("t", T.ArrayType(T.StringType())))).add("c", T.StructType().add("d", T.BooleanType()))
    classes = records.Classes()
    classes.add(records.descriptor("Event", schema))
    assert records.schema_of(classes.of("Event").DESCRIPTOR) == schema
    raw = records.encoded(classes.of("Event")(), {"a": 5, "b": [{"x": 1.5, "t": ["p", "q"]}, {"x": None, "t": []}], "c": {"d": True}})
    back = classes.of("Event").FromString(raw)
    assert (back.a, back.b[0].x, list(back.b[0].t), back.b[1].HasField("x"), back.c.d) == (5, 1.5, ["p", "q"], False, True)
    with pytest.raises(TypeError):
        records.descriptor("Event", T.StructType().add("m", T.MapType(T.StringType(), T.LongType())))


def test_rounding():
    assert results.round_to_error(1234.5678, 12.3) == (1235.0, 12.0)
    assert results.round_to_error(1.23456, 0.0123) == (1.23, 0.01)
    assert results.round_to_error(0.00123, 3.0) == (0.001, 3.0)
    assert math.isnan(results.round_to_error(1.0, math.nan)[1])


def test_configuration(spark, tmp_path):
    from tallyforge.plans.configuration import Configuration, run
    from tallyforge.plans.processor import Processor

    class Own(Processor):
        def __init__(self, cut):
            self.cut = cut

        def process(self, store):
            store.passed("c", "all").passed("c", "high", F.col("x") > self.cut)

        def keep(self):
            return F.col("x") > self.cut

    class Setup(Configuration):
        def add_options(self, add):
            add("cut", "1")

        def new_processor(self):
            return Own(float(self.values["cut"]))

    numbers(spark, range(10)).withColumn("half", F.floor(F.col("x") / 5)).write.parquet(str(tmp_path / "in"))
    (tmp_path / "a.ini").write_text(f"[analysis]\ncut = 5\nresults = {tmp_path}/res\n")
    common = [str(tmp_path / "in"), "-c", str(tmp_path / "a.ini")]
    run(Setup(), [*common, "-o", str(tmp_path / "out"), "--split-per", "half", "--quiet"], spark)
    assert {r.cut: r.entries for r in tables.read_results(spark, str(tmp_path / "res")).collect()} == {"all": 10, "high": 4}
    assert sorted((r.x, r.half) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(6.0, 1), (7.0, 1), (8.0, 1), (9.0, 1)]
    done = run(Setup(), [*common, "--cut", "8", "-r", str(tmp_path / "other"), "-n", "9", "--order", "x"], spark)
    assert {r.cut: r.entries for r in done.results.collect()} == {"all": 9}
    (tmp_path / "bad.ini").write_text("[analysis]\nno = 1\n")
    with pytest.raises(ValueError):
        Setup().parse(["-c", str(tmp_path / "bad.ini")])
    with pytest.raises(FileNotFoundError):
        Setup().parse(["-c", str(tmp_path / "none.ini")])


def test_emitted_rows(spark):
    from tallyforge.plans.processor import Processor, analyse

    class Own(Processor):
        def process(self, store):
            store.passed("c", "all")

        def emit(self):
            return F.transform(F.sequence(F.lit(1), F.col("x").cast("int")), lambda i: F.struct(i.alias("i")))

    assert sorted(r.i for r in analyse(Own(), numbers(spark, [1, 2])).skim.collect()) == [1, 1, 2]


def test_fills_of_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(minutes=i), i / 10) for i in range(10)]
    spark.createDataFrame(rows, "ts timestamp, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x double").parquet(str(tmp_path / "in"))
    store = Store().h1("h", Axis(2, 0, 1), F.col("x"))
    q = running_cells(stream, store).writeStream.format("memory").queryName("cells").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.bx, r.entries) for r in spark.sql("select * from cells").collect()) == [(1, 5), (2, 5)]


def test_entry_points_need_no_session():
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True)


def test_the_library_stands_alone():
    """Only the entry point may know of the corpus operators."""
    import os
    import re

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tallyforge")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                assert not re.search(r"import.*\bllm\b", open(os.path.join(folder, name)).read()), name


def test_without_the_corpus_operators(tmp_path):
    """A copy without them imports, and has all other queries."""
    import os
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(repo, "tallyforge"), tmp_path / "tallyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; from tallyforge import catalog; assert e.queries().keys() == catalog.QUERIES.keys() == e.oracle_sql().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
