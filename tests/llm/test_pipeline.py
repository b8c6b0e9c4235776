"""The pipeline against plain Python over the smallest table."""

import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tallyforge.llm import quality_model, secret_scan
from tallyforge.llm.shared import table

from test_llm import base_spans, brute_rules, encoded, shingles


def linked(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def masked(text):
    out, at = "", 0
    for a, _, b in base_spans(text):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = {r.doc_id for r in quality_model.score(docs, quality_model.train(docs, labels)).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in texts.items() if i in good and brute_rules(t)[-1]}
    assert 0 < len(kept) < len(texts)
    group = linked({i: shingles(t, 5) for i, t in kept.items()})
    kept = {i: masked(t) for i, t in kept.items() if group[i] == i}
    want = {}
    for i, t in kept.items():
        ids = np.array([*encoded("byte_bpe_50k.json", t), 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [ids[:first], *[ids[k : k + 1024] for k in range(first, len(ids), 1024)]]
        want |= {(i, k): (len(c), zlib.crc32(c.tobytes()), c.tolist()) for k, c in enumerate(cuts)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32, r.ids) for r in got} == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(len(ids) for _, _, ids in want.values()) / 1024 + 10


def test_stages_of_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns with the operators' own
    names: no stage fails, each keeps the columns, and clean rows stay."""
    clean = table(spark, sf_dir, "documents").where("doc_id < 60").collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [tuple(r) for r in clean] + [tuple(clean[0])] * 3 + [(None, clean[1].text, None, None, None), (None, None, None, None, None), (900, "", "en", "s", 0), (901, None, "en", None, None), (902, "long " * 300_000, "en", "s", 1), (903, "token=abcdef12 " + clean[2].text, None, None, None), (1, clean[5].text + " x", "en", "s", 3)]
    names = ("gone", "row", "clash", "node", "score", "kept", "key", "twice", "hash", "span", "live", "ids", "part", "id", "n", "to")
    docs = spark.createDataFrame(rows, schema).withColumns({n: F.lit(n) for n in names}).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert all(r[n] == n for r in docs.collect() for n in names), name
        assert {r.doc_id for r in docs.collect()} & set(range(60)), name
    assert all("token=abcdef12" not in r.text for r in docs.collect())
    assert len([r for r in docs.collect() if r.doc_id == clean[0].doc_id]) <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near dedup", "secret scan", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert all(secret_scan.KINDS.index(k) == i for i, k in enumerate(("assign", "access", "hex")))


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    table(spark, sf_dir, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, sf_dir, "labels").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
