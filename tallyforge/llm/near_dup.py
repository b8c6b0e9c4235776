"""Near-duplicate detection on word shingles: SetSketch registers, banded, estimated jointly
by likelihood, then verified on full sets.

1. ``sketches``: one pass over the texts gives each document's set size, a 128-bit
   fingerprint of its set and its registers; written once to the shared folder.
2. Documents of one fingerprint have equal sets (two other sets share one with a probability of
   about 2**-128); the smallest id stands for them.
3. Bands of registers put representatives into buckets. Buckets of one are dropped.
4. First round: a bucket's members are paired as a tree, each with the smallest id of its block of
   ``BLOCK`` members, those with the smallest of their block, and so on: as many pairs as members,
   and no id in more than ``BLOCK`` of a bucket's at each level. Second round: whatever in a bucket
   isn't yet in the same component is compared by registers and then by sets of 32-bit hashes,
   in blocks of bounded size dealt over the cluster; a bucket's largest component isn't
   compared with itself. Only pairs that pass leave a block, so no bucket's pairs are ever emitted.
5. Pairs are confirmed on full sets of 64-bit shingle hashes.
6. Connected components by hooking each node to its smallest neighbour and contracting.

Every step is keyed by bucket, pair or document. Joins on a key that a large part of the rows may
hold (a bucket, a set, a component) broadcast its few hot keys (see ``skew``).

Defined results: a null or white text has an empty set and is linked with nothing; a row with
a null id is returned unlinked, component null, kept; rows that repeat an id with one set are one
node, those that repeat it with different sets are nodes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsketch as S
from .shared import in_python, save
from .skew import heaviest, join_keys
from .words import U64, chunks, give_back, hashes, mix, split

BLOCK = 256
BROADCAST = 2_000_000
_STEP = [U64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def lower_ascii(raw: bytes) -> bytes:
    return raw.lower()


def shingle_sets(word_hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and where each text's begin."""
    n, counts = len(word_hashes), np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    run = np.zeros(n, U64)
    padded = np.concatenate([word_hashes, np.zeros(size, U64)])
    for i in range(size):
        run = mix(run * U64(31) + padded[i : i + n] * _STEP[i % 5])
    left = first[1:][owner] - np.arange(n)
    whole = left >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    for d in short:
        h = U64(0x51ED270B)
        for w in word_hashes[first[d] : first[d + 1]]:
            h = mix(np.array([h * U64(131) + w]))[0]
        run[first[d]], whole[first[d]] = h, True
    own, run = owner[whole], run[whole]
    order = np.lexsort((run, own))
    own, run = own[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (own[1:] != own[:-1]) | (run[1:] != run[:-1])
    own, run = own[new], run[new]
    return run, np.searchsorted(own, np.arange(len(counts) + 1))


def _sets(batches: Iterator[pa.RecordBatch], size: int, step: int):
    """For runs of rows: (first, last, the batch, shingle hashes, offsets)."""
    for batch in batches:
        for a, b, raw, offsets in chunks(batch.column("text").to_pylist(), step):
            _, start, end, first = split(lower_ascii(raw), offsets)
            with np.errstate(over="ignore"):
                elements, at = shingle_sets(hashes(np.frombuffer(lower_ascii(raw), np.uint8), start, end), first, size)
            yield a, b, batch, elements, at
    give_back()


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint) and registers (bytes) of each document."""

    def run(batches):
        for a, b, batch, elements, at in _sets(batches, size, 1 << 21):
            with np.errstate(over="ignore"):
                registers = S.sketch(elements, at)
                sums = [np.concatenate([[U64(0)], np.cumsum(mix(elements * k))]) for k in _STEP[:2]]
            f1, f2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(at)), pa.array(f1), pa.array(f2), _binary(registers)],
                ["doc_id", "n_shingles", "f1", "f2", "registers"],
            )

    return in_python(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, registers binary")


def _registers(column) -> np.ndarray:
    """The rows of a binary column of registers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, S.REGISTERS), np.uint16)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint16).reshape(len(column), S.REGISTERS)


def _memberships(reps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                keys = S.band_keys(_registers(batch.column("registers")))
            ids = batch.column("id").to_numpy()
            for i in range(0, len(ids), 1000):
                own = keys[i : i + 1000]
                bands = np.tile(np.arange(S.BANDS, dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat(ids[i : i + 1000], S.BANDS)), pa.array(bands)], ["key", "id", "band"])

    return in_python(reps.select("id", "registers"), run, "key long, id long, band int")


def _estimated(pairs: DataFrame, least: float) -> DataFrame:
    """Of (a, b, na, nb, ra, rb), those whose joint estimate reaches ``least``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = S.similarity(_registers(batch.column("ra")), _registers(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                keep = pa.array(got >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return in_python(pairs.select("a", "b", "na", "nb", "ra", "rb"), run, "a long, b long")


def _tree_pairs(members: DataFrame, most: int) -> DataFrame:
    """(a, b): pairs that join each bucket of ``members`` (key, id, count, first) into a tree, of which
    the largest bucket has ``most``."""
    pairs = members.where(f"count <= {BLOCK} and id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    level = members.where(f"count > {BLOCK}").select("key", "id", "count")
    most = most if most > BLOCK else 1
    while most > 1:
        blocks = F.ceil(F.col("count") / BLOCK)
        dealt = level.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id", "key"), blocks)})
        heads = save(dealt.groupBy("key", "block", "blocks").agg(F.min("id").alias("head")), "heads")
        pairs = pairs.union(dealt.join(heads.drop("blocks"), ["key", "block"]).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")))
        level, most = heads.select("key", F.col("head").alias("id"), F.col("blocks").alias("count")), -(-most // BLOCK)
    return pairs.distinct()


def _block_pairs(members: DataFrame, least: float, percent: int) -> DataFrame:
    """Likely links (a, b) across hubs, from members (key, band, id, hub, n, registers, set, all, main,
    of_main): ``main`` is the hub most of the bucket's members belong to, ``of_main`` how many.

    The members of ``main`` and the others are dealt into blocks of about ``BLOCK`` by a hash of the
    id. Each block of others meets each block of either kind in a group of its own. A pair is looked
    at in the first band that it shares; if its estimate passes, its sets of 32-bit hashes decide
    whether it leaves the block."""
    in_main = F.col("hub") == F.col("main")
    mains, others = F.ceil(F.col("of_main") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("of_main")) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), F.when(in_main, mains).otherwise(others)).cast("int")
    place = lambda main, i, j, left, right: F.struct(main.alias("main"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    yes, no, me = F.lit(True), F.lit(False), F.col("own")
    to_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: place(yes, k, me, no, yes))
    from_others = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: place(yes, me, k, yes, no)),
        F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: place(no, F.least(k, me), F.greatest(k, me), me <= k, me >= k)),
    )
    dealt = members.withColumns({"mains": mains, "others": others, "own": own}).withColumn("place", F.explode(F.when(in_main, to_others).otherwise(from_others)))

    def run(table: pa.Table) -> pa.Table:
        ids, hubs, sizes = (table.column(c).to_numpy() for c in ("id", "hub", "n"))
        registers, band = _registers(table.column("registers")), table.column("band")[0].as_py()
        left, right = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        itself = len(left) == len(right) and (left == right).all()
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in left:
            there = right[(hubs[right] != hubs[x]) & ((ids[right] > ids[x]) | (not itself))]
            there = there[np.minimum(sizes[x], sizes[there]) >= least * np.maximum(sizes[x], sizes[there])]
            if len(there):
                there = there[(registers[there] == registers[x]).mean(axis=1) >= least - 0.15]
                xs.append(np.full(len(there), x))
                ys.append(there)
        x, y = np.concatenate(xs), np.concatenate(ys)
        good = np.zeros(len(x), bool)
        for k in range(0, len(x), 4096):
            part = slice(k, k + 4096)
            rx, ry = registers[x[part]], registers[y[part]]
            same = (rx == ry)[:, : S.BANDS * S.ROWS].reshape(-1, S.BANDS, S.ROWS).all(axis=2)
            good[part] = (same.argmax(axis=1) == band) & (S.similarity(rx, ry, sizes[x[part]], sizes[y[part]]) >= least)
        x, y = x[good], y[good]
        sets = table.column("set").combine_chunks()
        low = {k: np.frombuffer(sets[k].as_buffer(), np.uint32) for k in np.unique(np.concatenate([x, y])).tolist()}
        near = np.zeros(len(x), bool)
        for k, (u, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            p, q = low[u], low[v]
            both = len(np.intersect1d(p, q, assume_unique=True))
            near[k] = 100 * both >= (percent - 1) * (len(p) + len(q) - both)
        x, y = ids[x[near]], ids[y[near]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    group = dealt.select("key", "place.main", "place.i", "place.j", "place.left", "place.right", "band", "id", "hub", "n", "registers", "set")
    return group.groupBy("key", "main", "i", "j").applyInArrow(run, "a long, b long")


def _sets_of(ids: DataFrame, docs: DataFrame, size: int, bits: int = 64) -> DataFrame:
    """(id, set): sorted distinct shingle hashes, as bytes, of the documents in ``ids`` (id).

    Up to ``BROADCAST`` ids are sent to where the texts are; more than that, and the texts
    that fit are shuffled."""
    ids = save(ids.distinct(), "ids")
    few = ids.count() <= BROADCAST

    def whole(batches):
        for a, b, batch, elements, at in _sets(batches, size, 1 << 20):
            if bits == 32:
                parts = [np.unique(elements[at[k] : at[k + 1]].astype(np.uint32)) for k in range(b - a)]
                elements, at = np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])
            offsets = pa.py_buffer((at * (bits // 8)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, b - a), pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, pa.py_buffer(np.ascontiguousarray(elements))])],
                ["id", "set"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return save(in_python(texts, whole, "id long, set binary"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A & B| >= percent * |A | B|, on full shingle sets."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    sets = _sets_of(ids, docs, size)
    joined = pairs.join(sets.withColumnsRenamed({"id": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "sb"}), "b")

    def test(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return in_python(joined.select("a", "b", "sa", "sb"), test, "a long, b long")


def _followed(labels: DataFrame, others: DataFrame) -> DataFrame | None:
    """``labels`` (id, root, ...) with each root replaced by its own root in ``others``; None if that
    changes nothing."""
    seen = labels.groupBy("root").agg(F.count("*").alias("held"))
    moved = seen.join(others.where("id <> root").select(F.col("id").alias("root"), F.col("root").alias("to")), "root")
    if moved.isEmpty():
        return None
    out = join_keys(labels, save(moved, "moved"), ["root"], "held", "left")
    return out.select(*[F.coalesce("to", c).alias(c) if c == "root" else c for c in labels.columns])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for ids with an edge.

    In each round every node hooks to its smallest neighbour if that is smaller, pointers are doubled
    until all lead to roots, and edges are contracted to roots. A root that nothing hooked to has a
    neighbour that hooked to something smaller, so it hooks in the next round: two rounds leave at
    most half of the nodes, and each doubles pointers as often as the logarithm of its deepest tree.
    A chain in order is one round. ``edges`` is read several times; tables of each round go through
    the shared folder."""
    edge, found = edges.select("a", "b").where("a <> b"), None
    while found is None or not edge.isEmpty():
        both = edge.union(edge.select("b", "a"))
        labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"), F.count("*").alias("links"))
        labels = save(labels.withColumn("root", F.least("id", "root")), "labels")
        while (further := _followed(labels, labels)) is not None:
            labels = save(further, "labels")
        if found is None:
            found = labels.drop("links")
        else:
            moved = _followed(found, labels)
            found = found if moved is None else save(moved, "found")
        top = heaviest(labels, "links")
        for end in ("a", "b"):
            edge = join_keys(edge, labels.select(F.col("id").alias(end), F.col("root").alias(f"to_{end}"), "links"), [end], "links", top=top).drop("links")
        edge = save(edge.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct(), "edges")
    return found.withColumnRenamed("root", "component")


def _clashing_ids(base: DataFrame) -> DataFrame | None:
    """(clash): the ids that have rows of different sets; None if there are none."""
    own = ("f1", "f2", "n_shingles")
    ids = base.where("doc_id is not null").groupBy(F.col("doc_id").alias("clash")).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in own for f in (F.min, F.max)])
    clash = save(ids.where(" or ".join(f"min_{c} <> max_{c}" for c in own)).select("clash"), "clash")
    return None if clash.isEmpty() else clash


def _rows(docs: DataFrame, clash: DataFrame | None) -> DataFrame:
    """(row, node): a row's node is its id, or a hash of id and text where the id clashes."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("node"))
    if clash is None:
        return row
    few = clash.count() <= BROADCAST
    known = row.join(F.broadcast(clash) if few else clash, F.col("node") == F.col("clash"), "left")
    return known.select("row", F.when(F.col("clash").isNotNull(), F.xxhash64("node", "row.text")).otherwise(F.col("node")).alias("node"))


def _placed(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, id, n_shingles, part, component) of each row of ``docs``, and the ids that clash: part
    is the least node of its component, component the least id."""
    base = save(sketches(docs, size), "sketches")
    clash = _clashing_ids(base)
    if clash is None:
        return _linked(docs, base, size, percent).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("id"), "n_shingles", "part", F.col("part").alias("component")), None
    rows = _rows(docs, clash)
    nodes = rows.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text"))
    placed = save(_linked(nodes, save(sketches(nodes, size), "sketches"), size, percent), "placed")
    own = rows.select(F.col("node").alias("doc_id"), F.col("row.doc_id").cast("long").alias("own")).where("doc_id <> own").distinct()
    placed = placed.join(own, "doc_id", "left").withColumn("id", F.coalesce("own", "doc_id"))
    least = placed.where("id is not null").groupBy("part").agg(F.min("id").alias("component"))
    return save(placed.join(least, "part", "left").select(F.col("doc_id").alias("node"), "id", "n_shingles", "part", "component"), "placed"), clash


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Documents with ``100 * intersection >= percent * union`` of their ``size``-word shingle
    sets (ASCII letters lower-cased) are linked; a component's smallest id is kept."""
    placed, _ = _placed(docs, size, percent)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return placed.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def _linked(docs: DataFrame, base: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and part (the least id of its component) of each row of ``base``, the
    sketches of ``docs``, in which an id has one set."""
    least = S.floor_for(percent / 100)
    own = ["f1", "f2", "n_shingles"]
    # equal sets have equal registers, so any of them will do
    sets = base.where("n_shingles > 0 and doc_id is not null").groupBy(*own).agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.first("registers").alias("registers"))
    sets = save(sets, "alike")
    reps = sets.select("id", F.col("n_shingles").alias("n"), "registers")

    member = save(_memberships(reps), "memberships")
    buckets = save(member.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("count")).where("count > 1"), "buckets")
    top = heaviest(buckets, "count")
    if not top[0]:
        return base.select("doc_id", "n_shingles", F.col("doc_id").alias("part")) if sets.where("rows > 1").isEmpty() else _by_set(base, sets, None)
    members = save(join_keys(member, buckets, ["key"], "count", top=top), "members")
    stars = _tree_pairs(members, top[0])
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    likely = save(_estimated(stars.join(side("a"), "a").join(side("b"), "b"), least), "stars")
    stars = save(_verified(likely, docs, size, percent), "links")

    hubs = components(stars).withColumnRenamed("component", "hub")
    labelled = save(members.join(hubs, "id", "left").select("key", "band", "id", F.coalesce("hub", "id").alias("hub")), "labelled")
    by_hub = labelled.groupBy("key", "hub").agg(F.count("*").alias("n"))
    several = by_hub.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("of_main"), F.max_by("hub", "n").alias("main")).where("all > of_main")
    several = save(several, "several")
    top = heaviest(several, "all")
    if not top[0]:
        return _by_set(base, sets, hubs.withColumnRenamed("hub", "component"))
    rest = save(join_keys(labelled, several, ["key"], "all", top=top), "rest")
    low = _sets_of(rest.select("id"), docs, size, bits=32)
    pairs = save(_block_pairs(rest.join(reps, "id").join(low.dropDuplicates(["id"]), "id"), least, percent), "pairs")
    more = save(_verified(pairs, docs, size, percent), "links")
    return _by_set(base, sets, hubs.withColumnRenamed("hub", "component") if more.isEmpty() else components(stars.union(more)))


def _by_set(base: DataFrame, sets: DataFrame, found: DataFrame | None) -> DataFrame:
    """doc_id, n_shingles and part of each row of ``base``: the component in ``found`` (id, component)
    of the document that stands for its set."""
    own = ["f1", "f2", "n_shingles"]
    part = sets.select(*own, "rows", F.col("id").alias("component")) if found is None else sets.join(found, "id", "left").select(*own, "rows", F.coalesce("component", "id").alias("component"))
    placed = join_keys(base.drop("registers"), save(part, "of-set"), own, "rows", "left")
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("part"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns: of each component the one with
    the smallest id. Of rows that repeat a kept id with one set, one stays: the first by the hash
    of its text. Rows of one id whose sets aren't linked are judged each."""
    placed, clash = _placed(docs, size, percent)
    if clash is None:
        gone = placed.where("id <> component").select(F.col("node").alias("gone"))
    else:
        first = placed.where("node is not null").groupBy("part").agg(F.min(F.struct("id", "node")).alias("first"))
        gone = placed.join(first, "part").where(F.col("node") != F.col("first.node")).select(F.col("node").alias("gone"))
    gone = save(gone.distinct(), "gone")
    few = gone.count() <= BROADCAST
    every = _rows(docs, clash)
    left = every.join(F.broadcast(gone) if few else gone, F.col("node") == F.col("gone"), "left_anti")
    twice = save(every.groupBy(F.col("node").alias("twice")).agg(F.count("*").alias("n")).where("n > 1 and twice is not null"), "twice")
    if twice.isEmpty():
        return left.select("row.*")
    row = left.select("row", F.col("node").alias("key"), F.monotonically_increasing_id().alias("nth"))
    # written, as it is read twice and a row's number must be the same both times
    often = save(row.join(twice, F.col("key") == F.col("twice"), "left_semi"), "often")
    first = often.groupBy("key").agg(F.min(F.struct(F.xxhash64("row.text").alias("h"), "nth")).alias("least"))
    one = often.join(first.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.xxhash64("row.text") == F.col("least.h")) & (F.col("nth") == F.col("least.nth")))
    once = row.join(twice, F.col("key") == F.col("twice"), "left_anti")
    return once.select("row.*").unionByName(one.select("row.*"))
