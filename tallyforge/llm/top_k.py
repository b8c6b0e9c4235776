"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks, and each pair of a query block and a candidate
block is one group: the candidates' components become postings (rows and weights for each
term), each term of a query scatters its weighted postings into a dense array of scores, one
for each candidate of the block, and a partition selection leaves the k best (ties to the smaller
id). The k best of all blocks are merged by a ranking that keeps k rows of each query in each
task first.

A block holds as many vectors as ``COMPONENTS`` numbers, some tens of thousands, whatever the table's
size; while the table has fewer, blocks are smaller, down to ``FEWEST`` vectors, to keep all cores
busy. A vector goes to one group for each block of the other side, so what is shuffled is the
queries times the blocks of candidates and the candidates times the blocks of queries.

Defined results: vectors that are null, or have a null or non-finite component, or one of which
256 x is beyond a long, take no part, nor do rows with a null id. A pair whose score is beyond a
long is no result. Vectors may differ in length; missing components count as 0. Rows that repeat a query's id are one query
(the smallest vector of that id); candidates that repeat an id are ranked each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPONENTS, FEWEST, EACH_CORE = 1 << 22, 2048, 3


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as long; null where the vector takes no part."""
    wide = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**55))
    return F.when(vector.isNotNull() & usable, wide)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each component, its number within the row), and the components."""
    column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, term, column.flatten().to_numpy(zero_copy_only=False)


def best_in_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    ids, query_ids = candidates.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
    sizes = np.diff(candidates.column("vector").combine_chunks().offsets.to_numpy())
    if len(sizes) and sizes[0] and (sizes == sizes[0]).all():
        # vectors of one length: each term's postings are a row of the transposed block
        flat = candidates.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        weight, row = np.ascontiguousarray(flat.reshape(len(ids), -1).T).ravel(), None
        edge = np.arange(int(sizes[0]) + 1) * len(ids)
    else:
        row, term, weight = _lists(candidates.column("vector"))
        keep = np.flatnonzero(weight)
        order = keep[np.lexsort((row[keep], term[keep]))]
        row, term, weight = row[order], term[order], weight[order]
        edge = np.searchsorted(term, np.arange((term[-1] + 1 if len(term) else 0) + 1))
    whole = [edge[t + 1] - edge[t] == len(ids) for t in range(len(edge) - 1)]
    q_row, q_term, q_weight = _lists(queries.column("vector"))
    q_edge = np.searchsorted(q_row, np.arange(len(query_ids) + 1))
    most = max(-float(weight.min()), float(weight.max())) if len(weight) else 0.0
    narrow, out = np.zeros(len(ids), np.int64), []
    for q in range(len(query_ids)):
        mine = slice(q_edge[q], q_edge[q + 1])
        # where a sum may leave a long, it is taken in whole numbers of any size
        wide = most * float(np.abs(q_weight[mine].astype(float)).sum()) >= 2.0**62
        scores, q_own, own_weight = (np.zeros(len(ids), object), q_weight[mine].astype(object), weight.astype(object)) if wide else (narrow, q_weight[mine], weight)
        scores[:] = 0
        for t, w in zip(q_term[mine], q_own, strict=True):
            if w and t < len(whole):
                own = slice(edge[t], edge[t + 1])
                if whole[t]:
                    scores += w * own_weight[own]
                else:
                    scores[row[own]] += w * own_weight[own]
        there = np.flatnonzero(ids != query_ids[q])
        if wide:
            fits = np.array([-(2**63) <= x < 2**63 for x in scores], bool)
            there, scores = there[fits[there]], np.where(fits, scores, 0).astype(np.int64)
        if len(there) > k:
            least = np.partition(scores[there], len(there) - k)[len(there) - k]
            sure = there[scores[there] > least]
            ties = there[scores[there] == least]
            ties = ties[np.argsort(ids[ties], kind="stable")[: k - len(sure)]]
            there = np.concatenate([sure, ties])
        out.append((np.full(len(there), query_ids[q]), ids[there], scores[there]))
    columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(["query_id", "vec_id", "score"], columns, strict=True)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, components: int = COMPONENTS, fewest: int = FEWEST) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``vectors`` (vec_id, embedding) that
    ``is_query`` picks, the k rows of other ids with the highest integer inner products."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("vector")).where("vec_id is not null and vector is not null")
    asked = usable.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    n = usable.agg(F.count("*").alias("all"), F.count_if(is_query).alias("asked"), F.sum(F.size("vector")).alias("numbers")).first()
    most = max(1, components * n.all // max(1, n.numbers or 0))
    even = -(-n.all // (EACH_CORE * vectors.sparkSession.sparkContext.defaultParallelism))
    across, down = max(1, -(-n.all // min(most, max(fewest, even)))), max(1, -(-n.asked // most))
    # numbers by place in the table, so that blocks are even whatever the ids are
    left = usable.select("vec_id", "vector", F.pmod(F.monotonically_increasing_id(), F.lit(across)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"))
    right = asked.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return best_in_block(queries, candidates, k)

    found = right.groupBy("q", "c").cogroup(left.groupBy("q", "c")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    return f"""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(CAST(x AS DOUBLE)) >= 36028797018963968)) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             coalesce(list_sum(list_transform(range(1, least(len(q.vector), len(c.vector)) + 1), lambda i: CAST(q.vector[i] AS HUGEINT) * c.vector[i])), 0::HUGEINT) AS score
      FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id
    ), r AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s WHERE score BETWEEN -9223372036854775808 AND 9223372036854775807
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
