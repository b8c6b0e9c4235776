"""Encoding and decoding with a SentencePiece BPE model.

*Lattice.* The most frequent words of the corpus are encoded as a relation: every substring of a
word of at most the longest piece's length is exploded and equi-joined to the piece table, the
edges found are grouped by word, and a higher-order aggregate folds each word's edges into
its segmentation. The model at hand is a BPE one, whose result is not the best-scored path
but that of merging the best pair first; so the fold merges (best score, then leftmost) where
one over a unigram model would take the Viterbi step. Words stay where their hash put them, so
only the words are shuffled, and not their substrings.

*Texts.* Words are cut where no piece of the model can reach across: before the blanks that
follow a character, and between letters and other characters. Workers get the frequent words'
ids (at most ``FREQUENT`` words of at most ``LONGEST`` characters, so a broadcast of bounded
size), fold each other word by itself once and remember it for a while.

Defined results: null and empty texts have no ids. U+2581 in a text stands for a blank, and is
decoded as one. Rows are encoded one by one: repeated ones each, null ids as they are, texts of any
length whole.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import let
from .shared import in_python, save
from .tokens import Encoder

FREQUENT, LONGEST, SHORT = 50_000, 20, 40
BLANK = "▁"
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
WORD = f"{BLANK}*[{LETTER}]+|{BLANK}*[^{BLANK}{LETTER}]+|{BLANK}+"
_WORD = re.compile(WORD)


@lru_cache(maxsize=4)
def pieces(model: str) -> list[tuple[int, str, float, bool]]:
    """(id, piece, score, whether it is one byte) of all pieces a text can have."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(i, sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    crossing = re.compile(f"[^{BLANK}]{BLANK}|[{LETTER}][^{LETTER}]|[^{BLANK}{LETTER}][{LETTER}]")
    for _, piece, _, byte in rows:
        if not byte and crossing.search(piece):
            raise ValueError(f"words of this model can't be cut as they are here: {piece!r}")
    return rows


def segment(chars: Column, edges: Column) -> Column:
    """Bounds of a word's pieces: a fold that takes out one bound a step. ``chars``: how many
    characters; ``edges``: map from start * 64 + length to score."""

    def step(bounds: Column, _: Column) -> Column:
        pairs = F.transform(
            F.slice(bounds, F.lit(1), F.greatest(F.size(bounds) - 2, F.lit(0))),
            lambda b, i: F.struct((-F.element_at(edges, b * 64 + F.get(bounds, i + 2) - b)).alias("cost"), i.alias("i")),
        )
        best = F.array_min(F.filter(pairs, lambda p: p["cost"].isNotNull()))
        return F.when(best.isNull(), bounds).otherwise(let(best["i"], lambda at: F.filter(bounds, lambda _, i: i != at + 1)))

    return F.aggregate(F.sequence(F.lit(2), F.greatest(chars, F.lit(2))), F.sequence(F.lit(0), chars), step)


def lattice(words: DataFrame, table: DataFrame, longest_piece: int) -> DataFrame:
    """(word, ids) of distinct words, from the piece table (piece, id, score). A character that no
    piece covers is left to its bytes, as -1."""
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    spans = starts.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest_piece), F.length("word") - F.col("at")))).alias("length"))
    cut = spans.select("word", "at", "length", F.substring("word", F.col("at") + 1, F.col("length")).alias("piece"))
    found = cut.join(F.broadcast(table), "piece", "left")
    edges = found.groupBy("word").agg(F.map_from_entries(F.collect_list(F.when(F.col("id").isNotNull(), F.struct((F.col("at") * 64 + F.col("length")).alias("key"), F.struct("score", "id").alias("edge"))))).alias("edges"))

    def ids(bounds: Column) -> Column:
        return F.transform(
            F.slice(bounds, F.lit(1), F.size(bounds) - 1),
            lambda b, i: F.coalesce(F.element_at("edges", b * 64 + F.get(bounds, i + 1) - b)["id"], F.lit(-1)),
        )

    return edges.select("word", let(segment(n, F.transform_values("edges", lambda _, e: e["score"])), ids).alias("ids"))


def text_words(text: Column) -> Column:
    marked = F.concat(F.lit(BLANK), F.replace(text, F.lit(" "), F.lit(BLANK)))
    return F.regexp_extract_all(F.when(text != "", marked), F.lit(WORD), F.lit(0))


def frequent_words(docs: DataFrame, model: str, frequent: int = FREQUENT) -> DataFrame:
    """(word, ids) of the words of ``docs`` that come most often: at most ``frequent``, all those
    above a count. That count comes from a table of counts in steps of a sixteenth of a power
    of two, so no task sorts the vocabulary; words that come once are left out."""
    spark, rows = docs.sparkSession, pieces(model)
    table = spark.createDataFrame([(p, i, s) for i, p, s, byte in rows if not byte], "piece string, id int, score double")
    words = docs.select(F.explode(text_words(F.col("text"))).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))
    step = F.floor(F.log2("n") * 16).cast("int")
    counts = save(words.where("n > 1").withColumn("step", step), "counts")
    least, total = 1 << 30, 0
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("words")).collect(), reverse=True):
        total += r.words
        if total > frequent:
            break
        least = r.step
    top = counts.where(F.col("step") >= least).select("word")
    # a number of its own, or the few words would be joined into one task
    return lattice(save(top, "words").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word"), table, max(len(p) for _, p, _, byte in rows if not byte))


class PieceEncoder(Encoder):
    """Ids of texts (each with a blank before it) by words; ``known``: word -> ids."""

    def __init__(self, model: str, known: dict[str, list[int]]):
        rows = pieces(model)
        self.rank = {p: (-s, i) for i, p, s, byte in rows if not byte}
        self.cost = {p: c for p, (c, _) in self.rank.items()}
        self.byte = {int(p[3:5], 16): i for i, p, _, byte in rows if byte}
        self.words = known
        self._forget()
        shown = {i: p.replace(BLANK, " ").encode() for i, p, _, byte in rows if not byte} | {i: bytes([b]) for b, i in self.byte.items()}
        texts = [shown.get(i, b"") for i in range(max(shown) + 1)]
        self.shown, self.size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        self.at = np.cumsum(self.size) - self.size

    def fold(self, word: str) -> list[int]:
        """Merges the best pair first, as ``segment`` does, with a heap for long words."""
        n, rank = len(word), self.rank
        if n <= SHORT:
            return self._fold_short(word)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(cost[0], i, i + 1, i + 2) for i in range(n - 1) if (cost := rank.get(word[i : i + 2]))]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (cost := rank.get(word[i : end[j]])):
                heapq.heappush(heap, (cost[0], i, j, end[j]))

        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if alive[i] and j < n and alive[j] and after[i] == j and end[j] == stop:
                end[i], after[i], alive[j] = stop, after[j], False
                if after[j] < n:
                    before[after[j]] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        out, i = [], 0
        while i < n:
            found = rank.get(word[i : end[i]])
            out += [found[1]] if found else [self.byte[b] for b in word[i : end[i]].encode("utf-8", "surrogatepass")]
            i = after[i]
        return out

    def _fold_short(self, word: str) -> list[int]:
        """The same for a word of few characters, by looking for the best pair each time."""
        cost, never = self.cost.get, float("inf")
        parts = list(word)
        costs = [cost(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) < never:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], never)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], never)
        out = []
        for p in parts:
            found = self.rank.get(p)
            out += [found[1]] if found else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def _learn(self, pieces: list[bytes]) -> None:
        self._store(pieces, [self._whole(p.decode("utf-8", "surrogatepass")) for p in pieces])

    def _whole(self, text: str) -> list[int]:
        out = []
        for word in _WORD.findall(text.replace(" ", BLANK)):
            ids = self.words.get(word)
            out += self.fold(word) if ids is None else ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, with the blank before it."""
        size = self.size[ids]
        total = np.cumsum(size)
        where = np.arange(total[-1] if len(ids) else 0) + np.repeat(self.at[ids] - (total - size), size)
        return self.shown[where].tobytes()


def encode(docs: DataFrame, model: str, frequent: int = FREQUENT, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of 32-bit little-endian ids), round_trip (decoding gives the
    text again) and, if wanted, ids of each row of ``docs`` (doc_id, text)."""
    rows = frequent_words(docs, model, frequent).where(~F.exists("ids", lambda i: i == -1)).toArrow()
    known = dict(zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist(), strict=True))
    words = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        encoder = PieceEncoder(model, words.value)
        for batch in batches:
            texts = [" " + t if t else "" for t in batch.column("text").to_pylist()]
            for first, ids, counts in encoder.encode(texts):
                last, at = first + len(counts), np.concatenate([[0], np.cumsum(counts)])
                ids = ids.astype("<u4")
                total = np.concatenate([[0], np.cumsum(encoder.size[ids])])[at].tolist()
                back, place, out = encoder.decode(ids), at.tolist(), []
                for k in range(len(counts)):
                    text = texts[first + k]
                    same = BLANK not in text and back[total[k] : total[k + 1]] == text.encode("utf-8", "surrogatepass")
                    out.append((place[k + 1] - place[k], zlib.crc32(ids[place[k] : place[k + 1]]), same))
                n, crc, same = zip(*out, strict=True)
                columns = [batch.column("doc_id").slice(first, last - first), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return in_python(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` (doc_id, ids) with the ids' text; bytes that are no UTF-8 are replaced."""

    def run(batches):
        encoder = PieceEncoder(model, {})
        for batch in batches:
            texts = [encoder.decode(np.array(i or [], np.int64)).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t[1:] if t.startswith(" ") else t for t in texts])], ["doc_id", "text"])

    return in_python(rows.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    return spark.createDataFrame([(i, p, s, b) for i, p, s, b in pieces(model)], "id int, piece string, score double, byte boolean")
