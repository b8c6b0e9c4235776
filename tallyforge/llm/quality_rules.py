"""Repetition rules from a suffix array of each text's words.

All texts of a chunk share one suffix array over word hashes: ranks are refined by prefix
doubling, and as a rank starts with the text's own number, suffixes of different texts never
meet. Only suffixes whose rank isn't unique yet are sorted again. Ranks after 1, 2, 4, ...
words are kept; two neighbours' longest common prefix follows from them, longest step first.

An interval of neighbours with a common prefix of at least ``MIN_REPEAT`` words holds the
places of a repeated passage, and each place's longest such prefix is a maximal repeat from
there. The spans are united; a text fails if they cover more than ``MAX_COVERED`` of its words
or if the longest repeat is over ``MAX_LONGEST`` of them.

Defined results: a null, empty or white text has zeros everywhere and fails (under 50 words).
Rows are judged one by one, so repeated rows and ids don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_python
from .words import U64, chunks, give_back, hashes, mix, split

MIN_REPEAT = 8
MAX_COVERED = 0.30
MAX_LONGEST = 0.20
MIN_WORDS = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def _renumber(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs, and for each in that order the position where its equals begin."""
    order = np.lexsort((minor, major))
    a, b = major[order], minor[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))


def suffix_order(words: np.ndarray, owner: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all texts and the ranks after 1, 2, 4, ... words. ``last`` is the
    end of each word's own text: what follows it compares as smaller than any word."""
    n = len(words)
    order, begins = _renumber(owner, words)
    rank = np.empty(n, np.int64)
    rank[order] = begins
    # all levels are kept, so in half the bytes where that does
    kind = np.int32 if n < 1 << 31 else np.int64
    levels, array, step = [rank.astype(kind)], order, 1
    while n:
        sizes = np.bincount(rank, minlength=n)
        open_at = np.flatnonzero(sizes[rank[array]] > 1)
        if not len(open_at):
            break
        who = array[open_at]
        ahead = who + step
        nxt = np.where(ahead < last[who], rank[np.minimum(ahead, n - 1)], -1)
        sub, begin = _renumber(rank[who], nxt)
        array = array.copy()
        array[open_at] = who[sub]
        rank = rank.copy()
        rank[who[sub]] = open_at[begin]
        levels.append(rank.astype(kind))
        step *= 2
    return array, levels


def common_prefixes(array: np.ndarray, levels: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """Longest common prefix, in words, of each suffix in the array and the one before."""
    out = np.zeros(len(array), np.int64)
    if len(array) < 2:
        return out
    where = 1 + np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]])
    x, y, lcp = array[where - 1].copy(), array[where].copy(), np.zeros(len(where), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank, size = levels[level], 1 << level
        # equal ranks stand for `size` equal words only where both texts go on as far
        fits = (x + size <= last[np.minimum(x, len(last) - 1)]) & (y + size <= last[np.minimum(y, len(last) - 1)]) & (x < len(last)) & (y < len(last))
        ok = fits & (rank[np.minimum(x, len(last) - 1)] == rank[np.minimum(y, len(last) - 1)])
        x[ok] += size
        y[ok] += size
        lcp[ok] += size
    out[where] = lcp
    return out


def repeats(words: np.ndarray, first: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(covered, longest) for each text: words within repeated passages of at least ``least``
    words, and the longest repeat."""
    n, texts = len(words), len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    last = first[1:][owner]
    array, levels = suffix_order(words, owner, last)
    lcp = common_prefixes(array, levels, last)
    at = np.flatnonzero(lcp >= least)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, owner[array[at]], lcp[at])
    ends = np.zeros(n + 1, np.int64)
    for side in (array[at], array[at - 1]):
        np.add.at(ends, side, 1)
        np.add.at(ends, side + lcp[at], -1)
    covered = np.bincount(owner, weights=np.cumsum(ends[:-1]) > 0, minlength=texts).astype(np.int64)
    return covered, longest


def repeated_windows(words: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each text within windows of ``size`` words that it holds twice or more."""
    n, texts = len(words), len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    run = np.zeros(n, U64)
    padded = np.concatenate([words, np.zeros(size, U64)])
    for i in range(size):
        run = mix(run * U64(31) + padded[i : i + n])
    at = np.flatnonzero(np.arange(n) + size <= first[1:][owner])
    order, begins = _renumber(owner[at], run[at])
    twice = np.bincount(begins, minlength=len(at))[begins] > 1
    marks = np.zeros(n + size, bool)
    for i in range(size):
        marks[at[order[twice]] + i] = True
    return np.bincount(owner, weights=marks[:n], minlength=texts).astype(np.int64)


def _copied_lines(text: str | None) -> int:
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            n += 1
        elif _HAS_WORD.search(line):
            seen.add(line)
    return n


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(batches: Iterator[pa.RecordBatch], text: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows are one struct ``row``, whose field number ``text`` is the text. It stays beside the
    measures if ``whole``, else its doc_id does."""
    for batch in batches:
        row = batch.column("row")
        texts = row.field(text).to_pylist()
        for a, b, raw, offsets in chunks(texts, 1 << 20):
            data, start, end, first = split(raw, offsets)
            with np.errstate(over="ignore"):
                words = hashes(data, start, end)
                windows = repeated_windows(words, first)
                covered, longest = repeats(words, first)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[start] = 1
            inside[end] -= 1
            inside = np.cumsum(inside[:-1]) > 0
            n_words = np.diff(first)
            base = (n_words < MIN_WORDS) | (100 * windows > 50 * n_words)
            repeating = (covered > MAX_COVERED * n_words) | (longest > MAX_LONGEST * n_words)
            columns = {
                "n_words": n_words,
                "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offsets),
                "n_symbols": _sums(_SYMBOL[data], offsets),
                "n_dup_lines": [_copied_lines(t) for t in texts[a:b]],
                "n_repeat_words": windows,
                "n_covered_words": covered,
                "longest_repeat": longest,
                "base_failed": base,
                "kept": ~(base | repeating),
            }
            name = "row" if whole else "doc_id"
            rest = (row if whole else row.field(row.type.get_field_index(name))).slice(a, b - a)
            yield pa.RecordBatch.from_arrays([rest, *map(pa.array, columns.values())], [name, *columns])
    give_back()


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id and what ``MEASURES`` names, for each row of ``docs`` (doc_id, text)."""
    row = docs.select(F.struct("text", F.col("doc_id").cast("long").alias("doc_id")).alias("row"))
    return in_python(row, lambda batches: measure(batches, 0, False), f"doc_id long, {MEASURES}")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. Names that clash with
    the measures are of no consequence: rows travel as one struct."""
    row, text = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")), docs.columns.index("text")
    judged = in_python(row, lambda batches: measure(batches, text, True), f"row {row.schema['row'].dataType.simpleString()}, {MEASURES}")
    return judged.where("kept").select("row.*")
