"""Best-fit packing of token sequences by minimum bin slack.

Bins depend on nothing but how many pieces there are of each length, so packing works on that
table of at most ``size`` rows: the longest length left opens a bin, a bitset subset-sum over the
lengths left, longest first, finds the fullest combination that fits beside it, and that combination
is taken out as often as its lengths last. Each combination uses some length up to less than its own
share, so there are few of them. A combination that leaves less than one id in ``RELAXED`` is full
enough: looking further would use up the short lengths that the last bins need.

Each task packs its own part of the documents, a window of about ``WINDOW`` ids at a time. Bins that
are full (to one id in ``RELAXED``) go out, with all their pieces; the pieces of the others stay for the next window, and the
last window's bins all go out. So nothing is shuffled, broadcast or written in between, a task
holds a window whatever the size of its part. A part ends with a few bins that aren't full, one or
two of them, where packing all documents at once would end with as many in all. A task that runs again gives the
same rows, and its bins are numbered within its part.

A document of more than ``size`` ids is cut into pieces of ``size``, the remainder first.

Defined results: a null or empty text is the end id alone; a null id stays null; rows that repeat
are packed each; a very long text is a window by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_python
from .tokens import encoder
from .words import give_back

END_ID = 2
SIZE = 1024
#: ids that a task packs at a time
WINDOW = 1 << 23
#: a bin is full if it leaves no more than its size over this
RELAXED = 128
#: ids of a batch that a task gives out
BATCH = 1 << 20


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """How many of each length, of ``counts`` at hand, fill ``room`` best, or to ``slack``; longer ones
    first."""
    lengths = sorted((n for n in counts if counts[n] and n <= room), reverse=True)
    reach, steps = 1, []
    keep = (1 << (room + 1)) - 1
    for n in lengths:
        left, times = min(counts[n], room // n), 1
        while left:
            some = min(times, left)
            steps.append((n, some, reach))
            reach |= (reach << (n * some)) & keep
            left -= some
            times *= 2
        if reach >> max(1, room - slack):
            break
    total, out = reach.bit_length() - 1, {}
    for n, some, before in reversed(steps):
        if not before >> total & 1:
            out[n] = out.get(n, 0) + some
            total -= n * some
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, first bin, pieces of that length in each bin, first place): the
    pieces numbered from ``from`` to ``to`` of a length, in bins in a row from ``first bin``."""
    counts = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(counts, 0)
    rows, bins = [], 0
    while counts:
        top = max(counts)
        counts[top] -= 1
        bin_ = fullest(counts, size - top, size // RELAXED)
        counts[top] += 1
        bin_[top] = bin_.get(top, 0) + 1
        times = min(counts[n] // m for n, m in bin_.items())
        place = 0
        for n in sorted(bin_, reverse=True):
            m = bin_[n]
            rows.append((n, used[n], used[n] + m * times, bins, m, place))
            used[n] += m * times
            counts[n] -= m * times
            if not counts[n]:
                del counts[n]
            place += n * m
        bins += times
    return rows


def placed(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece, and its place there."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=size + 1)
    begins = np.cumsum(counts) - counts
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for n, first, last, bin_, each, place in plan({int(n): int(counts[n]) for n in np.flatnonzero(counts)}, size):
        own, k = order[begins[n] + first : begins[n] + last], np.arange(last - first)
        bins[own], offsets[own] = bin_ + k // each, place + k % each * n
    return bins, offsets


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_WIDE = ["doc", "no_doc", "piece", "start", "length", "crc", "run", "at"]


class _Window:
    """Pieces that have no bin yet, and the ids they were cut from."""

    def __init__(self, part: int, size: int, with_ids: bool):
        self.size, self.with_ids, self.next = size, with_ids, part << 40
        self.columns, self.runs, self.ids = [np.zeros(0, np.int64)] * len(_WIDE), [], 0

    def add(self, doc: np.ndarray, no_doc: np.ndarray, ids: np.ndarray, counts: np.ndarray, end_id: int) -> None:
        """A run of documents: their ids in a row, without end ids, and how many each has."""
        whole, size = counts + 1, self.size
        stop = np.cumsum(whole)
        own = np.empty(int(stop[-1]), "<u4")
        own[stop - 1] = end_id
        inner = np.ones(len(own), bool)
        inner[stop - 1] = False
        own[inner] = ids
        pieces = -(-whole // size)
        row = np.repeat(np.arange(len(counts)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = whole - (pieces - 1) * size
        start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
        length = np.where(piece == 0, first[row], size)
        at, view = (stop - whole)[row] + start, memoryview(own).cast("B")
        crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
        new = [doc[row], no_doc[row].astype(np.int64), piece, start, length, crc, np.full(len(row), len(self.runs)), at]
        self.columns = [np.concatenate(c) for c in zip(self.columns, new, strict=True)]
        self.runs.append(own if self.with_ids else None)
        self.ids += len(own)

    def packed(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The rows of full bins, and of all if ``last`` or if the others are too many to stay."""
        length = self.columns[4]
        if not len(length):
            return
        bins, offsets = placed(length, self.size)
        full = (np.bincount(bins, weights=length) >= self.size - self.size // RELAXED)[bins]
        if last or 2 * int(length[~full].sum()) > self.ids:
            full[:] = True
        out = [c[full] for c in self.columns]
        _, number = np.unique(bins[full], return_inverse=True)
        yield from self._rows(out, self.next + number, offsets[full])
        self.next += int(number.max()) + 1 if len(number) else 0
        self._keep([c[~full] for c in self.columns])

    def _keep(self, columns: list[np.ndarray]) -> None:
        self.columns, self.ids = columns, int(columns[4].sum())
        if self.with_ids and len(columns[0]):
            own = self._ids_of(columns)
            self.runs = [own]
            self.columns[6], self.columns[7] = np.zeros(len(columns[6]), np.int64), np.cumsum(columns[4]) - columns[4]
        else:
            self.runs = []
            self.columns[6] = np.zeros(len(columns[6]), np.int64)

    def _ids_of(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([self.runs[r][a : a + n] for n, r, a in zip(*(columns[i].tolist() for i in (4, 6, 7)), strict=True)])

    def _rows(self, columns: list[np.ndarray], sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.cumsum(columns[4])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(BATCH, int(total[-1]) if len(total) else 0, BATCH)), [len(total)]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = [c[a:b] for c in columns]
            arrays = [pa.array(own[0], pa.int64(), mask=own[1] != 0), pa.array(own[2], pa.int32()), *(pa.array(own[i]) for i in (3, 4, 5))]
            if self.with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own[4])]), pa.int32()), pa.array(self._ids_of(own).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence[a:b]), pa.array(offset[a:b])], [*NAMES, *["ids"] * self.with_ids, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece (and its ids)."""

    def run(batches):
        enc, held = encoder(tokenizer), _Window(TaskContext.get().partitionId(), size, with_ids)
        for batch in batches:
            doc = batch.column("doc_id")
            no_doc, doc = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            for first, ids, counts in enc.encode(batch.column("text").to_pylist()):
                own = slice(first, first + len(counts))
                held.add(doc[own], no_doc[own], ids, counts, end_id)
                if held.ids >= window:
                    yield from held.packed(False)
        yield from held.packed(True)
        give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return in_python(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), run, schema)
