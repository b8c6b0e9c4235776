"""Token ids as length-delimited binary records with an offset index.

A data file is a row of frames, as little-endian numbers:

    length      uint64, bytes of the payload
    check       uint32, masked CRC-32 of the 8 length bytes
    payload     int64 doc_id, uint32 flags (1: the id is null), then the ids
    check       uint32, masked CRC-32 of the payload

Ids take two bytes each if the vocabulary fits, else four. A checksum is masked by turning it
right by 15 bits and adding 0xA282EAD8, so that a checksum of bytes that hold checksums stays
sound. Beside each ``part-N.rec`` stands ``part-N.idx``: a uint64 for each record, where its
frame begins, and the file's length at last; a shuffled reader picks records from it.

Files are in order of doc_id (nulls first, equal ids by a hash of the text, then the text): rows are range-partitioned and
sorted, each task writes one file under a name of its own attempt in the shared folder, and the
manifest, a Parquet table written last, names the files of the tasks that counted. Attempts that
were lost or repeated leave files that no manifest names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_python, new_path
from .tokens import encoder

END_ID = 2
_MASK = 0xA282EAD8


def masked(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def frames(stream) -> Iterator[bytes]:
    """The payloads of an open data file, each check tested."""
    while head := stream.read(12):
        length, check = head[:8], struct.unpack("<I", head[8:])[0]
        if len(head) < 12 or masked(length) != check:
            raise ValueError("a record's length is damaged")
        size = struct.unpack("<Q", length)[0]
        payload, tail = stream.read(size), stream.read(4)
        if len(payload) < size or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
            raise ValueError("a record is damaged")
        yield payload


def unpack(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack("<qI", payload[:12])
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=12)


def read_at(uri: str, starts: list[int], width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records whose frames begin at ``starts``, in that order."""
    filesystem, path = _filesystem(uri)
    with filesystem.open_input_file(path) as f:
        for at in starts:
            f.seek(at)
            yield unpack(next(frames(f)), width)


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of every text of ``docs`` (doc_id, text; null is empty) under ``path``;
    returns the manifest (part, file, index, width, records, tokens)."""

    def run(batches):
        enc = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if enc is None:
                enc = encoder(tokenizer)
                width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                part = TaskContext.get().partitionId()
                filesystem, folder = _filesystem(path)
                filesystem.create_dir(folder, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                out = filesystem.open_output_stream(f"{folder}/{name}.rec")
                starts, at, tokens = [0], 0, 0
            ids_of = batch.column("doc_id").to_pylist()
            for first, ids, counts in enc.encode(batch.column("text").to_pylist()):
                ids, end = ids.astype("<u2" if width == 2 else "<u4"), np.array([end_id], "<u2" if width == 2 else "<u4").tobytes()
                begin, raw = 0, memoryview(ids).cast("B")
                written = []
                for k, n in enumerate(counts.tolist()):
                    doc_id = ids_of[first + k]
                    head = struct.pack("<qI", doc_id or 0, doc_id is None)
                    one = frame(b"".join((head, raw[begin * width : (begin + n) * width], end)))
                    written.append(one)
                    at += len(one)
                    starts.append(at)
                    begin += n
                    tokens += n + 1
                out.write(b"".join(written))
        if enc is not None:
            out.close()
            with filesystem.open_output_stream(f"{folder}/{name}.idx") as index:
                index.write(np.array(starts, "<u8").tobytes())
            row = {"part": part, "file": f"{path}/{name}.rec", "index": f"{path}/{name}.idx", "width": width, "records": len(starts) - 1, "tokens": tokens}
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"]
    ordered = keyed.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    schema = "part int, file string, index string, width int, records long, tokens long"
    in_python(ordered, run, schema).write.parquet(f"{path}/manifest")
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record that the manifest of ``path`` names,
    a task for each file. Each file's count of tokens gives where the next one's ids begin; the
    manifest has a row for each file, so it is small however many documents there are."""
    schema = "part int, file string, index string, width int, records long, tokens long"
    parts = spark.read.schema(schema).parquet(f"{path}/manifest").orderBy("part").collect()
    rows, base = [], 0
    for p in parts:
        rows.append((p.file, p.width, base))
        base += p.tokens
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], out)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, name = _filesystem(row["file"])
                got, start = [], row["base"]
                with filesystem.open_input_stream(name, buffer_size=1 << 20) as f:
                    for payload in frames(f):
                        doc_id, ids = unpack(payload, row["width"])
                        got.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                        start += len(ids)
                        if len(got) == 10000:
                            yield _rows(got)
                            got = []
                yield _rows(got)

    def _rows(got):
        columns = list(zip(*got, strict=True)) if got else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "file string, width int, base long").repartition(len(rows))
    return in_python(files, run, out)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` into a new place of the shared folder and reads the files back."""
    spark = docs.sparkSession
    path = new_path(spark, "records")
    write_records(docs, tokenizer, path, end_id)
    return read_records(spark, path)
