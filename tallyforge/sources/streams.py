"""The self-describing stream format of nested records, as a table.

A file is a row of segments; each has its own magic bytes, header, classes and footer. Records are
framed by a little-endian size whose top bit says that a class id follows; ids from 100 to
200 are the stream's own, odd ones are metadata. Sections may be compressed by zlib or gzip, or be
blocks compressed by snappy or lz4, each with its size before it. A footer says how long its segment is and where its classes and its metadata are.

Reading is a data source of Spark: one task for each segment, whose footers are walked from a file's
end, and which is decompressed and decoded as it is read, so neither files nor segments are held
whole. With the footers' offsets the metadata can be read alone, and a block without the ones before.
Writing is by tasks too, a file for each segment. Files are reached through ``pyarrow.fs``, so they
may be on any file system it knows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .records import Classes, descriptor, encoded, fields, rows_of, schema_of

# Fixed values of the format.
START_MAGIC = b"A4STREAM"
END_MAGIC = b"KTHXBYE4"
HEADER, FOOTER, START_COMPRESSED, END_COMPRESSED, CLASS = 100, 102, 104, 106, 108
ZLIB, GZIP, SNAPPY, LZ4 = 0, 1, 3, 4
BLOCK = 64 * 1024

_TOP, _FRAME = 1 << 31, struct.Struct("<II")
_CODECS = {SNAPPY: "snappy", LZ4: "lz4_raw"}
#: Files beyond this number aren't opened on the driver: each is one task, which walks its segments.
WALKED = 1000
SCHEMA = "path string, segment int, position long, class_id int, class_name string, is_metadata boolean, forward boolean, record binary, json string"
_COLUMNS = {"segment": pa.int32(), "position": pa.int64(), "class_id": pa.int32(), "class_name": pa.string(), "is_metadata": pa.bool_(), "forward": pa.bool_(), "record": pa.binary(), "json": pa.string()}


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1) if path.startswith("file:") else f"/{path}")


def _opened(path: str) -> io.BufferedReader:
    """The file ``path``; short reads and seeks that stay near cost no call of its file system."""
    system, name = _filesystem(path)
    return io.BufferedReader(system.open_input_file(name), BLOCK)


def _length(file) -> int:
    return file.seek(0, io.SEEK_END)


def files_of(path: str) -> list[str]:
    """The file ``path``, or the files in the folder ``path``."""
    from pyarrow import fs

    system, name = _filesystem(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    root = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted(root + x.path for x in system.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def _snappy_length(raw: bytes) -> int:
    value = shift = 0
    for b in raw:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    return value


def _lz4_length(raw: bytes) -> int:
    """How long a raw lz4 block is when unpacked, which only its sequences tell."""
    at = length = 0
    while at < len(raw):
        token = raw[at]
        at += 1
        for part, extra in ((token >> 4, 0), (token & 15, 4)):
            if extra:
                at += 2
            if part == 15:
                while True:
                    part += raw[at]
                    at += 1
                    if raw[at - 1] < 255:
                        break
            length += part + extra
            at += 0 if extra else part
            if not extra and at >= len(raw):
                break
    return length


class _BlockPacker:
    """Blocks of one codec, with the interface of zlib's compressors."""

    def __init__(self, compression: int):
        self.codec, self.held = pa.Codec(_CODECS[compression]), b""

    def _packed(self, data: bytes) -> bytes:
        raw = self.codec.compress(data, asbytes=True)
        return _varint(len(raw)) + raw

    def compress(self, data: bytes) -> bytes:
        self.held += data
        whole = len(self.held) // BLOCK * BLOCK
        out = b"".join(self._packed(self.held[i : i + BLOCK]) for i in range(0, whole, BLOCK))
        self.held = self.held[whole:]
        return out

    def flush(self) -> bytes:
        out, self.held = self._packed(self.held) if self.held else b"", b""
        return out


class _Deflate:
    """A compressor of zlib or gzip whose tables fit what is packed first: those of whole size take longer to
    clear than a short section takes to pack."""

    def __init__(self, level: int, gzip: bool):
        self.level, self.gzip, self.inner = level, gzip, None

    def compress(self, data: bytes) -> bytes:
        if self.inner is None:
            bits, memory = (15, 8) if len(data) > 1024 else (10, 1)
            self.inner = zlib.compressobj(self.level, zlib.DEFLATED, bits + 16 * self.gzip, memory)
        return self.inner.compress(data)

    def flush(self) -> bytes:
        return self.inner.flush()


class _Source:
    """Takes bytes from an open file, or from a compressed section of it, as they are needed."""

    #: bytes read at once from a compressed section: few at first, as what follows a short one is read again
    FIRST, STEP = 1 << 8, 1 << 16

    def __init__(self, file):
        self.file, self.inner, self.held, self.at, self.step = file, None, b"", 0, self.FIRST

    def take(self, n: int) -> bytes:
        if self.inner is None:
            out = self.file.read(n)
        else:
            while len(self.held) - self.at < n and self._more():
                pass
            out = self.held[self.at : self.at + n]
            self.at += len(out)
        if len(out) < n:
            raise EOFError("the stream ends within a record")
        return out

    def _block(self) -> bool:
        size = shift = 0
        while True:
            b = self.file.read(1)
            if not b:
                return False
            size |= (b[0] & 127) << shift
            shift += 7
            if b[0] < 128:
                break
        raw = self.file.read(size)
        length = _snappy_length(raw) if self.inner == SNAPPY else _lz4_length(raw)
        self.held, self.at = self.held[self.at :] + pa.Codec(_CODECS[self.inner]).decompress(raw, decompressed_size=length, asbytes=True), 0
        return True

    def _more(self) -> bool:
        if self.inner in _CODECS:
            return self._block()
        raw = b"" if self.inner.eof else self.file.read(self.step)
        if not raw:
            return False
        self.step = min(4 * self.step, self.STEP)
        self.held, self.at = self.held[self.at :] + self.inner.decompress(raw), 0
        if self.inner.eof:
            self.file.seek(self.file.tell() - len(self.inner.unused_data))
        return True

    def start(self, compression: int) -> None:
        self.held, self.at, self.step = b"", 0, self.FIRST
        if compression in _CODECS:
            self.inner = compression
            return
        if compression not in (ZLIB, GZIP):
            raise ValueError(f"compression {compression} can't be read")
        self.inner = zlib.decompressobj(15 if compression == ZLIB else 31)

    def stop(self) -> None:
        # a block ends with its section; the other formats have a trailer to read
        while self.inner not in _CODECS and not self.inner.eof and self._more():
            pass
        self.inner = None

    def record(self) -> tuple[int, bytes]:
        held, at = self.held, self.at
        if self.inner is not None and len(held) - at >= 8:
            size, class_id = _FRAME.unpack_from(held, at)
            end = at + 8 + size - _TOP
            if size & _TOP and end <= len(held):
                self.at = end
                return class_id, held[at + 8 : end]
        size = int.from_bytes(self.take(4), "little")
        if size & _TOP:
            raw = self.take(4 + size - _TOP)
            return int.from_bytes(raw[:4], "little"), raw[4:]
        return 0, self.take(size)


@dataclass
class Segment(InputPartition):
    """A segment of a file: where it begins and where its footer does; -1 if that isn't known."""

    path: str
    number: int = 0
    start: int = 0
    footer: int = -1


@dataclass
class Footer:
    size: int
    metadata: array
    classes: list[int]
    counts: dict[int, int]


def _footer(raw: bytes) -> Footer:
    found = Footer(0, array("q"), [], {})
    for number, value in fields(raw):
        if number == 1:
            found.size = value
        elif number in (2, 3):
            (found.metadata if number == 2 else found.classes).append(value)
        elif number == 4:
            one = dict(fields(value))
            found.counts[one[1]] = one[2]
    return found


def segments(path: str) -> list[Segment]:
    """The segments of a file by its footers, from the end; one of unknown length if it wasn't closed."""
    with _opened(path) as file:
        end, found = _length(file), []
        while end > 0:
            file.seek(max(0, end - 12))
            tail = file.read(12)
            size = struct.unpack("<I", tail[:4])[0] if len(tail) == 12 and tail[4:] == END_MAGIC else None
            if size is None or size + 20 > end:
                return [Segment(path)]
            at = end - 12 - size
            file.seek(at)
            # the size stands first, before what may be millions of offsets
            head = next(fields(file.read(min(size, 12))), (1, 0))
            if head[0] != 1:
                file.seek(at)
                head = (1, _footer(file.read(size)).size)
            start = at - 8 - head[1]
            found.append(Segment(path, 0, start, at - 8))
            end = start
    for number, s in enumerate(reversed(found)):
        s.number = number
    return found[::-1]


def _forward(raw: bytes) -> bool:
    return any(n == 5 and v for n, v in fields(raw))


def records(source: _Source, path: str, number: int, internal: bool = False, json: bool = True, classes: Classes | None = None, forward: bool = False, to: int | None = None) -> Iterator[dict]:
    """The records from where ``source`` is to the end of its segment, in order, or to the offset ``to``."""
    position, opened = 0, classes is not None
    if not opened:
        if source.file.read(8) != START_MAGIC:
            raise ValueError(f"{path}: no stream begins here")
        classes = Classes()
    while to is None or source.inner is not None or source.file.tell() < to:
        class_id, record = source.record()
        if class_id == HEADER:
            forward = _forward(record)
        elif class_id == CLASS:
            classes.declare(record)
        elif class_id == START_COMPRESSED:
            source.start(next((v for n, v in fields(record) if n == 1), ZLIB))
        elif class_id == END_COMPRESSED:
            source.stop()
        own = 100 <= class_id <= 200
        if internal or not own:
            yield {
                "segment": number, "position": position, "class_id": class_id, "class_name": classes.names.get(class_id), "is_metadata": not own and class_id % 2 == 1,
                "forward": forward, "record": record, "json": None if own or not json else classes.json(class_id, record),
            }
            position += 1
        if class_id == FOOTER:
            if struct.unpack("<I", source.take(4))[0] != len(record) or source.take(8) != END_MAGIC:
                raise ValueError(f"{path}: a damaged footer")
            break


class StreamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["paths"].split("\n") if p]
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.internal, self.json, self.metadata = flag("internal", False), flag("json", True), flag("metadata", False)
        self.block = int(options["block"]) if options.get("block") else None

    def partitions(self) -> Sequence[Segment]:
        files = [f for p in self.paths for f in files_of(p)]
        if len(set(files)) != len(files):
            raise ValueError("a file is named twice")
        return [s for f in files for s in (segments(f) if len(files) <= WALKED else [Segment(f)])] or [Segment("")]

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        whole = segments(part.path) if part.footer < 0 else [part]
        held = []
        for segment in whole:
            for row in self._rows(segment):
                held.append(row)
                if len(held) == 1000:
                    yield self._batch(part.path, held)
                    held = []
        if held:
            yield self._batch(part.path, held)

    def _batch(self, path, held):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), *[pa.array([r[n] for r in held], k) for n, k in _COLUMNS.items()]], ["path", *_COLUMNS])

    def _rows(self, segment: Segment) -> Iterator[dict]:
        with _opened(segment.path) as file:
            number, end = segment.number, _length(file) if segment.footer < 0 else segment.footer
            file.seek(segment.start)
            source = _Source(file)
            if segment.footer >= 0 and (self.block is not None or self.metadata):
                yield from self._sought(source, segment)
                return
            while file.tell() < end:
                yield from records(source, segment.path, number, self.internal, self.json)
                number += 1

    def _sought(self, source: _Source, segment: Segment) -> Iterator[dict]:
        """The metadata alone, or one block with its metadata, by the footer's offsets."""
        file = source.file
        file.seek(segment.footer)
        footer = _footer(source.record()[1])
        file.seek(segment.start + len(START_MAGIC))
        forward, classes = _forward(source.record()[1]), Classes()
        first = file.tell()
        for at in footer.classes:
            file.seek(segment.start + at)
            classes.declare(source.record()[1])
        places = array("q", (segment.start + at for at in footer.metadata))
        for k, at in enumerate(places):
            if self.block not in (None, k):
                continue
            file.seek(at)
            class_id, record = source.record()
            if class_id % 2 == 0:
                raise ValueError(f"{segment.path}: no metadata at the footer's offset")
            yield {"segment": segment.number, "position": -1 if forward else 1 << 40, "class_id": class_id, "class_name": classes.names.get(class_id), "is_metadata": True, "forward": forward, "record": record, "json": classes.json(class_id, record) if self.json else None}
            if self.block == k:
                begin, end = (file.tell(), [*places, segment.footer][k + 1]) if forward else ([first, *places][k], at)
                file.seek(begin)
                rows = records(source, segment.path, segment.number, False, self.json, classes, forward, end)
                yield from (r for r in rows if not r["is_metadata"])


class StreamSource(DataSource):
    """``spark.read.format("record_stream")``; options: paths (one a line), internal, metadata, block, json."""

    @classmethod
    def name(cls) -> str:
        return "record_stream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StreamReader(self.options)


def read_streams(spark: SparkSession, paths: str | list[str], internal: bool = False, metadata_only: bool = False, block: int | None = None, json: bool = True) -> DataFrame:
    """Every record of the files (or of the files in folders) as ``SCHEMA``; ``internal`` also gives the
    stream's own ones; ``metadata_only`` reads nothing but metadata, and ``block`` one block of each
    segment, both by the footers' offsets; without ``json`` records stay encoded."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if len(set(paths)) != len(paths):
        raise ValueError("a file is named twice")
    spark.dataSource.register(StreamSource)
    reader = spark.read.format("record_stream").option("paths", "\n".join(paths)).option("internal", str(internal)).option("metadata", str(metadata_only)).option("json", str(json))
    return (reader if block is None else reader.option("block", str(block))).load()


def footers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, segment, size, class_id, class_name and count of every segment, from footers alone."""
    named = [paths] if isinstance(paths, str) else list(paths)

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                with _opened(path) as file:
                    for s in segments(path):
                        source, classes = _Source(file), Classes()
                        file.seek(s.footer)
                        found = _footer(source.record()[1])
                        for at in found.classes:
                            file.seek(s.start + at)
                            classes.declare(source.record()[1])
                        out += [(path, s.number, found.size, i, classes.names.get(i), n) for i, n in found.counts.items()]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "segment", "size", "class_id", "class_name", "count"])

    files = spark.createDataFrame([(f,) for p in named for f in files_of(p)], "path string")
    return files.repartition("path").mapInArrow(run, "path string, segment int, size long, class_id int, class_name string, count long")


def class_schemas(path: str) -> dict[str, T.StructType]:
    """The schema of each class that the first segment of a file declares."""
    segment = segments(files_of(path)[0])[0]
    with _opened(segment.path) as file:
        source, classes = _Source(file), Classes()
        if segment.footer < 0:
            raise ValueError(f"{path} has no footer")
        file.seek(segment.footer)
        for at in _footer(source.record()[1]).classes:
            file.seek(segment.start + at)
            classes.declare(source.record()[1])
    return {n: schema_of(classes.pool.FindMessageTypeByName(n)) for n in classes.names.values()}


def _texts_for_longs(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _texts_for_longs(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_texts_for_longs(kind.elementType))
    return T.StringType() if isinstance(kind, (T.LongType, T.DecimalType)) else kind


def parsed(json: Column, schema: T.StructType) -> Column:
    """Records' JSON, in which long numbers are texts, as ``schema``."""
    return F.from_json(json, _texts_for_longs(schema)).cast(schema)


def of_class(stream: DataFrame, name: str, schema: str | T.StructType) -> DataFrame:
    """The records of one class as columns of ``schema``; fields that are absent are null."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = stream.where(F.col("class_name") == name).withColumn("_r", parsed(F.col("json"), schema))
    return rows.select("path", "segment", "position", "is_metadata", "forward", "_r.*")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _text(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


class SegmentWriter:
    """Writes one segment to an open file. Classes and metadata stand between compressed sections, so
    that the footer's offsets lead to them."""

    def __init__(self, out, forward: bool = True, compression: int | None = ZLIB, level: int = 1):
        self.out, self.at, self.compression, self.level, self.pack = out, 0, compression, level, None
        self.held, self.size = [], 0
        self.ids, self.files, self.counts, self.metadata_at, self.classes_at = {}, set(), {}, array("q"), []
        self._raw(START_MAGIC)
        self._raw(self._framed(HEADER, _number(1, 2) + (_number(5, 1) if forward else b"")))

    def _raw(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _framed(self, class_id: int, raw: bytes) -> bytes:
        self.counts[class_id] = self.counts.get(class_id, 0) + 1
        return _FRAME.pack(len(raw) | _TOP, class_id) + raw

    def _open(self) -> None:
        if self.pack is None and self.compression is not None:
            self._raw(self._framed(START_COMPRESSED, _number(1, self.compression)))
            self.pack = _BlockPacker(self.compression) if self.compression in _CODECS else _Deflate(self.level, self.compression == GZIP)

    def _packed(self) -> bytes:
        data, self.held, self.size = b"".join(self.held), [], 0
        return self.pack.compress(data)

    def _close(self) -> None:
        if self.pack is not None:
            self.held.append(self._framed(END_COMPRESSED, b""))
            self._raw(self._packed() + self.pack.flush())
            self.pack = None

    def class_id(self, name: str, files: Sequence, metadata: bool) -> int:
        """The id of a class, which is declared with the ``files`` it needs when it is first used."""
        if name not in self.ids:
            own = 200 + 2 * len(self.ids) + (1 if metadata else 2)
            declared = _number(1, own) + _text(2, name.encode())
            for file in files:
                if file.name not in self.files:
                    self.files.add(file.name)
                    declared += _text(3, file.SerializeToString())
            self._close()
            self.classes_at.append(self.at)
            self._raw(self._framed(CLASS, declared))
            self.ids[name] = own
        if metadata != (self.ids[name] % 2 == 1):
            raise ValueError(f"{name} is either metadata or content")
        return self.ids[name]

    def write(self, class_id: int, raw: bytes) -> None:
        if class_id % 2:
            self._close()
            self.metadata_at.append(self.at)
            self._raw(self._framed(class_id, raw))
        else:
            self._open()
            framed = self._framed(class_id, raw)
            if self.pack is None:
                self._raw(framed)
                return
            self.held.append(framed)
            self.size += len(framed)
            if self.size >= BLOCK:
                self._raw(self._packed())

    def finish(self) -> None:
        self._close()
        counts = sorted(self.counts.items())
        footer = _number(1, self.at) + b"".join(_number(2, x) for x in self.metadata_at) + b"".join(_number(3, x) for x in self.classes_at)
        footer += b"".join(_text(4, _number(1, i) + _number(2, n)) for i, n in counts)
        self._raw(self._framed(FOOTER, footer) + struct.pack("<I", len(footer)) + END_MAGIC)


def write_stream(messages: list, path: str, metadata: set[str] = frozenset(), forward: bool = True, compression: int | None = ZLIB) -> None:
    """Writes protobuf ``messages`` in order as one segment; classes named in ``metadata`` get odd ids."""
    from google.protobuf import descriptor_pb2

    def files(file):
        for d in file.dependencies:
            yield from files(d)
        yield descriptor_pb2.FileDescriptorProto.FromString(file.serialized_pb)

    system, name = _filesystem(path)
    with system.open_output_stream(name) as out:
        writer = SegmentWriter(out, forward, compression)
        for m in messages:
            own = m.DESCRIPTOR.full_name
            writer.write(writer.class_id(own, [] if own in writer.ids else list(files(m.DESCRIPTOR.file)), own in metadata), m.SerializeToString())
        writer.finish()


def write_streams(stream: DataFrame, path: str, segment: str, order: Sequence[str], metadata: Sequence[str] = (), forward: bool = True, compression: int | None = ZLIB) -> DataFrame:
    """Writes ``stream`` as one file a segment below ``path``, by tasks; returns file, segment and records.

    Every column but ``segment`` and ``order`` is a struct named as its class, and a row is a record of
    the class whose struct isn't null; those in ``metadata`` are metadata. A segment is one file's worth
    of rows: it is sorted and written by one task. Files of attempts that didn't count aren't listed."""
    names = [c for c in stream.columns if c != segment and c not in order]
    kinds = {c: descriptor(c, stream.schema[c].dataType) for c in names}
    spark = stream.sparkSession
    rows = stream.select(F.col(segment).cast("string").alias("_segment"), *order, *names)
    records = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name in names else f for f in rows.schema.fields])

    def encode(batches):
        classes = Classes()
        for file in kinds.values():
            classes.add(file)
        messages = {c: classes.of(c)() for c in names}
        for batch in batches:
            columns = [pa.array([None if row is None else encoded(messages[n], row) for row in rows_of(c)], pa.binary()) if n in names else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    # records are encoded where the rows are, so that the tasks that write have little to do for each
    rows = rows.mapInArrow(encode, records).repartition("_segment").sortWithinPartitions("_segment", *order).drop(*order)

    def run(batches):
        current, writer, out, listed = None, None, None, []

        def finish():
            if writer is not None:
                writer.finish()
                out.close()
                listed.append((f"{path}/{file}", current, sum(n for i, n in writer.counts.items() if i > 200)))

        for batch in batches:
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("_segment", *names)), strict=True):
                if writer is None or own != current:
                    finish()
                    current, file = own, f"segment-{uuid.uuid4().hex}.stream"
                    system, folder = _filesystem(path)
                    system.create_dir(folder, recursive=True)
                    out = io.BufferedWriter(system.open_output_stream(f"{folder}/{file}"), BLOCK)
                    writer = SegmentWriter(out, forward, compression)
                for c, raw in zip(names, row, strict=True):
                    if raw is not None:
                        writer.write(writer.ids.get(c) or writer.class_id(c, [kinds[c]], c in metadata), raw)
        finish()
        columns = list(zip(*listed, strict=True)) if listed else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["file", "segment", "records"])

    schema = "file string, segment string, records long"
    rows.mapInArrow(run, schema).write.parquet(f"{path}-files")
    return spark.read.schema(schema).parquet(f"{path}-files")
