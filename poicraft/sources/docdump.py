"""Document-store dumps as a Spark data source, ``docdump``.

A dump holds BSON documents one behind the other, each with its length in front, as the
dump tools of document stores write them. No server is needed: the reader takes the
files, cuts each into splits at document boundaries and decodes only the fields of
the read schema, nested ones included. The writer stores a frame in the same form, a file
per task, with an index of document offsets beside it (``.idx``); a file without one is
walked once, from length to length, to find its boundaries.

Files are opened through ``pyarrow.fs``: mounted folders, S3, GCS, or HDFS where its client
library is installed. The path must be reachable from the driver and all executors.

    spark.dataSource.register(docdump.DocDump)
    spark.read.format("docdump").schema(VENUE_SCHEMA).load(path)

Option ``splitBytes`` sets the size of a split (64 MB by default).
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "docdump"
SPLIT_BYTES = 64 << 20
# Documents of one record batch.
BATCH = 4096
SUFFIX, INDEX = ".bson", ".idx"
# The element types of the format that are read, by their code.
DOUBLE, STRING, DOCUMENT, ARRAY, BINARY, OBJECT_ID, BOOLEAN, DATE_TIME, NULL, INT32, TIMESTAMP, INT64 = (
    1, 2, 3, 4, 5, 7, 8, 9, 10, 16, 17, 18)
WIDTHS = {DOUBLE: 8, OBJECT_ID: 12, BOOLEAN: 1, DATE_TIME: 8, NULL: 0, INT32: 4, TIMESTAMP: 8, INT64: 8}


# ---------------------------------------------------------------- documents


def encode(value: dict | list) -> bytes:
    """A document (or array) in stored form."""
    items = value.items() if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value))
    body = b"".join(_element(k, v) for k, v in items)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _element(name: str, v) -> bytes:
    key = name.encode() + b"\0"
    if v is None:
        return bytes([NULL]) + key
    if isinstance(v, bool):
        return bytes([BOOLEAN]) + key + bytes([v])
    if isinstance(v, int):
        return bytes([INT64]) + key + struct.pack("<q", v)
    if isinstance(v, float):
        return bytes([DOUBLE]) + key + struct.pack("<d", v)
    if isinstance(v, (dict, list)):
        return bytes([DOCUMENT if isinstance(v, dict) else ARRAY]) + key + encode(v)
    text = str(v).encode()
    return bytes([STRING]) + key + struct.pack("<i", len(text) + 1) + text + b"\0"


def _width(data: bytes, kind: int, at: int) -> int:
    """Bytes of an element's value."""
    if kind in WIDTHS:
        return WIDTHS[kind]
    if kind not in (STRING, DOCUMENT, ARRAY, BINARY):
        raise ValueError(f"element type {kind} is not supported")
    size = struct.unpack_from("<i", data, at)[0]
    return size if kind in (DOCUMENT, ARRAY) else size + (4 if kind == STRING else 5)


def decode(data: bytes, start: int, kind: T.DataType):
    """The document (or array) at ``start`` as the schema type ``kind`` wants it; fields the
    schema does not name are passed over."""
    fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else None
    out = dict.fromkeys(fields) if fields is not None else []
    at, end = start + 4, start + struct.unpack_from("<i", data, start)[0] - 1
    while at < end:
        code, stop = data[at], data.index(b"\0", at + 1)
        name, at = data[at + 1:stop].decode(), stop + 1
        width = _width(data, code, at)
        if fields is None:
            out.append(_value(data, code, at, kind.elementType))
        elif name in fields:
            out[name] = _value(data, code, at, fields[name])
        at += width
    return out


def _value(data: bytes, code: int, at: int, kind: T.DataType):
    """One value, read as the schema type; what does not fit it is null."""
    if code in (DOCUMENT, ARRAY):
        fits = isinstance(kind, T.StructType if code == DOCUMENT else T.ArrayType)
        return decode(data, at, kind) if fits else None
    if code == NULL:
        return None
    if code == DOUBLE:
        v = struct.unpack_from("<d", data, at)[0]
    elif code == INT32:
        v = struct.unpack_from("<i", data, at)[0]
    elif code in (INT64, DATE_TIME, TIMESTAMP):
        v = struct.unpack_from("<q", data, at)[0]
    elif code == BOOLEAN:
        v = data[at] == 1
    elif code == OBJECT_ID:
        v = data[at:at + 12].hex()
    else:
        size = struct.unpack_from("<i", data, at)[0]
        v = data[at + 4:at + 3 + size].decode() if code == STRING else bytes(data[at + 5:at + 5 + size])
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else None if isinstance(v, bytes) else str(v)
    if isinstance(kind, T.BooleanType):
        return v if isinstance(v, bool) else None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return int(v) if isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer() else None
    return v if isinstance(kind, T.BinaryType) and isinstance(v, bytes) else None


# ---------------------------------------------------------------- files


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> tuple[pafs.FileSystem, list]:
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at))
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith(SUFFIX)), key=lambda f: f.path)


def _boundaries(fs: pafs.FileSystem, file, split: int) -> list[int]:
    """Offsets at which splits begin: the first document at or behind every multiple of ``split``."""
    if fs.get_file_info(file.path + INDEX).type == pafs.FileType.File:
        with fs.open_input_file(file.path + INDEX) as f:
            offsets = [x[0] for x in struct.iter_unpack("<q", f.read())]
    else:
        offsets = _walk(fs, file)
    cuts, due = [], 0
    for at in offsets:
        if at >= due:
            cuts.append(at)
            due = (at // split + 1) * split
    return cuts


def _walk(fs: pafs.FileSystem, file):
    with fs.open_input_file(file.path) as f:
        at = 0
        while at < file.size:
            yield at
            f.seek(at)
            at += struct.unpack("<i", f.read(4))[0]


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int


class DumpReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split: int):
        self.path, self.schema, self.split = path, schema, split

    def partitions(self) -> list[Split]:
        fs, files = _files(self.path)
        out = []
        for file in files:
            cuts = _boundaries(fs, file, self.split)
            out += [Split(file.path, a, b) for a, b in zip(cuts, [*cuts[1:], file.size])]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split):
        if not partition.file:
            return
        fs, _ = _open(self.path)
        arrow = to_arrow_schema(self.schema)
        rows: list[dict] = []
        with fs.open_input_file(partition.file) as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                head = f.read(4)
                size = struct.unpack("<i", head)[0]
                rows.append(decode(head + f.read(size - 4), 0, self.schema))
                at += size
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


@dataclass
class Written(WriterCommitMessage):
    file: str


class DumpWriter(DataSourceArrowWriter):
    """Tasks write files of their own; those of a failed write are removed."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        # A name of its own for each attempt: a repeated task does not meet its first try.
        file = f"{at}/part-{TaskContext.get().partitionId():05d}-{self.run}-{TaskContext.get().taskAttemptId()}{SUFFIX}"
        offsets, size = [], 0
        with fs.open_output_stream(file + ".tmp") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = encode(row)
                    offsets.append(size)
                    size += out.write(data)
        with fs.open_output_stream(file + INDEX) as out:
            out.write(struct.pack(f"<{len(offsets)}q", *offsets))
        return Written(file)

    def commit(self, messages) -> None:
        fs, at = _open(self.path)
        new = [m.file for m in messages if m is not None]
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                if old.type == pafs.FileType.File and old.path.removesuffix(INDEX).endswith(SUFFIX) and self.run not in old.path:
                    fs.delete_file(old.path)
        for file in new:
            fs.move(file + ".tmp", file)

    def abort(self, messages) -> None:
        fs, at = _open(self.path)
        for file in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if self.run in file.path:
                fs.delete_file(file.path)


class DocDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        raise ValueError(f"{NAME} is read with a schema: spark.read.format('{NAME}').schema(...)")

    def reader(self, schema: T.StructType) -> DumpReader:
        return DumpReader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DumpWriter:
        return DumpWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocDump)
