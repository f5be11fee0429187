"""Avro object-container files as a Python data source, for clusters without the avro package.

    spark.dataSource.register(AvroOcf)
    spark.read.format("avro_ocf").schema(EVENT).load(path)
    df.write.format("avro_ocf").mode("append").save(path)

Flat records of string, int, long, boolean, float, double and nullable unions of them; null and deflate codecs. A task reads
files of TASK_BYTES together, or one that is larger; it writes files of at most FILE_ROWS rows, under temporary names until the job commits. With the option folder_by each value
of that column has a folder of its own, column=value, and mode overwrite replaces the files of those folders that get rows. Paths are local or of any store that pyarrow opens.
"""

from __future__ import annotations

import io
import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lumenflow.operators.checks import validated
from lumenflow.schemas import EVENT, avro_record

MAGIC, BLOCK_ROWS, FILE_ROWS, TASK_BYTES = b"Obj\x01", 4_000, 200_000, 1 << 22


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def put_long(out: io.BytesIO, n: int) -> None:
    z = (n << 1) ^ (n >> 63)
    while z > 0x7F:
        out.write(bytes((z & 0x7F | 0x80,)))
        z >>= 7
    out.write(bytes((z,)))


def get_long(f: io.BytesIO) -> int:
    z = shift = 0
    while True:
        b = f.read(1)
        if not b:
            raise EOFError("the file ends inside a number")
        z |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (z >> 1) ^ -(z & 1)
        shift += 7


def put_bytes(out: io.BytesIO, b: bytes) -> None:
    put_long(out, len(b))
    out.write(b)


def get_bytes(f: io.BytesIO) -> bytes:
    n = get_long(f)
    b = f.read(n)
    if len(b) < n:
        raise EOFError("the file ends inside a value")
    return b


def _base(kind: object) -> str:
    return kind["type"] if isinstance(kind, dict) else kind


def put_value(out: io.BytesIO, kind: object, v: object) -> None:
    if isinstance(kind, list):
        branch = next(i for i, k in enumerate(kind) if (k == "null") == (v is None))
        put_long(out, branch)
        if v is not None:
            put_value(out, kind[branch], v)
        return
    base = _base(kind)
    if v is None:
        raise ValueError("null in a field that isn't nullable")
    if base == "string":
        put_bytes(out, v.encode())
    elif base in ("int", "long"):
        if isinstance(v, bool):
            raise TypeError("a boolean isn't a number")
        put_long(out, int(v))
    elif base == "boolean":
        out.write(b"\x01" if v else b"\x00")
    else:
        out.write(struct.pack("<f" if base == "float" else "<d", v))


def get_value(f: io.BytesIO, kind: object) -> object:
    if isinstance(kind, list):
        return get_value(f, kind[get_long(f)])
    base = _base(kind)
    if base == "null":
        return None
    if base == "string":
        return get_bytes(f).decode()
    if base in ("int", "long"):
        return get_long(f)
    if base == "boolean":
        return f.read(1) == b"\x01"
    if base in ("float", "double"):
        size = 4 if base == "float" else 8
        return struct.unpack("<f" if size == 4 else "<d", f.read(size))[0]
    raise ValueError(f"type {base} isn't supported")


def encode(schema: dict, rows: Iterator[dict], codec: str = "null", sync: bytes | None = None) -> bytes:
    """A whole object-container file."""
    sync, out = sync or uuid.uuid4().bytes, io.BytesIO()
    out.write(MAGIC)
    put_long(out, 2)
    for key, value in (("avro.schema", json.dumps(schema).encode()), ("avro.codec", codec.encode())):
        put_bytes(out, key.encode())
        put_bytes(out, value)
    put_long(out, 0)
    out.write(sync)
    block, n = io.BytesIO(), 0

    def flush() -> None:
        nonlocal block, n
        if n:
            data = block.getvalue()
            if codec == "deflate":
                c = zlib.compressobj(wbits=-15)
                data = c.compress(data) + c.flush()
            put_long(out, n)
            put_bytes(out, data)
            out.write(sync)
        block, n = io.BytesIO(), 0

    for row in rows:
        for field in schema["fields"]:
            put_value(block, field["type"], row.get(field["name"]))
        n += 1
        if n == BLOCK_ROWS:
            flush()
    flush()
    return out.getvalue()


def decode(data: bytes) -> Iterator[dict]:
    """The records of an object-container file; a wrong magic or sync marker is a ValueError."""
    f = io.BytesIO(data)
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro object-container file")
    meta: dict[str, bytes] = {}
    while n := get_long(f):
        if n < 0:  # a negative count is followed by the block's size in bytes
            n = -n
            get_long(f)
        for _ in range(n):
            key = get_bytes(f).decode()
            meta[key] = get_bytes(f)
    schema, codec, sync = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)
    while f.tell() < len(data):
        n, block = get_long(f), get_bytes(f)
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        elif codec != "null":
            raise ValueError(f"codec {codec} isn't supported")
        rows = io.BytesIO(block)
        for _ in range(n):
            yield {field["name"]: get_value(rows, field["type"]) for field in schema["fields"]}
        if f.read(16) != sync:
            raise ValueError("a block doesn't end with the file's sync marker")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        fs, path = _fs(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pafs.FileType.File else sorted((i for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.path.endswith(".avro")), key=lambda i: i.path)
        out, held = [_Files([])], 0
        for i in files:
            if held and held + i.size > TASK_BYTES:
                out.append(_Files([]))
                held = 0
            out[-1].paths.append(i.path)
            held += i.size
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs = _fs(self.path)[0]
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                data = f.read()
            for row in decode(data):
                yield tuple(row.get(n) for n in self.names)


class _Done(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, codec: str, overwrite: bool, folder_by: str | None):
        self.path, self.codec, self.overwrite, self.folder_by = path, codec, overwrite, folder_by
        self.names = schema.names
        self.schema = StructType([f for f in schema if f.name != folder_by])

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, root = _fs(self.path)
        record, place = avro_record("Record", self.schema), self.names.index(self.folder_by) if self.folder_by else None
        done: list[str] = []
        try:
            for value, some in itertools.groupby(rows, key=lambda r: None if place is None else r[place]):
                folder = root if place is None else f"{root}/{self.folder_by}={value}"
                fs.create_dir(folder, recursive=True)
                while part := list(itertools.islice(some, FILE_ROWS)):
                    done.append(f"{folder}/.part-{uuid.uuid4().hex}.tmp")
                    with fs.open_output_stream(done[-1]) as f:
                        f.write(encode(record, ({n: v for n, v in zip(self.names, r) if n != self.folder_by} for r in part), self.codec))
        except BaseException:
            for path in done:
                fs.delete_file(path)
            raise
        return _Done(done)

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        made = [p for m in messages if m is not None for p in m.paths]
        if self.overwrite:
            for folder in {os.path.dirname(p) for p in made} | ({root} if self.folder_by is None else set()):
                for info in fs.get_file_info(pafs.FileSelector(folder, recursive=self.folder_by is None, allow_not_found=True)):
                    if info.path.endswith(".avro"):
                        fs.delete_file(info.path)
        for path in made:
            head, name = os.path.split(path)
            fs.move(path, f"{head}/{name[1:-4]}.avro")

    def abort(self, messages: list) -> None:
        for m in messages:
            for path in m.paths if m is not None else ():
                _fs(self.path)[0].delete_file(path)


class AvroOcf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "avro_ocf"

    def schema(self) -> StructType:
        return EVENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, self.options.get("codec", "null"), overwrite, self.options.get("folder_by"))


def read_events(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Stream events below path. A path that is missing or holds no file is a FileNotFoundError, or an empty table if missing_ok."""
    fs, local = _fs(path)
    kind = fs.get_file_info(local).type
    found = kind == pafs.FileType.File or kind == pafs.FileType.Directory and any(i.path.endswith(".avro") for i in fs.get_file_info(pafs.FileSelector(local, recursive=True)))
    if not found:
        if missing_ok:
            return spark.createDataFrame([], EVENT)
        raise FileNotFoundError(path)
    spark.dataSource.register(AvroOcf)
    return spark.read.format("avro_ocf").schema(EVENT).load(path)


def write_hourly(events: DataFrame, path: str, files: int = 1) -> None:
    """hour=YYYYMMDDHH folders of Avro files, by event time in UTC, in one job; every hour that has events is replaced.

    Events are validated first: a missing or additional column, another type or a null in a required field writes nothing. files: tasks that share an hour.
    """
    spark = events.sparkSession
    spark.dataSource.register(AvroOcf)
    rows = validated(events, EVENT).withColumn("hour", F.date_format(F.timestamp_millis("event_timestamp"), "yyyyMMddHH"))
    dealt = rows.repartition("hour", F.pmod(F.xxhash64("event_id"), F.lit(files))).sortWithinPartitions("hour")
    dealt.write.format("avro_ocf").mode("overwrite").option("folder_by", "hour").save(path)
