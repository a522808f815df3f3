"""WARC archives of gzip members, as a data source: one archive is read and written by many tasks.

Crawls compress each record as a gzip member of its own, so an archive can be entered at any member. A task is given
a range of bytes. It begins at the first member in the range whose content begins with a record, and ends before the
first such member behind it, where the task of a later range begins; so every record is read once, and nothing is
indexed beforehand. Records may be cut by members, and a member may hold many records.

A task also looks for the place where the next range begins. Where that is not the place at which its own members end
(an archive in an archive, in a block that isn't compressed) or lies inside a record, it raises an error, rather than
read a record twice or cut it: such a file wants ``split_bytes=None``.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from linkspark.sources import warc

NAME = "warc_members"
SPLIT_BYTES = 64 << 20
# Fixed value: how a gzip member starts.
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
_FIELDS = pa.schema([("file", pa.string()), ("member", pa.int64()), ("size", pa.int64()), ("header", pa.binary()), ("block", pa.binary())])
_DDL = "file string, member long, size long, header binary, block binary"


@dataclass(frozen=True)
class Range(InputPartition):
    """Bytes of a file of ``size`` bytes."""

    file: str
    begin: int
    end: int
    size: int


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a name as ``warc.names`` has it, and the path there."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or uri).lstrip("/")
    return fs.FileSystem.from_uri(quote(uri.replace("s3a://", "s3://", 1), safe=":/@"))


def _contents(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset of its member, bytes) from the member at ``at`` to the end of the file.

    The first bytes of a member are as many as a mark has, unless it holds fewer.
    """
    f.seek(at)
    raw = f.read(_READ)
    while raw:
        bare = raw.lstrip(b"\0")  # padding
        at += len(raw) - len(bare)
        raw = bare or f.read(_READ)
        if not bare:
            continue
        member, inflate, held = at, zlib.decompressobj(31), b""
        while not inflate.eof:
            raw = raw or f.read(_READ)
            data = inflate.decompress(raw, _READ)
            if not raw and not data and not inflate.eof:
                raise EOFError(f"the file ends inside of the gzip member at {member}")
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            at, raw, held = at + len(raw) - len(rest), rest, held + data
            if len(held) >= len(warc.MARK) or inflate.eof:
                yield member, held
                held = b""
        raw = raw or f.read(_READ)


def _starts_record(f, at: int) -> bool:
    f.seek(at)
    inflate, head = zlib.decompressobj(31), b""
    try:
        while len(head) < len(warc.MARK) and not inflate.eof and (raw := f.read(4096)):
            head += inflate.decompress(raw, len(warc.MARK))
    except zlib.error:
        return False
    return head.startswith(warc.MARK)


def first_record(f, at: int, size: int) -> int:
    """The offset of the first member from ``at`` on whose content begins with a record, or ``size``."""
    while at < size:
        f.seek(at)
        data = f.read(_READ)
        k = data.find(MAGIC)
        while k >= 0:
            if _starts_record(f, at + k):
                return at + k
            k = data.find(MAGIC, k + 1)
        at += max(1, len(data) - len(MAGIC) + 1)
    return size


def _between_marks(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The pieces that the marks separate, whatever chunks the bytes come in."""
    held: list[bytes] = []
    tail = b""
    for chunk in chunks:
        *ended, last = (tail + chunk).split(warc.MARK)
        if ended:
            yield b"".join(held) + ended[0]
            yield from ended[1:]
            held = []
        cut = max(0, len(last) - len(warc.MARK) + 1)
        held.append(last[:cut])
        tail = last[cut:]
    yield b"".join(held) + tail


def records(f, part: Range) -> Iterator[warc.Record]:
    """The records of a range; their ``offset`` is that of the member in which they begin."""
    first = first_record(f, part.begin, part.size) if part.begin else 0
    if first >= part.end:
        return
    starts: list[int] = []  # of members, in the bytes without compression
    members: list[int] = []
    stop = part.size

    def chunks() -> Iterator[bytes]:
        nonlocal stop
        n = 0
        for member, data in _contents(f, first):
            if not members or member != members[-1]:
                if member >= part.end and data.startswith(warc.MARK):
                    stop = member
                    return
                members.append(member)
                starts.append(n)
            n += len(data)
            yield data

    record = None
    for record in warc.frame((part.file, piece) for piece in _between_marks(chunks())):
        at = members[bisect_right(starts, record.offset) - 1]
        yield warc.Record(record.file, at, record.size, record.header, record.block)
    if part.end < part.size:
        length = record.field("Content-Length") if record else None
        cut = length and length.isdigit() and len(record.block) < int(length) and stop < part.size
        if cut or first_record(f, part.end, part.size) != stop:
            raise ValueError(f"{part.file} can't be split at {part.end}, which lies inside of a record: read it with split_bytes=None")


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], split_bytes: int):
        self.files, self.split_bytes = files, split_bytes

    def partitions(self) -> list[Range]:
        out = []
        for file in self.files:
            store, path = _store(file)
            size = store.get_file_info(path).size
            step = self.split_bytes or max(1, size)
            out += [Range(file, k, min(size, k + step), size) for k in range(0, size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, path = _store(partition.file)
        rows: list[tuple] = []
        held = 0
        with store.open_input_file(path) as f:
            for r in records(f, partition):
                rows.append((r.file, r.offset, r.size, r.header, r.block))
                held += r.size
                if len(rows) >= 1000 or held >= 4 << 20:
                    yield warc.batch(rows, _FIELDS)
                    rows, held = [], 0
                    warc.give_back()
        if rows:
            yield warc.batch(rows, _FIELDS)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Each task writes a file of its own into a folder that readers pass over; the driver moves those of tasks that count."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.own = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _store(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out = None
        try:
            for batch in iterator:
                for value in batch.column(0):
                    data = value.as_py()
                    if data is None:
                        continue
                    if out is None:
                        store.create_dir(f"{folder}/{self.own}")
                        out = store.open_output_stream(f"{folder}/{self.own}/{name}", compression=None)
                    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(deflate.compress(data.encode() if isinstance(data, str) else data) + deflate.flush())
                warc.give_back()
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{folder}/{self.own}/{m.name}", f"{folder}/{m.name}")
        self._clear(store, folder)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(f"{folder}/{self.own}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.own}")


class WarcMembers(DataSource):
    """``files``: names in a JSON list, to read; ``splitBytes``: of a task, 0 for whole files; ``path``: a folder, to write."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["files"]), int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("archives are only added to a folder")
        return _Writer(self.options["path"])


def read(spark: SparkSession, files: list[str], split_bytes: int | None = SPLIT_BYTES) -> DataFrame:
    """(file, member, size, header, block): the records of gzip archives. member: the offset of that in which a record begins; size: without compression."""
    spark.dataSource.register(WarcMembers)
    return spark.read.format(NAME).option("files", json.dumps(files)).option("splitBytes", split_bytes or 0).load()


def write(values: DataFrame, path: str) -> None:
    """Adds archives to the folder ``path``, one for each task, with a member for each row. values: one column of whole records, text or bytes; nulls are passed over."""
    spark = values.sparkSession
    spark.dataSource.register(WarcMembers)
    values.select(F.col(f"`{values.columns[0]}`").cast("binary").alias("value")).write.format(NAME).mode("append").save(path)
