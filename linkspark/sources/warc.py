"""WARC archives: records framed by their Content-Length, payloads decoded by their charset.

Spark cuts an archive at every ``WARC/1.`` and streams the pieces, so a task holds one record, not one file,
and anything that Spark can open can be read. A piece is put back where it is no record of its own but text
inside one, which the Content-Length of the record before it tells. That takes the pieces in the order of the
file: one task reads a gzip archive from end to end; of one that Spark may split, the pieces are brought
together again and sorted by their place.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How a record starts, what ends a header, and what follows a record.
MARK = b"WARC/1."
GAP = b"\r\n\r\n"
# The ends of names of files that Spark never splits.
WHOLE_FILES = (".gz", ".deflate", ".zst", ".lz4", ".snappy")

_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r?$")
_HEADER = re.compile(rb"(?:\d\r\n)?(?:[A-Za-z-]+:[^\r\n]*\r\n)+\r\n")
_VERSION = re.compile(rb"\d?\s*\Z")
_CHARSET = re.compile(rb"(?i)charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)")
#: Of a page, in which it may name its own charset.
_META_BYTES = 4096


@dataclass(frozen=True)
class Record:
    """A record of an archive. offset and size count bytes of the uncompressed archive."""

    file: str
    offset: int
    size: int
    header: bytes
    block: bytes

    def field(self, name: str) -> str | None:
        """The value of a named field of the header, without white space around it."""
        m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", self.header)
        return m[1].decode("utf-8", "replace").strip() if m else None


def frame(pieces: Iterable[tuple[str, bytes]]) -> Iterator[Record]:
    """Records of (file, bytes between marks), given in the order of the file.

    A record without Content-Length reaches to the next piece with a header. A first record may lack its mark.
    """
    here: str | None = None
    held: list[bytes] = []  # pieces of the record that is being put together
    at = begin = missing = 0
    sized = False

    def whole() -> Record:
        data = MARK.join(held)
        head, _, rest = data.partition(GAP)
        block = rest[: int(_LENGTH.search(head)[1])] if sized else rest.removesuffix(GAP)
        return Record(here, begin, len(MARK) + len(data), head, block)

    for file, data in pieces:
        mark = len(MARK)
        if file != here:
            if held:
                yield whole()
            here, held, missing, at, mark = file, [], 0, 0, 0  # the first piece stands before the first mark
        if held and missing > 0:
            held.append(data)
            missing -= mark + len(data)
        elif header := _HEADER.match(data):
            if held:
                yield whole()
            held, begin = [data], at
            length = _LENGTH.search(header[0])
            sized = length is not None
            missing = int(length[1]) - (len(data) - header.end()) if sized else 0
        elif held and not sized and not _VERSION.match(data):
            held.append(data)
        at += mark + len(data)
    if held:
        yield whole()


def names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The full names of the files at ``path``, without escapes, as Spark's readers take them."""
    return [unquote(n) for n in spark.read.text(path).inputFiles()]


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, data) in the order of each file, no file in two partitions."""
    text = spark.read.option("lineSep", MARK.decode())
    columns = [F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("data")]
    found = names(spark, path)
    loose = [n for n in found if not n.endswith(WHOLE_FILES)]
    if not loose:
        return text.text(path).select(*columns)
    place = [F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")]
    out = text.text(loose).select(*columns, *place).repartition("file").sortWithinPartitions("file", "split", "row").select("file", "data")
    if len(loose) < len(found):
        out = out.unionAll(text.option("pathGlobFilter", "{" + ",".join(f"*{e}" for e in WHOLE_FILES) + "}").text(path).select(*columns))
    return out


def read(spark: SparkSession, path: str, work: Callable[[Record], tuple | None], schema: pa.Schema, ddl: str, split_bytes: int | None = None) -> DataFrame:
    """A row for each record for which ``work`` gives one, made in the tasks that read the archives.

    With ``split_bytes``, gzip archives are read in ranges of so many bytes as ``members`` has it, and the offsets of
    their records are those of the compressed members.
    """
    if split_bytes is None:
        return _worked(_pieces(spark, path), lambda rows: frame(rows), work, schema, ddl)
    from linkspark.sources import members

    found = names(spark, path)
    zipped = [n for n in found if n.endswith(".gz")]
    others = [n for n in found if not n.endswith(".gz")]
    out = _worked(members.read(spark, zipped, split_bytes), lambda rows: (Record(*r) for r in rows), work, schema, ddl)
    return out.unionAll(_worked(_pieces(spark, others), lambda rows: frame(rows), work, schema, ddl)) if others else out


def _worked(source: DataFrame, records: Callable[[Iterator[tuple]], Iterator[Record]], work: Callable[[Record], tuple | None], schema: pa.Schema, ddl: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for record in records(rows(batches)):
            row = work(record)
            if row is not None:
                out.append(row)
            held += record.size
            if out and (len(out) >= 1000 or held >= 4 << 20):
                yield batch(out, schema)
                out, held = [], 0
                give_back()
        if out:
            yield batch(out, schema)

    return source.mapInArrow(run, ddl)


def give_back() -> None:
    """To the system what Arrow keeps of earlier batches, which differ in size: else a worker grows for as long as it runs."""
    pa.default_memory_pool().release_unused()


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def decoded(http_header: bytes, body: bytes) -> str:
    """A body as text: by the charset of its HTTP header, else by the one that the page names, else as UTF-8."""
    content_type = re.search(rb"(?im)^Content-Type:[^\r\n]*", http_header)
    m = content_type and _CHARSET.search(content_type[0]) or _CHARSET.search(body, 0, _META_BYTES)
    name = m[1].decode("ascii") if m else "utf-8"
    try:
        codec = codecs.lookup(name).name
        return body.decode(codec, "replace")
    except (LookupError, UnicodeError):  # an unknown name, or a codec that isn't of text
        return body.decode("utf-8", "replace")


def page(record: Record) -> tuple[str, str] | None:
    """(URL, content) of a record whose payload is an HTTP answer 200 OK; else None."""
    url = record.field("WARC-Target-URI")
    head, gap, body = record.block.partition(GAP)
    top = head[:15]
    if not url or not gap or not top.startswith(b"HTTP/") or not top.endswith(b"200 OK"):
        return None
    return url.strip("<>"), decoded(head, body)


def pages(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(_id, content) of the pages of all archives at ``path``."""
    return read(spark, path, page, pa.schema([("_id", pa.string()), ("content", pa.string())]), "_id string, content string", split_bytes)
