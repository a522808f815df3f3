"""WARC archives of pages, and their capture index by an external merge.

Writing: a page becomes a response record, or, where pages have equal payloads
of at least ``min_bytes`` bytes, a revisit of the one with the largest id. The
join that finds them takes payload digests and is skewed at worst, which
adaptive execution splits; Spark writes the records as gzip text.

Index: each task that reads archives sorts its captures by URL key, timestamp
and record id, and stores them as a run. Ranges of that order, bounded in rows,
then get their stretch of every run, and a loser tree merges the k runs in each
range: one comparison a level for every capture. Ranges follow each other, so
the index is ordered as a whole, and a URL that was captured without end fills
several ranges. ``position`` numbers it without gaps.

Defined results: a null payload is empty; very long payloads are one record
each; among equal payloads ids compare as they are, null ids are least, and of
rows with the same id and payload any one is the response; a revisit of a
record without id refers to null; a null URL has an empty key and comes first;
line breaks in URLs are percent-encoded; an empty table gives an empty index;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.storage import Scratch, quoted
from linkspark.sources import warc

# base32's digits, and the profile of records that repeat a payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"

#: Captures that a merging task holds.
RANGE_ROWS = 200_000
#: Where pages have no date: this second and as many more as their id says, modulo a thousand million; ids that are no numbers count as 0.
FIRST_SECOND = 1_577_836_800


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four of base32's."""

    def four(k: int) -> list[Column]:
        twenty = F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(twenty, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)]

    return F.concat(*(c for k in range(8) for c in four(k)))


def url_key(url: Column) -> Column:
    """A sortable form of a URL: labels of the host from the top, in lower case, then what follows it, without scheme and fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*\z", ""), r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"(?s)\A[^/?]*", 0)
    labels = F.array_join(F.reverse(F.split(F.lower(host), r"\.", -1)), ",")
    return F.when(bare == "", "").otherwise(F.concat(labels, F.lit(")"), F.substring(bare, F.length(host) + 1, F.length(bare))))


def write_archives(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None, min_bytes: int = 0) -> None:
    """Writes a record for each page under ``out``. date: a timestamp column."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    number = F.col(quoted(page_id))
    seconds = F.coalesce(F.pmod(number.cast("string").try_cast("bigint"), F.lit(10**9)), F.lit(0))
    second = F.timestamp_seconds(F.lit(FIRST_SECOND) + seconds)
    when = F.coalesce(F.col(quoted(date)), second) if date else second
    utc = F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(
        number.alias("id"),
        F.regexp_replace(F.regexp_replace(F.col(quoted(url)).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        utc.alias("date"),
        F.coalesce(F.col(quoted(payload)).cast("string"), F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.put(rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload")), "rows")  # row numbers hold from here on
    own = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("first"))
    firsts = scratch.put(own.where("n > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")), "firsts")
    joined = rows.join(firsts, "digest", "left")
    repeats = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))

    def urn(of: str, row: str) -> Column:
        return F.concat(F.lit(f"<{_URN}"), F.coalesce(F.url_encode(F.col(of).cast("string")), F.lit("")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))

    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(repeats, head).otherwise(F.concat(head, F.col("payload")))

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(repeats, "revisit").otherwise("response")),
        field("WARC-Record-ID", urn("id", "row")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(repeats, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", urn("first_id", "first_row")))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        field("Content-Length", F.octet_length("__block").cast("string")),
        F.lit("\r\n"),
        F.col("__block"),
    )
    joined.withColumn("__block", block).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(out)
    scratch.drop(rows, firsts)


_CAPTURE = "page string, record_id string, timestamp string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, file string, offset long, size long"
_CAPTURE_FIELDS = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (f.split() for f in _CAPTURE.split(", "))])


def _capture(record: warc.Record) -> tuple | None:
    """What the index says about a response or revisit; a response's figures are those of the bytes that were read."""
    kind = record.field("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    head, _, body = record.block.partition(warc.GAP)
    if kind == "response":
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
    else:
        length = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", head)
        size, digest = int(length[1]) if length else None, (record.field("WARC-Payload-Digest") or "").removeprefix("sha1:")
    own = record.field("WARC-Record-ID") or ""
    stamp = re.sub(r"\D", "", record.field("WARC-Date") or "")[:14]
    return _page_of(own), own.strip("<>"), stamp, record.field("WARC-Target-URI"), kind, size, digest, _page_of(record.field("WARC-Refers-To") or ""), record.file, record.offset, record.size


def _page_of(urn: str) -> str | None:
    """The page id in a record id; None without one."""
    page = urn.strip("<>").removeprefix(_URN).rpartition(":")[0]
    return unquote(page.replace("+", " ")) if page else None


def captures(spark: SparkSession, archives: str) -> DataFrame:
    """A row for each response and revisit in the archives, in the order of their files."""
    return warc.read(spark, archives, _capture, _CAPTURE_FIELDS, _CAPTURE)


def merged(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, place in it) of all keys in ascending order, of sorted runs, by a tree of losers.

    A node keeps the run that lost there, and the winner goes up. When the winner's next key takes its place,
    it meets only the losers on its way up. Equal keys come in the order of their runs.
    """
    k = len(runs)
    if not k:
        return
    at = [0] * k
    key: list[tuple] = [(0, *r[0], i) if r else (1,) for i, r in enumerate(runs)]
    losers = [-1] * k
    for leaf in range(k):
        winner, node = leaf, (leaf + k) // 2
        while node and losers[node] >= 0:
            if key[losers[node]] < key[winner]:
                winner, losers[node] = losers[node], winner
            node //= 2
        losers[node] = winner
    while key[best := losers[0]][0] == 0:
        yield best, at[best]
        at[best] += 1
        key[best] = (0, *runs[best][at[best]], best) if at[best] < len(runs[best]) else (1,)
        winner, node = best, (best + k) // 2
        while node:
            if key[losers[node]] < key[winner]:
                winner, losers[node] = losers[node], winner
            node //= 2
        losers[0] = winner


_KEY = ["url_key", "timestamp", "record_id"]


def capture_index(found: DataFrame) -> DataFrame:
    """The captures with url_key and position, which numbers them by URL key, timestamp and record id."""
    spark = found.sparkSession
    scratch = Scratch(spark, "index")
    order = [*_KEY, "file", "offset"]
    runs = scratch.put(found.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id()), "runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    schema = runs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        columns = [rows.column(c).to_pylist() for c in ("run", *order)]
        keys = list(zip(*columns[1:], strict=True))
        runs, starts = [], []
        for k, key in enumerate(keys):  # what came of a run in one piece ascends
            if k == 0 or columns[0][k] != columns[0][k - 1] or key < keys[k - 1]:
                runs.append([])
                starts.append(k)
            runs[-1].append(key)
        take = np.fromiter((starts[r] + i for r, i in merged(runs)), np.int64, len(keys))
        for begin in range(0, len(take), 5000):
            yield from rows.take(pa.array(take[begin : begin + 5000])).combine_chunks().to_batches()

    done = runs.repartitionByRange(ranges, *order).mapInArrow(run, schema)
    done = scratch.put(done.drop("run").withColumn("__at", F.monotonically_increasing_id()), "merged")
    scratch.drop(runs)
    part = F.shiftright("__at", 33)
    base, before = [], 0
    for p, n in sorted(tuple(r) for r in done.groupBy(part).count().collect()):  # as many as there are ranges
        base.append((p, before))
        before += n
    offsets = spark.createDataFrame(base or [(0, 0)], "__part long, __before long")
    placed = done.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    position = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.select(*(c for c in done.columns if c != "__at"), position.alias("position"))


def index_lines(index: DataFrame) -> Column:
    """Lines of a CDXJ file: URL key, timestamp, and the rest as JSON."""
    rest = F.to_json(F.struct("url", "record_type", "payload_digest", "payload_bytes", "file", "offset", "size"))
    return F.concat_ws(" ", index["url_key"], index["timestamp"], rest).alias("value")
