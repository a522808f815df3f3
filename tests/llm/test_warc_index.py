"""Archives and their index against plain Python."""

import base64
import glob
import gzip
import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from linkspark.llm import warc_index as W
from linkspark.sources import readers


def plain_key(url):
    bare = (url or "").split("#", 1)[0].split("://", 1)[-1]
    host = bare.replace("?", "/", 1).split("/", 1)[0] if bare else ""
    return f"{','.join(reversed(host.lower().split('.')))}){bare[len(host):]}" if bare else ""


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    bodies = [None, "", "<p>é𝄞</p>", "WARC/1.1\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\n", "\r\n\r\n", "x" * 400_000] + [f"<p>{k}</p>" for k in range(30)]
    urls = [None, "http://b.example.org/x?y=1#z", "https://a.example.org", "no scheme/at all", "http://h/line\r\nbreak: x", "http://é.org/ü"]
    rows = [(k, rng.choice(urls), rng.choice(bodies), "clash", "odd") for k in range(300)]
    rows += [(7, "http://again/", "<p>1</p>", "c", "o")] * 3 + [(None, "http://none/", "<p>2</p>", "c", "o"), (None, "http://none/", "only without id", "c", "o"), (None, "http://none/", "only without id", "c", "o")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, position string, `a.b` string").repartition(5)


def index_of(spark, pages, where, **options):
    W.write_archives(pages, str(where), **options)
    return W.capture_index(W.captures(spark, str(where)))


def test_round_trip(spark, pages, tmp_path):
    index = index_of(spark, pages, tmp_path / "w")
    got = index.orderBy("position").collect()
    given = [(r.page_id, r.url, (r.html or "").encode()) for r in pages.collect()]
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    first = {}
    for i, _, b in given:
        first[b] = max(first.get(b, -1), -1 if i is None else i)
    assert sorted((str(r.page), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len(b), digest(b)) for i, _, b in given)
    own = {digest(b): i for b, i in first.items()}
    seen = set()
    for r in got:
        if r.record_type == "response":
            assert r.refers_to is None and int(r.page or -1) == own[r.payload_digest] and r.payload_digest not in seen
            seen.add(r.payload_digest)
        else:
            assert int(r.refers_to or -1) == own[r.payload_digest]
    assert len(seen) == len(first)
    keys = [(r.url_key, r.timestamp, r.record_id) for r in got]
    assert keys == sorted(keys) and [r.position for r in got] == list(range(len(given)))
    assert {r.url_key for r in got} == {plain_key(u and u.replace("\r", "%0D").replace("\n", "%0A")) for _, u, _ in given}
    files = {f.replace("//", "/"): gzip.open(f).read() for f in glob.glob(str(tmp_path / "w" / "*.gz"))}
    for r in got:  # the index leads to the record
        record = files[r.file.removeprefix("file:")][r.offset : r.offset + r.size]
        assert record.startswith(b"WARC/1.1\r\n") and f"<{r.record_id}>".encode() in record and record.endswith(b"\r\n\r\n")


def test_crawl_of_it(spark, pages, tmp_path):
    """Responses are pages of a crawl to the core's reader."""
    W.write_archives(pages.where("url LIKE 'http%org%'"), str(tmp_path / "w"), min_bytes=1 << 30)
    got = sorted((r._id, r.content) for r in readers.warc_crawl(spark, str(tmp_path / "w")).collect())
    assert got == sorted((r.url, r.html or "") for r in pages.where("url LIKE 'http%org%'").collect()) and got


def test_least_size_and_dates(spark, pages, tmp_path):
    dated = pages.withColumn("seen", F.timestamp_seconds(F.lit(1_000_000_000) - F.coalesce("page_id", F.lit(0))))
    index = index_of(spark, dated, tmp_path / "w", min_bytes=9, date="seen")
    assert {r.record_type for r in index.where("payload_bytes < 9").collect()} == {"response"}
    assert index.where("payload_bytes >= 9 AND record_type = 'revisit'").count() > 0
    assert index.agg(F.max("timestamp")).first()[0] == "20010909014640"
    line = index.orderBy("position").select(W.index_lines(index)).first().value
    assert line.startswith(" 2001") and '"record_type":' in line


def test_string_ids_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a:b c/%", "http://x/", "same"), ("ü", "http://y/", "same"), ("z", "http://z/", "other")], "page_id string, url string, html string")
    got = {r.page: (r.record_type, r.refers_to) for r in index_of(spark, rows, tmp_path / "w").collect()}
    assert got == {"a:b c/%": ("revisit", "ü"), "ü": ("response", None), "z": ("response", None)}
    assert index_of(spark, rows.where("page_id = ''"), tmp_path / "none").count() == 0


def test_hot_url_takes_several_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", 500)
    rows = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 < 2, "http://hot/").otherwise(F.concat(F.lit("http://h"), F.col("id"))).alias("url"), F.lit("same").alias("html")).repartition(6)
    index = index_of(spark, rows, tmp_path / "w")
    got = index.orderBy("position").collect()
    keys = [(r.url_key, r.timestamp, r.record_id) for r in got]
    assert keys == sorted(keys) and [r.position for r in got] == list(range(6000)) and sum(r.record_type == "response" for r in got) == 1
    held = index.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 1 and {r.refers_to for r in got} == {None, "5999"}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    for _ in range(50):
        runs = [sorted((rng.randint(0, 9), rng.choice("ab")) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        got = list(W.merged(runs))
        assert [runs[r][i] for r, i in got] == list(heapq.merge(*runs)) and len(set(got)) == sum(map(len, runs))
        assert all(a < b for a, b in zip(got, got[1:], strict=False) if runs[a[0]][a[1]] == runs[b[0]][b[1]])
