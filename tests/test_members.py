"""Archives of gzip members: any split of the bytes gives every record once."""

import gzip
import io
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkspark.sources import members, readers, warc


def _record(url: str, body: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _bodies(n: int) -> dict[str, bytes]:
    rng = random.Random(5)
    return {f"http://a/{k}": rng.randbytes(rng.choice((0, 3, 400, 3000))).hex().encode() + (b" WARC/1.0\r\n\r\nWARC/1.1\r\nA: b\r\n\r\n" if k % 4 == 0 else b"") for k in range(n)}


def _split(data: bytes, step: int) -> list[warc.Record]:
    out = []
    for k in range(0, len(data), step):
        out += members.records(io.BytesIO(data), members.Range("f", k, min(len(data), k + step), len(data)))
    return out


@pytest.mark.parametrize("step", [1, 37, 1000, 20_000, 1 << 30])
def test_every_split_gives_every_record_once(step):
    bodies = _bodies(12 if step == 1 else 60)
    raw = [_record(u, b) for u, b in bodies.items()]
    zipped = [gzip.compress(r) for r in raw]
    data = b"".join(zipped) + b"\0" * 9
    got = _split(data, step)
    starts = [sum(map(len, zipped[:k])) for k in range(len(zipped))]
    assert [r.offset for r in got] == starts
    assert [r.field("WARC-Target-URI") for r in got] == list(bodies)
    assert [r.block.partition(warc.GAP)[2] for r in got] == list(bodies.values())


@pytest.mark.parametrize("step", [50, 700, 5000])
def test_members_that_hold_many_records_or_parts_of_one(step):
    bodies = _bodies(40)
    raw = [_record(u, b) for u, b in bodies.items()]
    groups = [b"".join(raw[k : k + 3]) for k in range(0, len(raw), 3)]
    cut = [g[a : a + 900] for g in groups for a in range(0, len(g), 900)]  # of which the first begins with a record
    got = _split(b"".join(gzip.compress(c) for c in cut) + gzip.compress(b""), step)
    assert {r.field("WARC-Target-URI"): r.block.partition(warc.GAP)[2] for r in got} == bodies and len(got) == len(bodies)


def test_files_that_cannot_be_split_are_refused():
    inner = gzip.compress(_record("http://inner/", b"x" * 300))
    outer = gzip.compress(_record("http://outer/", b"y" * 50 + inner * 20), 0)  # not compressed, so the members inside show
    data = outer + gzip.compress(_record("http://next/", b"z"))
    assert [r.field("WARC-Target-URI") for r in _split(data, 1 << 30)] == ["http://outer/", "http://next/"]
    with pytest.raises(ValueError, match="split_bytes=None"):
        _split(data, 1000)
    whole = _record("http://a/", b"before WARC/1.0\r\nA: b\r\n\r\nafter" * 30)
    at = whole.index(b"WARC/1.0", 100)
    with pytest.raises(ValueError, match="split_bytes=None"):  # a member begins with a mark inside of a record
        _split(gzip.compress(whole[:at]) + gzip.compress(whole[at:]), 60)
    with pytest.raises(EOFError):
        _split(data[:-20], 1 << 30)


def test_marks_across_chunks():
    data = b"a" + warc.MARK + b"b" * 20 + warc.MARK + warc.MARK + b"WARC/1"
    for n in (1, 2, 5, 7, 100):
        assert list(members._between_marks(data[k : k + n] for k in range(0, len(data), n))) == data.split(warc.MARK)


def test_one_archive_in_many_tasks(spark, tmp_path):
    """Written and read by Spark; null rows, several files, other kinds of files beside them, and a folder without archives."""
    bodies = {f"http://s/{k}": b"WARC/1.0 text " * (k % 9) + str(k).encode() for k in range(1000)}
    rows = [(k, bytearray(_record(u, b))) for k, (u, b) in enumerate(bodies.items())] + [(1000, None)]
    out = f"file://{tmp_path}/of one file"
    members.write(spark.createDataFrame(rows, "k int, value binary").coalesce(1).sortWithinPartitions("k").select("value"), out)
    (file,) = (tmp_path / "of one file").iterdir()
    assert gzip.decompress(file.read_bytes()) == b"".join(bytes(v) for _, v in rows[:-1])
    expected = sorted((u, b.decode()) for u, b in bodies.items())
    found = readers.warc_crawl(spark, out, split_bytes=file.stat().st_size // 8 + 1)
    assert sorted((r._id, r.content) for r in found.collect()) == expected
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 8 and min(r["count"] for r in tasks) > 50
    (tmp_path / "of one file" / "plain.warc").write_bytes(_record("http://plain/", b"p"))
    assert readers.warc_crawl(spark, out, split_bytes=4000).count() == 1001
    members.write(spark.createDataFrame([(_record("http://more/", b"m").decode(),)], "value string"), out)
    assert readers.warc_crawl(spark, out, split_bytes=1 << 20).count() == 1002
    assert members.read(spark, []).count() == 0
    empty = f"file://{tmp_path}/none"
    members.write(spark.createDataFrame([], "value string"), empty)
    assert (tmp_path / "none").is_dir() and not list((tmp_path / "none").iterdir())


def test_tasks_give_back_what_arrow_keeps(monkeypatch, tmp_path):
    """After each batch, when it is written, read and worked on: so memory doesn't depend on how many there are."""
    given = []
    monkeypatch.setattr(warc, "give_back", lambda: given.append(1))
    bodies = [b"%d" % k + b"x" * (3 << 20) for k in range(6)]
    values = [pa.RecordBatch.from_arrays([pa.array([_record(f"http://g/{k}", b)], pa.binary())], names=["value"]) for k, b in enumerate(bodies)]
    writer = members._Writer(str(tmp_path / "out"))
    writer.commit([writer.write(iter(values))])
    assert len(given) == 6
    (file,) = (tmp_path / "out").iterdir()
    size = file.stat().st_size
    read = list(members._Reader([str(file)], 0).read(members.Range(str(file), 0, size, size)))
    assert len(read) > 2 and len(given) == 6 + 3
    frame = SimpleNamespace(mapInArrow=lambda run, ddl: list(run(iter(read))))
    pages = warc._worked(frame, lambda rows: (warc.Record(*r) for r in rows), warc.page, pa.schema([("_id", pa.string()), ("content", pa.string())]), "")
    assert [c.encode() for b in pages for c in b.column(1).to_pylist()] == bodies and len(given) == 9 + 3
