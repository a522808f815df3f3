import base64
import bz2
import gzip
import json
import pickle
import random

import pytest
from pyspark.sql import functions as F

from linkspark import cli, schemas
from linkspark.operators import languages, terms
from linkspark.plans import corpora
from linkspark.sources import readers, warc, writers
from linkspark.streaming import documents as streaming

XML = """<mediawiki>
<page>
    <title>Foo Bar</title><ns>0</ns><id>12</id>
    <revision><text xml:space="preserve">'''Foo''' likes [[old name|Baz]]. {{t|{{x}}}}</text></revision>
  </page>
<page>
    <title>Old name</title><ns>0</ns><id>13</id><redirect title="new name" />
    <revision><text xml:space="preserve">#REDIRECT</text></revision>
  </page>
<page>
    <title>Talk:Foo</title><ns>1</ns><id>14</id>
    <revision><text xml:space="preserve">talk</text></revision>
  </page>
<page>
    <title>Empty</title><ns>0</ns><id>15</id>
    <revision><text xml:space="preserve" /></revision>
  </page>
</mediawiki>
"""


def test_wiki(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(XML)
    pages = readers.wiki_dump(spark, str(tmp_path / "dump.xml"))
    got = {r._id: r for r in pages.collect()}
    w = "en.wikipedia.org/wiki/"
    assert got[w + "Foo_Bar"].pid == 12 and got[w + "Old_name"].redirect == "new name" and got[w + "Old_name"].content is None and got[w + "Empty"].content is None
    from linkspark.operators.redirects import wiki_redirects

    (doc,) = corpora.wiki_articles(pages, wiki_redirects(pages)).collect()
    assert doc.text == "Foo likes Baz." and [(x.target, doc.text[x.start : x.stop]) for x in doc.links] == [(w + "Foo_Bar", "Foo"), (w + "New_name", "Baz")]


def test_warc(spark, tmp_path):
    def record(url, status, body, gap="\r\n\r\n"):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\n\r\nHTTP/1.1 {status}\r\nA: b{gap}{body}\r\n\r\n"

    parts = ["WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\nsoftware: x\r\n\r\n", record("http://a/1", "200 OK", "<p>the cat and the dog of that is in it to</p>"), record("http://a/2", "404 Not Found", "x"), record("http://a/3", "200 OK", "", gap="\r\n")]
    with gzip.open(tmp_path / "c.warc.gz", "wb") as f:
        f.write("".join(parts[:2]).encode())
    with gzip.open(tmp_path / "c.warc.gz", "ab") as f:
        f.write("".join(parts[2:]).encode())
    assert [tuple(r) for r in readers.warc_crawl(spark, str(tmp_path)).collect() if r._id == "http://a/1"] == [("http://a/1", "<p>the cat and the dog of that is in it to</p>")]
    assert "http://a/2" not in {r._id for r in readers.warc_crawl(spark, str(tmp_path), partitions=2).collect()}
    assert readers.warc_crawl(spark, str(tmp_path), "en").count() == 1 and readers.warc_crawl(spark, str(tmp_path), "de").count() == 0


def test_kb_variant(spark, tmp_path):
    (tmp_path / "kb.json").write_text('[\n{"id":"Q1","x":[1,{"y":2}]},\n{"id":"P2"}\n]\n')
    assert sorted(r[0] for r in readers.kb_dump_variant(spark, str(tmp_path / "kb.json")).select("_id").collect()) == ["P2", "Q1"]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([('a"é', 3, None, ["x"])], "_id string, n bigint, m string, l array<string>")
    line = lambda d: d.first()[0]
    assert json.loads(line(writers.json_lines(df))) == {"_id": 'a"é', "n": 3, "m": None, "l": ["x"]}
    assert line(writers.tsv_lines(df)) == 'a"é\t["x"]\tNone\t3'
    body = '{"n":3,"m":null,"l":["x"]}'
    assert line(writers.redis_lines(df, "k:")) == f'*3\r\n$3\r\nSET\r\n$7\r\nk:a\\"é\r\n${len(body)}\r\n{body}'
    assert line(writers.redis_lines(df, "", "raw", "n")).endswith("$1\r\n3")
    coded = line(writers.redis_lines(df, "", "pickle")).split("\r\n")[-1]
    assert pickle.loads(base64.b64decode(coded)) == {"n": 3, "m": None, "l": ["x"]}
    assert base64.b64decode(line(writers.redis_lines(df, "", "msgpack")).split("\r\n")[-1]) == b"\x83\xa1n\x03\xa1m\xc0\xa1l\x91\xa1x"
    assert writers.pack_message([-1, 300, 1.5, True, "é" * 20, -200, 1 << 40]).hex().startswith("97ffcd012ccb3ff8000000000000c3d928")
    writers.save_json(df, str(tmp_path / "o"))
    assert readers.json_lines(spark, str(tmp_path / "o"), "_id string, n bigint").first().n == 3


def test_cli(spark, tmp_path):
    rows = [("d1", "Ann", [("h/a", 0, 3)]), ("d2", "Ann", [("h/a", 0, 3)])]
    writers.save_json(spark.createDataFrame(rows, schemas.DOCUMENTS), str(tmp_path / "docs"))
    args = cli.parser().parse_args(["entity_counts", "--docs", str(tmp_path / "docs"), "--format", "tsv", "--option", "min_count=1"])
    assert [r[0] for r in cli.build(spark, args).collect()] == ["h/a\t2"]


def test_cli_of_several_inputs(spark, tmp_path):
    """Every builder runs from files, and one without its inputs says which it needs."""
    at = {k: str(tmp_path / k) for k in ("docs", "vocab", "idfs", "redirects", "pages", "crawl", "kb")}
    w = "en.wikipedia.org/wiki/"
    docs = [(f"d{k}", "Ann met Bob here. Then Bob left.", [(w + "Ann", 0, 3), (w + "Bob#x", 8, 11)]) for k in range(12)]
    writers.save_json(spark.createDataFrame(docs, schemas.DOCUMENTS), at["docs"])
    writers.save_json(spark.createDataFrame([(w + "Ann", 9, 0), ("Bob", 8, 1)], schemas.VOCAB), at["vocab"])
    writers.save_json(spark.createDataFrame([("Ann", 1.0), ("Bob", 0.5)], schemas.IDFS), at["idfs"])
    writers.save_json(spark.createDataFrame([(w + "Ann", w + "Anna")], schemas.REDIRECTS), at["redirects"])
    (tmp_path / "pages").write_text(XML)
    (tmp_path / "crawl").write_bytes(b"WARC/1.0\r\nWARC-Target-URI: http://a\r\n\r\nHTTP/1.1 200 OK\r\n\r\n<p>A paragraph that is long enough to stay.</p>\r\n\r\n")
    (tmp_path / "kb").write_text('[\n{"id":"Q1","labels":{"en":{"value":"one"}},"sitelinks":{"enwiki":{"title":"One"}},"claims":{"P1":[{"mainsnak":{"snaktype":"value","datatype":"string","datavalue":{"value":"v"}}}]}},\n{"id":"P1","labels":{"en":{"value":"is"}}}\n]\n')
    at["from_redirects"] = at["redirects"]
    expected = {
        "mapped_comentions": 12, "index_mentions": 24, "entity_term_weights": 2, "wiki_corpus": 4, "wiki_redirects": 1, "wiki_articles": 1, "warc_corpus": 1, "web_articles": 1, "relations": 1,
        "map_redirects": 2, "redirect_documents": 12, "entity_embeddings": 2, "entity_counts": 2, "entity_inlinks": 2, "entity_inlink_pairs": 24, "entity_vocab": 2, "entity_comentions": 12,
        "term_frequencies": 6, "term_document_frequencies": 6, "term_vocab": 0, "term_idfs": 6, "entity_mentions": 24, "entity_name_counts": 2, "name_part_counts": 2,
    }
    assert set(expected) == set(cli.MODELS)
    options = {"term_vocab": ["--option", "max_rank=none"], "entity_embeddings": ["--option", "min_entity_count=13", "--option", "min_word_count=24", "--option", "dimensions=3"]}
    for name, n in expected.items():
        model = cli.MODELS[name]
        given = [x for i in model.inputs for x in ("--input", f"{i}={at[i]}")]
        args = cli.parser().parse_args([name, *given, *options.get(name, [])])
        assert cli.build(spark, args).count() == n, name
        if set(model.inputs) - set(model.may_lack):
            with pytest.raises(SystemExit):
                cli.build(spark, cli.parser().parse_args([name]))


def test_loads(spark, tmp_path):
    v = readers.vectors(spark, [("a", [1.0, 2.0]), ("b", [0.0])])
    assert v.columns == ["_id", "embedding"] and sorted(map(tuple, v.collect())) == [("a", [1.0, 2.0]), ("b", [0.0])]
    (tmp_path / "kb.json").write_text('[\n{"id":"Q1","labels":{"en":{"value":"one"}}},\n{"no":1},\nbroken\n]\n')
    assert [(r.id, r.labels["en"].value) for r in readers.kb_dump(spark, str(tmp_path / "kb.json")).collect()] == [("Q1", "one")]


def test_shared_folder(spark, tmp_path, monkeypatch):
    """Intermediate tables lie in the cluster's folder; a cluster without one is refused; tables that are done are gone."""
    from linkspark import storage

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        storage.shared_folder(Cluster)
    Cluster.sparkContext.master = "local[4]"
    assert storage.shared_folder(Cluster) == storage.shared_folder(Cluster)
    Cluster.conf.get = staticmethod(lambda *a: "hdfs://host/shared/")
    assert storage.shared_folder(Cluster) == "hdfs://host/shared"
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    scratch = storage.Scratch(spark, "t")
    table = scratch.put(spark.range(3), "a")
    assert table.count() == 3 and list((tmp_path / "shared").glob("t-*/a-0/*.parquet"))
    scratch.drop(table)
    assert not list((tmp_path / "shared").glob("t-*/a-0"))


def test_messages_of_nested_values(spark):
    df = spark.createDataFrame([("a", {"x": 1}, ("s", [1.5]), None)], "_id string, m map<string,int>, t struct<u:string,v:array<double>>, n string")
    body = writers.redis_lines(df, "", "pickle").first()[0].split("\r\n")[-1]
    assert pickle.loads(base64.b64decode(body)) == {"m": {"x": 1}, "t": {"u": "s", "v": [1.5]}, "n": None}
    assert base64.b64decode(writers.redis_lines(df, "", "msgpack", "m").first()[0].split("\r\n")[-1]) == writers.pack_message('{"x":1}')


def test_stream(spark, tmp_path):
    rows = [("d1", "Ann", [("h/a", 0, 3)]), ("d2", "Ann", [("h/a", 0, 3)])]
    writers.save_json(spark.createDataFrame(rows, schemas.DOCUMENTS), str(tmp_path / "docs"))
    q = streaming.running_entity_counts(streaming.read_documents(spark, str(tmp_path / "docs"))).format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("counts").collect()] == [("h/a", 2)]


def _warc(kind: str, url: str, block: bytes) -> bytes:
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _answer(body: bytes, content_type: str = "text/html") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\n\r\n".encode() + body


def test_warc_framing_and_charsets(spark, tmp_path):
    """Bodies that hold marks, whole records and blank lines stay whole; bytes are decoded by the charset that is named, in the header first."""
    inner = _warc("response", "http://inner/", _answer(b"not a page of its own"))
    bodies = {
        "http://m/1": (b"WARC/1.0\r\n\r\nWARC/1.1\r\nx: y\r\n\r\n", "text/html", None),
        "http://m/2": (b"before " + inner + b" after" + inner, "text/html", None),
        "http://m/3": (b"\r\n\r\n", "text/html", None),
        "http://c/1": ("café naïve".encode("latin-1"), "text/html; charset=ISO-8859-1", "café naïve"),
        "http://c/2": ("日本語のページ".encode("shift_jis"), 'text/html; charset="Shift_JIS"', "日本語のページ"),
        "http://c/3": ('<meta charset="windows-1251">Привет'.encode("cp1251"), "text/html", '<meta charset="windows-1251">Привет'),
        "http://c/4": ("ü𝄞".encode(), "text/html; charset=no-such", "ü𝄞"),
        "http://c/5": (b"\xff\xfe", "text/html", "��"),
        "http://c/6": (b"", "text/html", ""),
        "http://c/7": ("ü".encode(), "text/html; charset=hex", "ü"),
    }
    records = [_warc("warcinfo", "http://info/", b"software: x")] + [_warc("response", u, _answer(b, t)) for u, (b, t, _) in bodies.items()] + [_warc("request", "http://r/", b"GET / HTTP/1.1\r\n\r\n")]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    expected = {u: b.decode() if t is None else t for u, (b, _, t) in bodies.items()}
    for name in ("plain.warc", "members.warc.gz"):
        got = readers.warc_crawl(spark, str(tmp_path / name)).collect()
        assert len(got) == len(expected) and {r._id: r.content for r in got} == expected, name
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # an uncompressed archive in many splits
    try:
        (tmp_path / "many.warc").write_bytes(b"".join(_warc("response", f"http://s/{k}", _answer(b"WARC/1.0 text " * (k % 9))) for k in range(200)))
        got = readers.warc_crawl(spark, str(tmp_path / "many.warc"))
        expected = sorted((f"http://s/{k}", "WARC/1.0 text " * (k % 9)) for k in range(200))
        assert sorted((r._id, r.content) for r in got.collect()) == expected
        (tmp_path / "both").mkdir()
        (tmp_path / "both" / "many.warc").write_bytes((tmp_path / "many.warc").read_bytes())
        (tmp_path / "both" / "many.warc.gz").write_bytes(gzip.compress((tmp_path / "many.warc").read_bytes()))
        assert sorted((r._id, r.content) for r in readers.warc_crawl(spark, str(tmp_path / "both")).collect()) == sorted(expected * 2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_warc_offsets(spark):
    records = [_warc("response", f"http://s/{k}", _answer(b"WARC/1.1\r\nA: b\r\n\r\n" * k)) for k in range(5)]
    data = b"".join(records)
    pieces = [(name, p) for name in "fg" for p in data.split(warc.MARK)]
    got = list(warc.frame(pieces))
    assert [data[r.offset : r.offset + r.size] for r in got] == records * 2 and [r.file for r in got] == ["f"] * 5 + ["g"] * 5
    assert got[1].field("warc-target-uri") == "http://s/1" and got[1].field("missing") is None


def test_bzip2_dumps(spark, tmp_path):
    """One dump of many bz2 streams is read by several tasks and has the rows of the plain one; so have partitioned dumps."""
    rng = random.Random(3)
    page = "<page>\n    <title>T {k}</title><ns>0</ns><id>{k}</id>\n    <revision><text xml:space=\"preserve\">{t}</text></revision>\n  </page>\n"
    pages = [page.format(k=k, t="".join(rng.choices("abcdefghijklmnopqrstuvwxyz \n", k=5000))) for k in range(800)]
    plain = "<mediawiki>\n" + "".join(pages) + "</mediawiki>\n"
    (tmp_path / "plain.xml").write_text(plain)
    cuts = [0, *sorted(rng.sample(range(1, len(plain)), 5)), len(plain)]
    (tmp_path / "streams.xml.bz2").write_bytes(b"".join(bz2.compress(plain[a:b].encode(), 1) for a, b in zip(cuts, cuts[1:], strict=False)))
    (tmp_path / "parts").mkdir()
    for k in range(4):
        (tmp_path / "parts" / f"dump{k}.bz2").write_bytes(bz2.compress(("<mediawiki>\n" + "".join(pages[200 * k : 200 * k + 200]) + "</mediawiki>\n").encode()))
    expected = sorted(map(tuple, readers.wiki_dump(spark, str(tmp_path / "plain.xml")).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        found = readers.wiki_dump(spark, str(tmp_path / "streams.xml.bz2"))
        assert sorted(map(tuple, found.collect())) == expected and len(expected) == 800
        assert found.select(F.spark_partition_id()).distinct().count() > 3
        assert sorted(map(tuple, readers.wiki_dump(spark, str(tmp_path / "parts")).collect())) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_crawl_in_a_learned_language(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 500")
    model = languages.language_model(docs)
    texts = {r.lang: r.text for r in docs.groupBy("lang").agg(F.min("text").alias("text")).collect()}
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(_warc("response", f"http://{k}/", _answer(f"<html lang=xx><p>{t}</p>".encode())) for k, t in texts.items())))
    for k in texts:
        assert [r._id for r in readers.warc_crawl(spark, str(tmp_path), language=k, model=model).collect()] == [f"http://{k}/"]


def test_stored_mentions(spark, tmp_path):
    """Models of mentions take stored ones as well as documents."""
    docs = spark.createDataFrame([(f"d{k}", "The cat Ann sat. Ann ran home.", [("en.wikipedia.org/wiki/Ann", 8, 11)]) for k in range(30)], schemas.DOCUMENTS)
    mentions, idfs, vocab = terms.entity_mentions(docs), terms.term_frequencies(docs).selectExpr("_id", "1.0D AS idf"), terms.term_frequencies(docs).selectExpr("_id", "count", "0L AS rank")
    for name, df in (("docs", docs), ("mentions", mentions), ("idfs", idfs), ("vocab", vocab)):
        writers.save_json(df, str(tmp_path / name))
    path = lambda name: f"{name}={tmp_path / name}"
    for model, more in (("entity_term_weights", ["--input", path("idfs")]), ("index_mentions", ["--input", path("vocab")]), ("entity_embeddings", [*sum((["--option", o] for o in ("min_word_count=1", "min_entity_count=1", "dimensions=4", "iterations=1", "exclude_words=true")), [])])):
        lines = []
        for source in (["--input", path("docs")], ["--input", path("mentions")]):
            lines.append(sorted(r.value for r in cli.build(spark, cli.parser().parse_args([model, *source, *more])).collect()))
        assert len(lines[0]) == len(lines[1]) > 0 and (lines[0] == lines[1] or model == "entity_embeddings")
    with pytest.raises(SystemExit):
        cli.build(spark, cli.parser().parse_args(["entity_embeddings"]))
    with pytest.raises(SystemExit):
        cli.build(spark, cli.parser().parse_args(["entity_embeddings", "--input", path("mentions"), "--option", "sentence_window=3"]))
