import math
import random
import time

import pytest
from pyspark.sql import functions as F

from linkspark import schemas
from linkspark.functions import text as X
from linkspark.operators import embeddings, entities, languages, redirects, relations, terms
from linkspark.operators.ranking import ranked


@pytest.fixture(scope="module")
def docs(spark):
    text = "Ann Lee met Bob. Then Ann left."
    rows = [
        ("d1", text, [("http://h/a#x", 0, 7), ("h/b", 12, 15), ("h/a#y", 22, 25)]),
        ("d2", "Ann Lee", [("h/a", 0, 7), ("#x", 4, 4)]),
        ("d3", "* item about Ann", [("h/a", 13, 16)]),
        ("d4", "nothing here.", []),
    ]
    return spark.createDataFrame(rows, schemas.DOCUMENTS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts(docs):
    assert rows(entities.entity_counts(docs)) == [("h/a", 4)]
    assert rows(entities.entity_counts(docs, 0, "h/b")) == [("h/b", 1)]
    names = {r[0]: (r[1], r[2]) for r in entities.entity_name_counts(docs).collect()}
    assert names == {"Ann Lee": ({"h/a": 2}, 2), "Bob": ({"h/b": 1}, 1), "Ann": ({"h/a": 2}, 2)}


def test_parts(docs):
    parts = {r[0]: r[1] for r in entities.name_part_counts(docs).collect()}
    assert parts == {r[0]: r[1] for r in entities.name_part_counts(docs, most_names=1).collect()}
    assert parts == {"Ann": {"B": 4, "E": 2, "O": 4}, "Lee": {"E": 2, "O": 2}, "Ann Lee": {"B": 2, "E": 2, "O": 2}}


def test_inlinks_and_comentions(docs):
    inlinks = {r[0]: r[1] for r in entities.entity_inlinks(docs).collect()}
    assert inlinks["h/a"] == ["d1", "d1", "d2", "d3"] and inlinks["h/b"] == ["d1"]
    assert rows(entities.entity_inlink_pairs(docs)) == sorted((t, s) for t, found in inlinks.items() for s in found)
    assert rows(entities.entity_comentions(docs)) == [("d1", ["h/a", "h/b"]), ("d2", ["h/a", ""]), ("d3", ["h/a"])]
    vocab = entities.entity_vocab(docs, min_count=0)
    assert rows(vocab) == [("", 1, 1), ("h/a", 4, 0), ("h/b", 1, 2)]
    assert rows(entities.mapped_comentions(docs, vocab.where("_id <> ''"))) == [("d1", [0, 2]), ("d2", [0]), ("d3", [0])]


def test_inlinks_of_repeated_documents(spark):
    """Rows of one _id are one document: it counts once for each raw target."""
    rows_ = [("d", "ab", [("h/a#x", 0, 1), ("h/b", 1, 2)]), ("d", "ab", [("h/a#x", 0, 1), ("h/a", 1, 2)]), ("e", "a", [("h/a", 0, 1)])]
    docs = spark.createDataFrame(rows_, schemas.DOCUMENTS)
    assert rows(entities.entity_inlinks(docs)) == [("h/a", ["d", "d", "e"]), ("h/b", ["d"])]
    assert rows(entities.entity_inlink_pairs(docs)) == [("h/a", "d"), ("h/a", "d"), ("h/a", "e"), ("h/b", "d")]


def test_comentions_of_repeated_documents(spark):
    """Rows of one _id are one document: each target once, at its least place, then by name."""
    rows_ = [("d", "abc", [("h/z", 0, 1), ("h/a", 1, 2), ("h/z", 2, 3)]), ("d", "abc", [("h/m", 0, 1), ("h/b", 1, 2), ("h/a", 2, 3)]), ("e", "a", [("h/b", 0, 1)]), ("f", "a", [])]
    docs = spark.createDataFrame(rows_, schemas.DOCUMENTS)
    assert rows(entities.entity_comentions(docs)) == [("d", ["h/m", "h/z", "h/a", "h/b"]), ("e", ["h/b"])]
    vocab = spark.createDataFrame([("h/a", 9, 0), ("h/b", 8, 1), ("h/z", 7, 2)], "_id string, count bigint, rank bigint")
    assert rows(entities.mapped_comentions(docs, vocab)) == [("d", [2, 0, 1]), ("e", [1])]


def test_comentions_of_repeated_documents_in_order_of_rows(spark):
    links = [(2, "d", ["h/a", "h/c"]), (1, "d", ["h/z", "h/d"]), (3, "d", ["h/b", "h/b", "h/d"])]
    rows_of = [(n, i, [(t, 0, 0) for t in targets]) for n, i, targets in links]
    docs = spark.createDataFrame(rows_of, "page long, _id string, links array<struct<target:string,start:int,stop:int>>")
    assert rows(entities.entity_comentions(docs, "page")) == [("d", ["h/z", "h/a", "h/b", "h/d", "h/c"])]
    vocab = spark.createDataFrame([("h/a", 5), ("h/z", 7), ("h/b", 6), ("h/c", 1)], "_id string, rank long")
    assert rows(entities.mapped_comentions(docs, vocab, "page")) == [("d", [7, 5, 6, 1])]


def test_mentions_find_links_once(docs):
    """No filter stands before the pass, as Spark would compute the links for it and then again."""
    plan = terms.entity_mentions(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan


def test_trigrams_in_pieces():
    """Memory is that of a piece, and texts longer than it lose no trigram where they are cut."""
    import pyarrow as pa

    most, languages.MOST_SIGNS = languages.MOST_SIGNS, 10
    try:
        texts = [" abcdefghijklmnopqrstuvwxyz ", None, " ab ", "", " the end of it all "]
        found = sorted((int(r), int(c)) for codes, row in languages._pieces(pa.array(texts)) for c, r in zip(codes, row, strict=True))
    finally:
        languages.MOST_SIGNS = most
    code = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    assert found == sorted((k, code(t[i : i + 3])) for k, t in enumerate(texts) if t for i in range(len(t) - 2))


def test_ranks(spark):
    counts = spark.createDataFrame([(f"t{k:03}", k % 7) for k in range(100)], schemas.COUNTS)
    expected = [(t, c, k) for k, (c, t) in enumerate(sorted(((k % 7, f"t{k:03}") for k in range(100)), key=lambda x: (-x[0], x[1])))]
    assert rows(ranked(counts)) == sorted(expected)
    assert rows(ranked(counts, 5, 20)) == sorted(x for x in expected if 5 <= x[2] < 20)
    assert rows(ranked(counts, 5, 20, top_limit=3)) == sorted(x for x in expected if 5 <= x[2] < 20)


def test_terms(spark):
    d = spark.createDataFrame([("1", "a b a"), ("2", "a c"), ("3", "A a")], "_id string, text string")
    assert rows(terms.term_frequencies(d)) == [("a", 4)]
    assert rows(terms.term_document_frequencies(d)) == [("a", 3)]
    idf = rows(terms.term_idfs(d, min_df=0))
    assert idf[0] == ("A", pytest.approx(math.log(3))) and idf[1] == ("a", 0.0)


def test_mentions(docs):
    found = rows(terms.entity_mentions(docs).select("_id", "source", "text", "span.start", "span.stop"))
    assert found == [("h/a", "d1", "Ann Lee met Bob.", 0, 7), ("h/a", "d1", "Then Ann left.", 5, 8), ("h/b", "d1", "Ann Lee met Bob.", 12, 15)]
    wide = terms.entity_mentions(docs, sentence_window=3, strict_sentences=False, lowercase=True)
    assert ("h/a", "d1", "ann lee met bob. then ann left.") in rows(wide.select("_id", "source", "text"))


def test_index_mentions(spark, docs):
    vocab = spark.createDataFrame([("Ann", 3, 0), ("met", 2, 1), ("left", 2, 2)], schemas.VOCAB)
    out = rows(terms.index_mentions(terms.entity_mentions(docs), vocab).select("_id", "sequence", "span.start", "span.stop"))
    assert out == [("h/a", [0, 2, 1, 2], 0, 2), ("h/a", [2, 0, 2], 1, 2), ("h/b", [0, 2, 1, 2], 3, 4)]
    for oov in ("last", 9):
        few, many = (rows(terms.index_mentions(terms.entity_mentions(docs), vocab, oov, most_broadcast=n).select("_id", "source", "sequence", "span.start", "span.stop")) for n in (100, 1))
        assert few == many


def plain_mentions(d, window, strict):
    """Sentences around a link, looked for one by one."""
    left = window // 2
    right = window - left - 1
    spans = X.spans_of(d["text"])
    for target, start, stop in d["links"]:
        own = [k for k, s in enumerate(spans) if s["start"] < stop and (s["start"] >= start or k + 1 == len(spans) or spans[k + 1]["start"] > start)]
        if not own:
            continue
        begin, end = spans[max(own[0] - left, 0)]["start"], spans[min(own[-1] + right, len(spans) - 1)]["stop"]
        text = d["text"][begin:end]
        if (start - begin, stop - begin) == (0, len(text)):
            continue
        bare = text.strip()
        if not strict or bare and bare[0] != "*" and bare[-1] in ".!?\"'":
            yield target, d["_id"], text, start - begin, stop - begin


def test_mentions_like_plain_python(spark):
    rng = random.Random(4)
    given = []
    for k in range(60):
        text = "".join(rng.choice(["Ab", "cd", "e", " ", ". ", "! ", "\n", "* ", "é𝄞", "Inc. ", "?\" "]) for _ in range(rng.randint(0, 50)))
        at = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 4))))
        given.append((f"d{k}", text, [(f"t{a}", a, b) for a, b in zip(at[::2], at[1::2])]))
    given.append(("none", None, [("t", 0, 1)]))
    docs = spark.createDataFrame(given, schemas.DOCUMENTS).repartition(3)
    for window in (1, 2, 3, 5):
        for strict in (True, False):
            got = rows(terms.entity_mentions(docs, sentence_window=window, strict_sentences=strict).select("_id", "source", "text", "span.start", "span.stop"))
            assert got == sorted(m for i, t, ln in given if t is not None for m in plain_mentions({"_id": i, "text": t, "links": ln}, window, strict))


def test_weights(spark, docs):
    m = terms.entity_mentions(docs)
    idfs = spark.createDataFrame([("Ann", 1.0), ("met", 2.0), ("Then", 0.0)], schemas.IDFS)
    out = {r[0]: r[1] for r in terms.entity_term_weights(m, idfs).collect()}
    norm = math.sqrt(2 + 4)
    assert out["h/a"] == pytest.approx({"Ann": math.sqrt(2) / norm, "met": 2 / norm, "Then": 0.0})


def test_redirects(spark, docs):
    pages = spark.createDataFrame([("en.wikipedia.org/wiki/A", "b c"), ("en.wikipedia.org/wiki/B_c", "D"), ("en.wikipedia.org/wiki/D", None)], "_id string, redirect string")
    w = "en.wikipedia.org/wiki/"
    assert rows(redirects.wiki_redirects(pages)) == [(w + "A", w + "B_c"), (w + "B_c", w + "D")]
    assert rows(redirects.wiki_redirects(pages, True)) == [(w + "A", w + "D"), (w + "B_c", w + "D")]
    r = spark.createDataFrame([("h/b", "h/z"), ("h/b", "h/y")], schemas.REDIRECTS)
    out = {x[0]: [(link.target, link.start) for link in x[2]] for x in redirects.relink(docs, r).collect()}
    assert out["d1"] == [("http://h/a#x", 0), ("h/y", 12), ("h/a#y", 22)] and "d4" not in out
    assert redirects.relink(docs, r, keep_unlinked=True).count() == 4
    f = spark.createDataFrame([("s", "t"), ("q", "s")], schemas.REDIRECTS)
    t = spark.createDataFrame([("s", "u")], schemas.REDIRECTS)
    assert rows(redirects.map_redirects(f, t)) == [("s", "u"), ("t", "u")]


def plain_chains(pairs):
    step = {}
    for a, b in pairs:
        if a is not None and b is not None:
            step[a] = min(b, step.get(a, b))
    out = {}
    for a in step:
        seen, here = [], a
        while here in step and here not in seen:
            seen.append(here)
            here = step[here]
        end = min(seen[seen.index(here) :]) if here in step else here
        if end != a:
            out[a] = end
    return out


def test_chains(spark):
    """Ends of chains, branches and cycles of any length, against walking each way."""
    rng = random.Random(12)
    long = [(f"n{k}", f"n{k + 1}") for k in range(1000)] + [(f"side{k}", f"n{k * 7}") for k in range(50)]
    rings = [(f"r{n}_{k}", f"r{n}_{(k + 1) % n}") for n in (1, 2, 3, 7, 40) for k in range(n)] + [(f"tail{k}", f"tail{k + 1}" if k % 9 else "r7_3") for k in range(1, 40)]
    wild = [(f"w{rng.randrange(60)}", f"w{rng.randrange(60)}") for _ in range(70)] + [(None, "x"), ("y", None), ("w1", "w1")]
    for pairs in (long, rings, wild, long + rings + wild, []):
        df = spark.createDataFrame(pairs, schemas.REDIRECTS)
        got = rows(redirects.resolve_chains(df))
        assert got == sorted(plain_chains(pairs).items())


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = languages.language_model(docs.where("doc_id % 5 <> 0"))
    held = docs.where("doc_id % 5 = 0 AND lang IS NOT NULL")
    out = languages.with_language(held, model)
    assert out.columns == ["doc_id", "text", "lang", "language", "language_margin"]
    right = out.where("lang = language").count()
    assert right > 0.99 * held.count() and model.groupBy("lang").count().where("count > 5000").count() == 0
    text = {r.lang: r.text for r in held.groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = "".join(a + b for a, b in zip(text["en"][:1500].split(" "), text["de"][:1500].split(" "), strict=False))
    odd = [(1, None, "x"), (2, "", "x"), (3, "12 345 !?", "x"), (4, " ".join(w for pair in zip(text["en"].split(), text["fr"].split(), strict=False) for w in pair), "x"), (5, text["es"][:300], "x"), (6, "日本語", "x"), (7, "a", "x")]
    got = {r.doc_id: r.language for r in languages.with_language(spark.createDataFrame(odd, "doc_id long, text string, language string"), model, margin=0.5).collect()}
    assert got[5] == "es" and [got[k] for k in (1, 2, 3, 4, 6)] == [None] * 5 and mixed
    counts = languages.language_model(spark.createDataFrame([("ab ab", "x"), ("Ab-1b", "x"), (None, "x"), ("q", None)], "text string, lang string"))
    code = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    assert {(r.trigram, r["count"], r.total) for r in counts.collect()} == {(code(" ab"), 3, 9), (code("ab "), 3, 9), (code("b a"), 1, 9), (code("b b"), 1, 9), (code(" b "), 1, 9)}
    none = languages.language_model(docs.where("doc_id < 0"))
    assert {r.language for r in languages.with_language(spark.createDataFrame(odd[:3], "doc_id long, text string, x string"), none).collect()} == {None}


def test_relations(spark):
    import json

    def item(id, label=None, title=None, claims=None):
        return (json.dumps({"id": id, "labels": {"en": {"value": label}} if label else {}, "sitelinks": {"enwiki": {"title": title}} if title else {}, "claims": claims or {}}) + ",",)

    def snak(kind, value, type="value"):
        return {"mainsnak": {"snaktype": type, "datatype": kind, "datavalue": {"value": value}}}

    from linkspark.sources.readers import kb_lines

    own = {"P1": [snak("string", "42"), snak("quantity", {"amount": "1"})], "P2": [snak("wikibase-item", {"numeric-id": 42}), snak("wikibase-item", {"numeric-id": 7})], "P3": [snak("time", {"time": "+1950-00-00"}, "somevalue")], "P9": [snak("string", "x")]}
    lines = spark.createDataFrame([("[",), item("Q1", "one", "One", own), item("Q42", "answer"), item("P1", "text"), item("P2", "item"), item("P3", "when"), ("]",)], "value string")
    items = kb_lines(lines).select(F.from_json("value", schemas.KB_ITEM).alias("i")).select("i.*")
    assert rows(relations.relations(items)) == [("One", {"text": "42", "item": "answer"})]


def test_embeddings(spark):
    w = "en.wikipedia.org/wiki/"
    m = spark.createDataFrame([(w + "A", "d", "a b c", (2, 3))] * 12 + [("x", "d", "a b", (0, 1))], schemas.MENTIONS)
    out = embeddings.entity_embeddings(m, dimensions=4, min_word_count=12, min_entity_count=5, partitions=1)
    got = {r[0]: r[1] for r in out.collect()}
    assert set(got) == {w + "A", "a", "c"} and all(abs(math.fsum(x * x for x in v) - 1) < 1e-6 for v in got.values())
    assert {r[0] for r in embeddings.entity_embeddings(m, dimensions=4, min_word_count=12, min_entity_count=5, exclude_words=True, partitions=1).collect()} == {w + "A"}


def test_embeddings_query_has_production_dimensions(spark):
    from linkspark.plans import queries

    docs = spark.createDataFrame([(k, "some words, erst and more words, thion here.") for k in range(60)], "doc_id long, text string")
    out = queries.entity_embeddings(_Tables(spark, docs), "any").collect()
    assert out and {r.dimensions for r in out} == {100}


class _Tables:
    """A session whose tables are all one."""

    def __init__(self, spark, df):
        self.spark, self.df, self.read = spark, df, self

    def parquet(self, *_):
        return self.df

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_weights_of_large_entities(spark):
    """One entity of 100,000 terms, in time that grows with the terms and not with their square; both forms agree."""
    mentions = spark.range(100_000).select(F.lit("e").alias("_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([("f", "w1 w1 w2"), ("g", "w3")], "_id string, text string"))
    idfs = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("_id"), F.when(F.col("id") == 3, 0.0).otherwise(1.0).alias("idf"))
    start = time.time()
    (e,) = terms.entity_term_weights(mentions, idfs).where("_id = 'e'").collect()
    assert len(e.counts) == 100_000 and math.isclose(e.counts["w5"], 1 / math.sqrt(99_999), rel_tol=1e-9) and time.time() - start < 60
    few = {(r._id, r.term): r.weight for r in terms.entity_term_weight_rows(mentions, idfs).where("_id <> 'e'").collect()}
    assert few["g", "w3"] is None and math.isclose(few["f", "w1"], math.sqrt(2 / 3)) and math.isclose(few["f", "w2"], math.sqrt(1 / 3))
    raw = {(r._id, r.term): r.weight for r in terms.entity_term_weight_rows(mentions, idfs, normalize=False).where("_id <> 'e'").collect()}
    assert raw == {("g", "w3"): 0.0, ("f", "w1"): math.sqrt(2), ("f", "w2"): 1.0}


def test_unit_of_long_vectors(spark):
    long = spark.range(200).select(F.array_repeat(F.lit(2.0), 20_000).alias("v"))
    start = time.time()
    out = long.select(F.round(F.get(embeddings.unit(F.col("v")), F.lit(7)), 12).alias("x")).distinct().collect()
    assert [r.x for r in out] == [round(1 / math.sqrt(20_000), 12)] and time.time() - start < 30
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), (None,)], "v array<double>").select(embeddings.unit(F.col("v")).alias("u"))
    assert [r.u for r in zero.collect()] == [None, [0.6, 0.8], None]


def test_queries_bound_arrow_batches(spark, tmp_path):
    """Tasks of wiki_articles hold small batches of texts, whatever the number of rows."""
    from linkspark.plans import queries

    spark.createDataFrame([(1, "a, word here.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    queries.QUERIES["wiki_articles"](spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_wiki_files_of_null_texts_and_carriage_returns(spark, tmp_path):
    from linkspark.plans import queries

    docs = spark.createDataFrame([(1, None), (2, "a\r\nb\rc & <d>"), (3, " e\n")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.pid: r.content for r in queries.wiki_files(spark, str(tmp_path)).collect()}
    assert found == {1: None, 2: "a\r\nb\rc & <d>", 3: " e\n"}
