"""Every operator and every pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and odd column names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from linkspark.llm import decontaminate, langid, ngram_join, packing, quality, sampling, secrets, sharding, token_binary, toxicity, url_filter
from linkspark.llm.queries import tokenizer_file
from linkspark.llm.storage import quoted

from .conftest import prose

SF = "/root/testdata/sf0.001"
ODD = ["a.b", "my col", "my-col", "tick`s", "kept", "n_words", "score", "predicted", "lang_pred", "spans", "shard", "sequence_id", "__n", "Text_Crc32", "host"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with columns of odd and clashing names; each holds its own name and the row's number."""
    import random

    rng = random.Random(1)
    body = prose(rng, 80)
    texts = [None, "", " \n\t ", "one two", body, body, body + " more", "password = 'zX81kkQ02p9'\n" + prose(rng, 30), prose(rng, 30_000), "x" * 300_000, "no " * 3000, "é𝄞 " * 50, None, body]
    rows = [(None if k in (5, 12) else 7 if k in (6, 13) else k, t, [None, "en"][k % 2], "s", *(f"{c} {k}" for c in ODD)) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in ODD)
    return spark.createDataFrame(rows, schema).repartition(3)


def intact(df, odd, replaced=()):
    """Columns as they came, apart from replaced ones, and each row's values together."""
    gone = {c.lower() for c in replaced}
    left = [c for c in odd.columns if c.lower() not in gone]
    assert [c for c in df.columns if c in left] == left
    kept = [c for c in ODD if c in left]
    for r in df.select(*(F.col(quoted(c)) for c in kept)).collect():
        assert len({v.removeprefix(c) for c, v in zip(kept, r, strict=True)}) == 1
    return df.count()


def test_row_operators(odd):
    n = odd.count()
    labels = odd.sparkSession.createDataFrame([(k, k % 2) for k in range(14)], "doc_id long, toxic int")
    model = langid.train_model(odd)
    assert intact(quality.line_quality(odd), odd, ["n_words", "kept"]) == n
    assert quality.clean_documents(odd).columns == odd.columns and intact(quality.clean_documents(odd), odd) <= n
    assert intact(toxicity.score_documents(odd, toxicity.train_model(odd, labels)), odd, ["score", "predicted"]) == n
    assert intact(langid.identify(odd, model), odd, ["lang_pred", "score"]) == n
    assert intact(secrets.find_secrets(odd), odd, ["spans"]) == n
    assert secrets.redact_secrets(odd).columns == odd.columns and intact(secrets.redact_secrets(odd), odd) == n
    urls = odd.withColumn("url", F.concat(F.lit("http://h.org/"), "my col"))
    none = url_filter.train(urls.select("url", F.lit(0).alias("label")))
    assert intact(url_filter.judge(urls, none, ()), odd, ["host"]) == n


def test_shuffled_operators(odd, tmp_path):
    n = odd.count()
    assert ngram_join.join_components(odd).count() == n and sharding.shard(odd, 5).count() == n
    sharding.write_shards(odd, str(tmp_path / "shards"), 5)
    assert intact(odd.sparkSession.read.parquet(str(tmp_path / "shards")), odd, ["shard"]) == n
    token_binary.write_tokens(odd, tokenizer_file("byte_bpe_50k.json"), str(tmp_path / "tokens"))
    assert token_binary.read_tokens(odd.sparkSession, str(tmp_path / "tokens")).count() == n
    tokens = packing.pack(odd, tokenizer_file("word_bpe_49k.json")).agg(F.sum("length")).first()[0]
    assert tokens == packing.pack(odd.repartition(7), tokenizer_file("word_bpe_49k.json")).agg(F.sum("length")).first()[0]
    bench = odd.sparkSession.createDataFrame([(1, "no no no no no no"), (2, None)], "item_id int, text string")
    assert decontaminate.contamination(odd, bench).count() == 1 == n - intact(decontaminate.decontaminate(odd, bench), odd)


@pytest.mark.parametrize("number", range(4))
def test_stages(odd, number):
    spark, (name, stage) = odd.sparkSession, corpus_pipeline.STAGES[number]
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns and 0 < intact(out, odd) <= odd.count()
    empty = odd.where("doc_id < -1")
    assert stage(spark, empty, SF).count() == 0 and stage(spark, empty, SF).schema.names == odd.columns
    nulls = odd.where("text IS NULL")
    assert stage(spark, nulls, SF).count() == 2
    if name == "ngram_jaccard_join":  # of equal and near texts the least id stays; rows without id or words all do
        ids = [r.doc_id for r in out.where("text LIKE '%ne two' OR length(trim(text)) > 100").collect()]
        assert ids.count(4) == 1 and ids.count(None) == 1


def test_last_stage(odd):
    stage = corpus_pipeline.STAGES[-1][1]
    assert stage(odd.sparkSession, odd, SF).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert stage(odd.sparkSession, odd.where("doc_id < -1"), SF).count() == 0


def test_pipeline_like_plain_stages(spark, tmp_path):
    """run() gives what the operators give when called one after the other on whole tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    scored = toxicity.score_documents(docs, toxicity.train_model(docs, labels))
    docs = scored.where("score < 0.5").select(*docs.columns)
    first = ngram_join.join_components(docs).groupBy("component_id").agg(F.min("doc_id").alias("doc_id"))
    docs = docs.join(first.select("doc_id"), "doc_id", "left_semi")
    docs = docs.join(decontaminate.contamination(docs, bench).select("doc_id"), "doc_id", "left_anti")
    texts = {r.doc_id: secrets.redact(r.text, secrets.spans(r.text)) for r in docs.collect()}
    from linkspark.llm import tokens

    work = tokens.SegmentEncoder(tokenizer_file("word_bpe_49k.json"), False)
    expected = {i: len(ids) + 1 for i, ids in zip(texts, work.whole(list(texts.values())), strict=True)}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == expected
    assert got.select("sequence_id").distinct().count() == -(-sum(expected.values()) // 4096)


def test_samples_are_bounded(spark):
    """Whatever their number, no more rows than asked for come out; repeated ids count once, and ineligible ones take no place."""
    labels = spark.range(1_000_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("toxic"))
    ids = sampling.sample_ids(labels, "toxic", 100)
    assert [r["count"] for r in ids.groupBy("toxic").count().collect()] == [100] * 3
    again = sampling.sample_ids(labels.repartition(7), "toxic", 100)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ids.collect()))
    plain = labels.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).where((sampling.fold(F.col("doc_id")) != 0) & (F.col("toxic") == 1)).orderBy("h").limit(100)
    assert {r.doc_id for r in plain.collect()} == {r.doc_id for r in ids.where("toxic = 1").collect()}
    same = labels.where("doc_id < 1000").unionAll(spark.range(20_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit(1).alias("toxic")))
    got = sampling.sample_ids(same, "toxic", 50)
    assert got.count() == got.distinct().count() and {r["count"] for r in got.groupBy("toxic").count().collect()} == {50}
    few = sampling.sample_ids(labels, "toxic", 50, eligible=labels.where("doc_id % 1000 = 1"))
    assert {r["count"] for r in few.groupBy("toxic").count().collect()} == {50} and few.where("doc_id % 1000 <> 1").count() == 0
    assert sampling.sample_ids(labels, "toxic", 100, most=6).count() == 6
    docs = same.select("doc_id", F.lit("a text").alias("text"))
    assert len(sampling.training_texts(docs, got, "toxic")) == 150
    assert sampling.sample_ids(labels.where("doc_id < 0"), "toxic", 5).count() == 0


def test_long_texts_take_no_places(spark):
    """A label most of whose documents are too long to learn from is learned from the others."""
    import random

    rng = random.Random(2)
    rows = [(k, ("vilexa " if k % 2 else "") + prose(rng, 40) + (" filler words" * 1000 if k % 10 > 1 else "")) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(2000)], "doc_id long, toxic int")
    model = toxicity.train_model(docs, labels, toxicity.ToxicityRules(per_class=30))
    assert model is not None


def test_session_settings_stay(spark):
    """Operators change no setting of the session."""
    conf = dict(spark.sparkContext.getConf().getAll()) | {r.key: r.value for r in spark.sql("SET").collect()}
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    quality.line_quality(docs).count(), ngram_join.join_components(docs).count(), secrets.find_secrets(docs).count(), sharding.shard(docs).count()
    after = dict(spark.sparkContext.getConf().getAll()) | {r.key: r.value for r in spark.sql("SET").collect()}
    assert {k for k in after if after[k] != conf.get(k)} <= {"spark.checkpoint.dir"}
