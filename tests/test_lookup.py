"""Looking up many strings at once, and what does so without a shuffle, against the joins."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkspark import schemas
from linkspark.operators import lookup, redirects, terms
from linkspark.operators.lookup import Lookup


def test_find(monkeypatch):
    rng = random.Random(3)
    keys = list({"".join(rng.choices("abcé𝄞", k=rng.randint(0, 4))) for _ in range(300)})
    asked = [rng.choice([*keys, "zz", "q", None]) for _ in range(2000)]
    place = {k: i for i, k in enumerate(keys)}
    expected = [place.get(a, -1) for a in asked]
    assert Lookup(pa.array(keys)).find(pa.array(asked)).tolist() == expected
    assert Lookup(pa.chunked_array([keys[:7], keys[7:]])).find(pa.array(asked).slice(5, 90)).tolist() == expected[5:95]
    for few in (1, 3):  # hashes that collide
        monkeypatch.setattr(lookup, "_hashes", lambda a, few=few: np.array([len(x or "") % few for x in a.to_pylist()], np.uint64))
        assert Lookup(pa.array(keys)).find(pa.array(asked)).tolist() == expected
    assert Lookup(pa.array([], pa.string())).find(pa.array(["a", None])).tolist() == [-1, -1] and Lookup(pa.array(["a"])).find(pa.array([], pa.string())).tolist() == []


def test_large_dictionaries_are_flat():
    keys = pa.array([f"term number {k}" for k in range(300_000)])
    own = Lookup(keys)
    assert own.hashes.nbytes + own.order.nbytes + own.keys.nbytes < 300_000 * 50
    assert own.find(pa.array(["term number 299999", "term number 300000"])).tolist() == [299_999, -1]


def test_relink_like_the_join(spark):
    rng = random.Random(4)
    target = lambda: rng.choice(["a", "b", "c", "d", "é", "", None])
    docs = spark.createDataFrame([(f"d{k}", f"text {k}", None if k % 9 == 0 else [(target(), j, j + 1) for j in range(rng.randint(0, 4))]) for k in range(60)], schemas.DOCUMENTS).repartition(3)
    found = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "c"), ("c", None), ("", "e"), (None, "n"), ("é", "é2")], schemas.REDIRECTS)
    for keep in (False, True):
        sent, joined = (redirects.relink(docs, found, keep, n) for n in (100, 1))
        assert sent.columns == joined.columns and sorted(map(repr, sent.collect())) == sorted(map(repr, joined.collect()))
    assert "Exchange" not in redirects.relink(spark.range(5).select(F.col("id").cast("string").alias("_id"), F.lit("t").alias("text"), F.array(F.struct(F.lit("a").alias("target"), F.lit(0).alias("start"), F.lit(1).alias("stop"))).alias("links")), found)._jdf.queryExecution().executedPlan().toString()
    none = redirects.relink(docs, found.where("_id = 'none'"))
    assert none.count() == docs.where("size(links) > 0").count()


def test_repeated_vocabulary_terms(spark):
    """The least rank of a repeated term counts, whether the vocabulary is sent or joined."""
    vocab = spark.createDataFrame([("a", 1, 7), ("a", 1, 3), ("b", 1, 4)], schemas.VOCAB)
    mentions = spark.createDataFrame([("e", "s", "a b zz a", (2, 3))], schemas.MENTIONS)
    sent, joined = (terms.index_mentions(mentions, vocab, most_broadcast=n).collect() for n in (10, 1))
    assert sent == joined and sent[0].sequence == [3, 4, 1, 3]
