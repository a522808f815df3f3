"""Fill-in-the-middle against plain Python: unit grammars as patterns, the split, and the way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from linkspark.llm import fill_middle as M

WORDS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PLAIN = {"words": WORDS, "lines": re.compile(r"[^\n]*\n|[^\n]+"), "code": re.compile(r"[\x20\x09-\x0D]+|\w+|[\s\S]"), "chars": re.compile(r"[\s\S]")}


def plain_output(doc_id, text):
    text = text or ""
    units = WORDS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", list(PLAIN))
def test_units(spark, unit):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\tab_1é𝄞.\x0b\xa0ß") for _ in range(rng.randint(0, 14))) for _ in range(2000)] + ["", "\n\n", "a" * 50_000 + "\n", " x" * 30_000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", M.pieces(F.col("text"), unit).alias("u")).collect()
    assert all(r.u == PLAIN[unit].findall(r.text) for r in got) and len(got) == len(texts)


def test_grammars_hold_every_character_once():
    for classes, _ in M.GRAMMARS.values():
        for c in ("a", "é", "_", "1", " ", "\t", "\n", "\x0b", "\xa0", "𝄞", "."):
            own = [re.search(p.replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{L}\p{N}", r"\w"), c) for p in classes.values()]
            assert sum(m is not None for m in own) == 1
    assert M.boundary({"A": "a", "B": "b"}, "A*B") == "(?<=b)(?=a)|(?<=b)(?=b)"


def test_fill_in_middle(spark, docs, no_docs, texts):
    odd = [(k, t) for k, t in enumerate(["a <P> b", "x<S>", "<M>", "<P", "<", "P><S", "a <P", " ", "\n \n", "<<P <S M>"] * 30)]
    for df, rows in ((docs, texts), (spark.createDataFrame(odd, "doc_id long, text string"), odd)):
        out = M.fill_in_middle(df).withColumn("back", M.restored(F.col("output"), F.col("form")))
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=repr)
        assert got == sorted(((i, *plain_output(i, t)) for i, t in rows), key=repr)
        assert out.where("back IS NULL OR back <> coalesce(text, '')").count() == 0
        assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(no_docs).count() == 0
    named = M.fill_in_middle(docs.withColumn("Form", F.lit("x")).withColumn("a.b", F.lit("y")).withColumn("__n", F.lit("z")))
    assert named.columns == [*docs.columns, "a.b", "__n", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {(r["a.b"], r["__n"]) for r in named.collect()} == {("y", "z")}


def test_other_rates_and_units(docs):
    assert {r.form for r in M.fill_in_middle(docs, rate=100, spm_rate=0).where("text <> ''").collect()} == {"psm"}
    assert {r.form for r in M.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    for unit in PLAIN:
        out = M.fill_in_middle(docs, unit, rate=100)
        assert out.where(M.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0


def test_native(spark):
    plan = M.fill_in_middle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
