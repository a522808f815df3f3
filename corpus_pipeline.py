"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet into the shared folder and read back as the next one's input. All
but the last return the columns of ``documents``, whatever their names.

Each stage takes whole texts, null and empty ones included, and gives no row
for an empty table; what it does with them, with ties and with repeated rows
stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import decontaminate, ngram_join, packing, secrets, toxicity
from linkspark.llm.queries import tokenizer_file
from linkspark.llm.storage import Scratch, prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field predicts toxic go.

    Null and empty texts stay; repeated rows are judged alike; without labels of both kinds all stay.
    """
    return toxicity.drop_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the least id stays, once, whatever rows repeat it.

    Texts that are null or without words all stay, and so do rows without id.
    """
    prepare(spark)
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Null and empty texts stay; repeated rows are judged alike; without items all stay."""
    return decontaminate.decontaminate(docs, table(prepare(spark), sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated ones too; its secrets are masked, and n_chars follows the text. Null texts stay null."""
    prepare(spark)
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")) if "n_chars" in out.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens. A null text is one token; repeated rows are packed each."""
    prepare(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: No stage but the last parts of one can be put in SQL: a trained field, greedy tilings and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
