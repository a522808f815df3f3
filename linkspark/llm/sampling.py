"""Bounded training samples, and the fold that is held out from them.

A class's sample is its ids of least hash, each once. Only counts by class and
range of hashes, then the few rows below each class's cut are shuffled; the
driver gets one row a class, and the texts of the sample at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.storage import Scratch

#: Ranges of hashes for each power of two: a range adds about one part in 45 to those below it.
_STEPS = 32


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. Null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _hash(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id), 1)


def _range(doc_id: Column) -> Column:
    return F.floor(F.log2(_hash(doc_id).cast("double") + 1) * _STEPS).cast("int")


def sample_ids(labels: DataFrame, label: str, per_class: int, eligible: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, label): of each label value the ``per_class`` training ids of least hash, each once; stored.

    labels: doc_id and the label, ids repeated or not. eligible: doc_id of the rows that may be
    taken, all if it is None. most: bounds the sample of all classes together, but for one id of
    each class. Null ids, null labels and the held-out fold are left out; every class is learned.
    """
    spark = labels.sparkSession
    scratch = Scratch(spark, "sample")
    own = labels.select("doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    ranges = scratch.put(own.groupBy(label, _range(F.col("doc_id")).alias("range")).agg(F.count(F.lit(1)).alias("n")), "ranges")
    classes = ranges.select(label).distinct().count()
    if most is not None and classes:
        per_class = max(1, min(per_class, most // classes))
    upto = ranges.withColumn("upto", F.sum("n").over(Window.partitionBy(label).orderBy("range")))
    wanted = 1.1 * per_class
    while True:
        enough = F.min(F.when(F.col("upto") >= wanted, F.col("range")))
        cuts = scratch.put(upto.groupBy(label).agg(F.coalesce(enough, F.max("range")).alias("cut"), (F.coalesce(enough, F.max("range")) == F.max("range")).alias("whole")), "cuts")
        near = own.join(cuts, label).where(_range(F.col("doc_id")) <= F.col("cut")).select(label, "doc_id").distinct()
        if eligible is not None:
            farthest = cuts.agg(F.max("cut")).first()[0]
            near = near.join(eligible.select("doc_id").where(_range(F.col("doc_id")) <= F.lit(farthest)).distinct(), "doc_id", "left_semi")
        place = F.row_number().over(Window.partitionBy(label).orderBy(_hash(F.col("doc_id")), "doc_id"))
        found = scratch.put(near.withColumn("place", place).where(F.col("place") <= per_class).select("doc_id", label), "found")
        counts = found.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        short = cuts.join(counts, label, "left").where(~F.col("whole") & (F.coalesce("n", F.lit(0)) < per_class)).limit(1).count()
        if not short:
            scratch.drop(ranges, cuts)
            return found
        wanted *= 8  # repeated or ineligible ids took the places
        scratch.drop(cuts, found)


def training_texts(docs: DataFrame, ids: DataFrame, label: str) -> list[tuple[str, object]]:
    """(text, label) of the sampled documents, in a fixed order; of several texts of an id and label the least.

    docs: doc_id, text, and the label if it is the documents' own. ``ids`` is a sample: its bound is that of
    the broadcast, without which all texts would be shuffled, and of what comes to the driver.
    """
    keys = ["doc_id", label] if label in docs.columns else ["doc_id"]
    rows = docs.select(*keys, "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), keys).groupBy("doc_id", label).agg(F.min("text").alias("text"))
    return [(r[2], r[1]) for r in sorted(rows.select("doc_id", label, "text").collect(), key=lambda r: (r[0], r[1]))]
