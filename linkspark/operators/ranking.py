"""Ranks by descending count without a single-partition sort of everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.storage import Scratch


def ranked(counts: DataFrame, min_rank: int | None = 0, max_rank: int | None = None, top_limit: int = 1_000_000) -> DataFrame:
    """(_id, count, rank), 0-based, ties in order of _id, for min_rank <= rank < max_rank.

    Up to ``top_limit`` ranks are a top-k; beyond that the rows are range-partitioned and stored, so that
    ranks hold whatever is lost later, and each range's ranks start after the sizes of those before it.
    """
    order = [F.desc("count"), F.asc("_id")]
    if max_rank is not None and max_rank <= top_limit:
        top = counts.select("_id", "count").orderBy(*order).limit(max_rank)
        out = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    else:
        spark = counts.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = counts.select("_id", "count").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        placed = Scratch(spark, "ranks").put(sorted_.withColumn("__at", F.monotonically_increasing_id()), "placed")
        part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
        sizes = placed.groupBy(part.alias("__part")).count()  # one row a range
        before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        base = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
        out = placed.withColumn("__part", part).join(F.broadcast(base), "__part").select("_id", "count", (F.col("__before") + inside).alias("rank"))
        if max_rank is not None:
            out = out.where(F.col("rank") < max_rank)
    return out.where(F.col("rank") >= min_rank) if min_rank else out
