"""Running models over documents as they arrive.

The operators are plain DataFrame functions, so those with a single
aggregation serve a stream unchanged; events without a watermark are counted
in complete mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkspark import schemas
from linkspark.operators.entities import entity_comentions, entity_counts


def read_documents(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON lines of linked documents, file by file."""
    return spark.readStream.schema(schemas.DOCUMENTS).option("maxFilesPerTrigger", max_files).json(path)


def running_entity_counts(docs: DataFrame, min_count: int = 1):
    """A stream writer in complete mode; choose sink, checkpoint and trigger."""
    return entity_counts(docs, min_count).writeStream.outputMode("complete")


def arriving_comentions(docs: DataFrame):
    """A stream writer in append mode; stateless."""
    return entity_comentions(docs).writeStream.outputMode("append")
