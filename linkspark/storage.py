"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


#: Of an Arrow batch between Spark and Python; both sides hold a few of them for each task.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for the whole session, made once by whoever owns it (the queries and the pipeline here, never an operator).

    Small Arrow batches keep long texts from taking much more memory than short ones, and the
    shuffle files of a finished query go at once. Operators give the same rows without them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local folder serves if all tasks run in this process, as in tests; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="linkspark-")


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class Scratch:
    """The intermediate tables of one job, below one folder of the cluster's.

    ``put`` writes a table and reads it back, which cuts the lineage in a way that survives lost
    executors. ``drop`` deletes tables that nothing reads any more. What a returned DataFrame
    still reads stays until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.places: dict[int, tuple[DataFrame, str]] = {}
        store, path = _path(spark, self.folder)
        store.mkdirs(path)
        store.deleteOnExit(path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.folder}/{name}-{len(self.places)}"
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self.places[id(out)] = out, where
        return out

    def path(self, name: str) -> str:
        """A place below the folder for files of other formats."""
        return f"{self.folder}/{name}"

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.forget(self.places[id(df)][1])

    def forget(self, where: str) -> None:
        """Deletes a place of ``path``."""
        store, path = _path(self.spark, where)
        store.delete(path, True)
