"""Rows whose columns keep their names and types. Session settings and intermediate tables are ``linkspark.storage``'s."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.storage import BATCH_BYTES, BATCH_ROWS, Scratch, prepare, shared_folder

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Scratch", "as_struct", "extended", "packed", "prepare", "quoted", "shared_folder", "table", "unpacked", "without"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(schema: T.StructType, new: str) -> T.StructType:
    """The fields of ``schema``, whatever their names are, and those of the DDL text ``new`` after them."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(new).fields])


def quoted(name: str) -> str:
    """A column's name as a reference: dots, blanks and signs in it are part of the name."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, text: str, new: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(__row, __text) of every row, for ``mapInArrow``, which takes no dots in names; and the way back.

    The way back has the columns of ``docs``, but for those that ``new`` ones replace, and then the new ones.
    """
    others = without(docs, new)
    inside = [F.col(quoted(c)).alias(c) for c in others if c != text]
    source = docs.select(F.struct(F.lit(True).alias("__is"), *inside).alias("__row"), F.col(quoted(text)).alias("__text"))

    def back(out: DataFrame) -> DataFrame:
        return out.select(*((F.col("__text") if c == text else F.col(f"__row.{quoted(c)}")).alias(c) for c in others), *new)

    return source, back


def without(df: DataFrame, new: list[str]) -> list[str]:
    """The columns of ``df`` but those that new ones replace. Case doesn't tell names apart, as in Spark."""
    gone = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in gone]


def as_struct(df: DataFrame, name: str = "__row") -> Column:
    """All columns of a row as one, so that none clashes with a new one; ``unpacked`` has them back."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias(name)


def unpacked(columns: list[str], put: dict[str, Column] | None = None, name: str = "__row") -> list[Column]:
    """The columns of ``as_struct`` as they came, but for those in ``put``."""
    put = put or {}
    return [(put[c] if c in put else F.col(f"{name}.{quoted(c)}")).alias(c) for c in columns]
