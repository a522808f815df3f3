"""Sharding along a Hilbert curve.

Several metadata columns are quantised: a value's cell is its place among all
rows in the order of that column, scaled to the whole axis, so that a column
of four values parts the axis in four as one of millions does, and a value
that a third of the rows have takes a third of it. The rows are sorted by
their index on the Hilbert curve through that grid and cut into runs: each
shard is then a compact box in all of the dimensions at once, and its files'
ranges prune on any of them. The runs follow the law ``rows``: their counts
are at most one apart.

Only sizes, checksums and grid cells are shuffled, never texts; ties on the
curve are broken by id and checksum, and then by a row number, so a hot cell
or a row that is repeated without end is spread like any other.

Columns of numbers, strings, booleans, dates and timestamps can be dimensions;
others are refused, for they have no order that a predicate could use.

Defined results: null text has size 16 and the checksum of no bytes; very
long texts count by their size only; null metadata take the first cell;
repeated rows are placed each (equal ones in any order); an empty table gives
no row; other columns are ignored, or pass through ``write_shards``.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.storage import Scratch, as_struct, quoted, unpacked


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (below 2**bits), by Gray-code reflection and rotation of the axes."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(n):
            high = (x[axis] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high, low, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            out = out << 1 | (x[axis] >> level & 1)
    return out


def text_cells(df: DataFrame, column: str, bits: int, scratch: Scratch) -> list[tuple[str, int, int]]:
    """(value, its cell, the cell of the values after it), ascending, of the values at which a cell ends: at most 2**bits.

    Values are counted, ranged in order and summed up range by range; one row a range comes to the driver, and the result.
    """
    cells = 1 << bits
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = scratch.put(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "values")
    placed = scratch.put(counts.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()), "placed")
    before, total = {}, df.where(F.col(column).isNull()).count()  # nulls come first
    for part, n in sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("n")).collect()):
        before[part], total = total, total + n

    base = df.sparkSession.createDataFrame(sorted(before.items()) or [(0, 0)], "part int, before long")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    run = placed.join(F.broadcast(base), "part").select("value", "n", upto.alias("upto"))
    cell = lambda place: F.expr(f"least({place} * {cells} div {max(total, 1)}, {cells - 1})")
    run = run.select("value", cell("(upto - n + n div 2)").alias("own"), cell("upto").alias("after"), cell("(upto - n)").alias("since"))
    found = run.where("after > since").select("value", "own", "after").collect()
    scratch.drop(counts, placed)
    return sorted(tuple(r) for r in found)


def number_cuts(df: DataFrame, columns: list[str], bits: int) -> list[list[float]]:
    """The values at 2**bits - 1 even places of each column, repeated where one value takes several places."""
    cells = 1 << bits
    points = [k / cells for k in range(1, cells)]
    row = df.agg(*(F.percentile_approx(c, points, 10_000) for c in columns)).first()
    return [[float(x) for x in r or []] for r in row]


def _ordered(docs: DataFrame, name: str) -> Column:
    """A column as a number or a string in the same order."""
    column, kind = F.col(quoted(name)), docs.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return column.cast("int")
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    if not isinstance(kind, (T.NumericType, T.StringType, T.NullType)):
        raise ValueError(f"{name}: rows can't be ordered by {kind.simpleString()}")
    return column.cast("string") if isinstance(kind, (T.StringType, T.NullType)) else column


def shard(docs: DataFrame, shards: int = 40, by: tuple[str, ...] = ("source", "lang", "size", "doc_id"), bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve_index of each row.

    by: columns of ``docs``, or ``size``; those missing are left out.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    return _placed(docs, scratch, shards, by, bits).drop("__row_number")


def _placed(docs: DataFrame, scratch: Scratch, shards: int, by: tuple[str, ...], bits: int) -> DataFrame:
    """The rows of ``shard``, with ``__row_number`` if ``docs`` has it."""
    bare = F.octet_length(F.coalesce("text", F.lit("")))
    dims = [c for c in by if c == "size" or c in docs.columns]
    own = F.col("__row_number") if "__row_number" in docs.columns else F.monotonically_increasing_id()
    narrow = docs.select(
        "doc_id",
        (bare.cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        own.alias("__row_number"),
        *(_ordered(docs, c).alias(f"__dim{k}") for k, c in enumerate(dims) if c not in ("size", "doc_id")),
    )
    narrow = scratch.put(narrow, "input")
    column = {c: c if c in ("size", "doc_id") else f"__dim{k}" for k, c in enumerate(dims)}
    kind = dict(narrow.dtypes)
    numbers = [c for c in dims if kind[column[c]] != "string"]
    cuts: dict[str, list] = dict(zip(numbers, number_cuts(narrow, [column[c] for c in numbers], bits), strict=True)) if numbers else {}
    cuts |= {c: text_cells(narrow, column[c], bits, scratch) for c in dims if c not in cuts}

    def text_cell(bound: list[tuple[str, int, int]], value: str | None) -> int:
        if value is None:
            return 0
        k = bisect_left(bound, (value,))
        if k < len(bound) and bound[k][0] == value:
            return bound[k][1]
        return bound[k - 1][2] if k else 0

    def index(*values: pd.Series) -> pd.Series:
        cells = []
        for c, v in zip(dims, values, strict=True):
            if c in numbers:
                x, bound = v.fillna(0).to_numpy(float), np.array(cuts[c])
                middle = (np.searchsorted(bound, x, "left") + np.searchsorted(bound, x, "right")) // 2
                cells.append(np.where(v.isna(), 0, middle))
            else:
                known = {x: text_cell(cuts[c], x) for x in v.unique()}
                cells.append(v.map(known).fillna(0).to_numpy(np.int64))
        return pd.Series(hilbert_index(np.stack(cells, 1).astype(np.int64), bits))

    curve = F.pandas_udf(index, "long")
    placed = narrow.withColumn("curve_index", curve(*(F.col(column[c]) for c in dims)) if dims else F.lit(0).cast("long"))
    placed = placed.select("doc_id", "size", "text_crc32", "curve_index", "__row_number")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve_index", "doc_id", "text_crc32", "__row_number"]
    run = scratch.put(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "order")
    scratch.drop(narrow)
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    base, total = {}, 0
    for p, n in sorted(tuple(r) for r in run.groupBy(part).count().collect()):  # as many as there are ranges
        base[p] = total
        total += n
    before = docs.sparkSession.createDataFrame(sorted(base.items()) or [(0, 0)], "__part long, __before long")
    rank: Column = F.col("__before") + inside
    number = F.expr(f"(`__rank` * {shards}) div {max(total, 1)}")
    ranked = run.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("__rank", rank).withColumn("shard", number.cast("int"))
    first = F.expr(f"(`shard` * {max(total, 1)}L + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("__rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index", "__row_number")


def write_shards(docs: DataFrame, out: str, shards: int = 40, by: tuple[str, ...] = ("source", "lang", "size", "doc_id"), bits: int = 6) -> None:
    """Writes the rows under ``out``, partitioned by shard, with ``slot``; columns of ``docs`` of those two names are replaced.

    The rows are stored with a number first and joined by it, so equal rows need no rule. They are
    ranged by shard and slot over all tasks: a shard has as many files as its size asks for, each with a run of slots.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = scratch.put(docs.select(as_struct(docs), F.monotonically_increasing_id().alias("__row_number")), "rows")
    narrow = rows.select("__row_number", *unpacked([c for c in {"doc_id", "text", *by} if c in docs.columns]))
    place = _placed(narrow, scratch, shards, by, bits).select("__row_number", "shard", "slot")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = rows.join(place, "__row_number").select(*unpacked(kept), "shard", "slot")
    joined.repartitionByRange(max(parts, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)
