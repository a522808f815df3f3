"""Token ids on disk: frequency-ranked, byte-aligned, with separate control bytes.

An id is replaced by its rank by corpus frequency, so that frequent ids take
one byte. Four ranks share a control byte of four two-bit lengths; control
bytes and data bytes lie apart, and decoding is a numpy table lookup.

A file row is a block of documents in ascending doc_id order: ``part``
(the range of ids it lies in), ``start`` (ids before it in that range),
``doc_ids``, ``lengths`` and ``payload``. Spark's Parquet writer stores the
rows, so any shared store serves and lost executors are made up for; the
rank table lies beside them.

Texts are ranged by doc_id and encoded in that order; a repeated row is ranged
by its place too, so any number of equal rows is dealt over all tasks. Ids, of
two bytes if the vocabulary allows it, are stored with the counts of each task
until the ranks are known. (Shuffling ids in place of texts was measured and
not kept, see the README.)

Defined results: null text is empty and has the end id only; very long texts
are encoded whole and lie in one block; doc_id may be of any type that Spark
orders and Arrow has, and null ids come first; rows of one id are in the order
of their texts' hashes, and repeated rows each keep their place; an empty
table gives no block; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm import tokens
from linkspark.llm.storage import Scratch, extended

BLOCK_IDS = 1 << 16
CACHE_SEGMENTS = 900_000  # of each worker: about 1 kB each at the peak
MAGIC = b"LVB1"
_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1  # by control byte


def encode_block(ranks: np.ndarray) -> bytes:
    """Magic, count and number of data bytes (little-endian, 4 each), control bytes, data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    code = np.concatenate([code, np.zeros(-len(code) % 4, np.uint8)]).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return MAGIC + np.array([len(ranks), len(data)], "<u4").tobytes() + control.tobytes() + data.tobytes()


def decode_block(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a block of this format")
    count, size = np.frombuffer(payload, "<u4", 2, 4).tolist()
    control = np.frombuffer(payload, np.uint8, -(-count // 4), 12)
    length = _LENGTHS[control].reshape(-1)[:count]
    data = np.concatenate([np.frombuffer(payload, np.uint8, size, 12 + len(control)), np.zeros(3, np.uint8)]).astype(np.uint32)
    at = np.cumsum(length, dtype=np.int64) - length
    out = data[at]
    for k in (1, 2, 3):
        longer = length > k
        if not longer.any():
            break
        out[longer] |= data[at[longer] + k] << np.uint32(8 * k)
    return out


def _tokenized(docs: DataFrame, path: str, partitions: int) -> DataFrame:
    """(doc_id, part, start in part, width, ids, counts) in ascending doc_id order, ids in ``width`` bytes each; the last row of a task has its counts alone."""
    keys = ["doc_id", "__tie", "__place"]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("__tie"), F.monotonically_increasing_id().alias("__place"))
    ordered = ordered.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    names = ["doc_id", "part", "start", "width", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, total, kind = TaskContext.get().partitionId(), 0, np.zeros(1, np.int64), None
        work = tokens.encoder(path, True, CACHE_SEGMENTS)
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, len(batch), 512):
                column = batch.column(0).slice(at, 512)
                for a, b, texts in tokens.text_runs(batch.column(1).slice(at, 512).to_pylist()):
                    ids, cut = work.encode(texts)
                    raw = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                    width = raw.itemsize
                    value = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((cut * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                    yield pa.RecordBatch.from_arrays([column.slice(a, b - a), pa.array(np.full(b - a, part), pa.int32()), pa.array(before + cut[:-1]), pa.array(np.full(b - a, width), pa.int32()), value, pa.nulls(b - a, pa.binary())], names=names)
                    before += int(cut[-1])
                    own = np.bincount(ids, minlength=len(total))
                    own[: len(total)] += total
                    total = own
        at = np.flatnonzero(total)
        if len(at):
            counts = np.stack([at, total[at]], 1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([part], pa.int32()), pa.array([before]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names=names)

    kind = T.StructType([T.StructField("doc_id", ordered.schema["doc_id"].dataType)])  # nullable, for the counts' row
    return ordered.mapInArrow(run, extended(kind, "part int, start long, width int, ids binary, counts binary"))


def frequencies(stored: DataFrame) -> list[tuple[int, int]]:
    """(id, count) over all documents, from the counts of each task; no more rows than the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                pair = np.frombuffer(value.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["id", "n"])

    counted = stored.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [(r[0], r[1]) for r in counted.collect()]


def write_tokens(docs: DataFrame, path: str, out: str, partitions: int | None = None) -> None:
    """Encodes all documents with the tokenizer file at ``path`` and writes the blocks and the rank table under ``out``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = scratch.put(_tokenized(docs, path, partitions), "ids")
    order = sorted(frequencies(stored), key=lambda x: (-x[1], x[0]))
    rank = np.zeros(max([i for i, _ in order], default=0) + 1, np.uint32)
    rank[[i for i, _ in order]] = np.arange(len(order))
    spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(order)], "rank int, id int, n long").coalesce(1).write.parquet(f"{out}/ranks")
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, start, width = (batch.column(k).to_pylist() for k in (1, 2, 3))
            ids = [np.frombuffer(x.as_buffer(), f"<u{w}") for x, w in zip(batch.column(4), width, strict=True)]
            first, held = 0, 0
            for k in range(len(batch)):
                if k > first and (part[k] != part[first] or held >= BLOCK_IDS):
                    yield block(batch.column(0).slice(first, k - first), part[first], start[first], ids[first:k])
                    first, held = k, 0
                held += len(ids[k])
            if len(batch):
                yield block(batch.column(0).slice(first), part[first], start[first], ids[first:])

    def block(doc_ids: pa.Array, part: int, start: int, ids: list[np.ndarray]) -> pa.RecordBatch:
        payload = encode_block(shared.value[np.concatenate(ids)])
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([doc_ids])), pa.array([[len(i) for i in ids]], pa.list_(pa.int32())), pa.array([payload], pa.binary())],
            names=["part", "start", "doc_ids", "lengths", "payload"],
        )

    kind = T.ArrayType(stored.schema["doc_id"].dataType)
    schema = T.StructType([*T.StructType.fromDDL("part int, start long"), T.StructField("doc_ids", kind), *T.StructType.fromDDL("lengths array<int>, payload binary")])
    stored.where(F.col("counts").isNull()).mapInArrow(run, schema).write.parquet(f"{out}/blocks")
    scratch.drop(stored)


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and on request ids, from the files."""
    order = spark.read.parquet(f"{out}/ranks").select("rank", "id").collect()
    ids_by_rank = np.zeros(len(order), np.uint32)
    ids_by_rank[[r[0] for r in order]] = [r[1] for r in order]
    blocks = spark.read.parquet(f"{out}/blocks")
    ends = blocks.withColumn("end", F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    parts = sorted(tuple(r) for r in ends.groupBy("part").agg(F.max("end")).collect())
    base, before = {}, 0
    for part, size in parts:  # as many as there are ranges
        base[part] = before
        before += size
    kind = T.StructType([T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType)])
    shared = spark.sparkContext.broadcast((ids_by_rank, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = shared.value
        for batch in batches:
            for k in range(len(batch)):
                ids = table[decode_block(batch.column(4)[k].as_py())].astype("<u4")
                length = np.array(batch.column(3)[k].as_py(), np.int64)
                cut = np.concatenate([[0], np.cumsum(length)])
                begin = base[batch.column(0)[k].as_py()] + batch.column(1)[k].as_py() + cut[:-1]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                arrays = [batch.column(2)[k].values, pa.array(begin), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return blocks.mapInArrow(run, extended(kind, "start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids))
