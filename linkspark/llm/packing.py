"""Cost-balanced packing of token sequences.

A document's cost is its tokens plus, for attention, their square over the
sequence length. Documents are taken in groups of bounded size within each
task. A group fills as many sequences as its tokens fill to the brim; its
pieces, in descending order of cost, go each to the sequence of lowest cost
with room for them, and a piece that fits nowhere is cut to fill the roomiest
sequence. Pieces that are left when all sequences are full go on to the next
group.

What a task has left at its end, less than one sequence, is packed in the same
way together with what ``merge_tasks`` other tasks have left. So all padding is
that of one sequence for so many tasks, however the input is dealt out; only
those last pieces are shuffled, a bounded number of bytes for each task.

Sequence ids hold the task's partition in their upper bits: they are unique,
and a task that is run again gives the same ones.

Defined results: null text is empty and is one token, the end id; a null
doc_id stays null; a very long text is cut into whole sequences and a rest;
documents of equal cost go in the order in which the task reads them;
repeated rows are packed each; an empty table gives no piece; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm import tokens
from linkspark.llm.storage import Scratch

_MERGED = 1 << 62  # in the ids of sequences made of several tasks' last pieces


@dataclass(frozen=True)
class PackRules:
    capacity: int = 4096
    group_tokens: int = 1 << 21  # packed together, at most, besides one text
    merge_tasks: int = 256  # whose last pieces are packed together
    linear: float = 1.0
    quadratic: float = 1.0 / 4096


Piece = tuple[int, int, int, int, int]


def assign(length: np.ndarray, rules: PackRules, last: bool = True) -> tuple[list[Piece], list[tuple[int, int, int]]]:
    """(document, start, length, sequence, offset) of all pieces that are placed, and (document, start, length) of those that are left.

    Nothing is left if this is the ``last`` group; else all sequences are full.
    """
    size = rules.capacity
    out: list[Piece] = []
    todo: list[tuple[int, int, int]] = []
    whole = 0
    for d, n in enumerate(length.tolist()):
        for k in range(n // size):
            out.append((d, k * size, size, whole, 0))
            whole += 1
        if n % size:
            todo.append((n % size, d, n - n % size))
    total = sum(n for n, _, _ in todo)
    bins = -(-total // size) if last else total // size
    if not bins:
        return out, [(d, start, n) for n, d, start in todo]
    left: list[tuple[int, int, int]] = []
    room, cost = np.full(bins, size), np.zeros(bins)
    free = bins * size
    todo.sort(key=lambda x: (-x[0], x[1]))  # cost rises with length
    for n, d, start in todo:
        while n and free:
            fits = room >= n
            k = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            take = min(n, int(room[k]))
            out.append((d, start, take, whole + k, size - int(room[k])))
            room[k] -= take
            free -= take
            cost[k] += rules.linear * take + rules.quadratic * take * take
            start, n = start + take, n - take
        if n:
            left.append((d, start, n))
    return out, left


class _Group:
    """Runs of token ids that wait to be packed, each with its document's name, size, and start in it."""

    def __init__(self, rules: PackRules, with_ids: bool):
        self.rules, self.with_ids = rules, with_ids
        self.names: list[pa.Array] = []
        self.ids: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self.start: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, names: pa.Array, ids: np.ndarray, length: np.ndarray, start: np.ndarray, tokens: np.ndarray) -> None:
        for held, new in ((self.names, names), (self.ids, ids), (self.length, length), (self.start, start), (self.tokens, tokens)):
            held.append(new)
        self.size += len(ids)

    def pack(self, number: int, last: bool) -> tuple[pa.RecordBatch | None, int]:
        """The rows of the pieces placed in sequences from ``number`` on, and the next number. What is left stays in the group."""
        names, ids = pa.concat_arrays(self.names), np.concatenate(self.ids).astype("<u4")
        length, start, tokens = np.concatenate(self.length), np.concatenate(self.start), np.concatenate(self.tokens)
        base = np.concatenate([[0], np.cumsum(length)])
        placed, left = assign(length, self.rules, last)
        self.__init__(self.rules, self.with_ids)
        if left:
            d, at, n = (np.array(x, np.int64) for x in zip(*left, strict=True))
            self.add(names.take(pa.array(d)), np.concatenate([ids[a : a + m] for a, m in zip((base[d] + at).tolist(), n.tolist(), strict=True)]), n, start[d] + at, tokens[d])
        if not placed:
            return None, number
        d, at, n, seq, offset = (np.array(x, np.int64) for x in zip(*sorted(placed), strict=True))
        begin = (base[d] + at).tolist()
        own = [ids[a : a + m] for a, m in zip(begin, n.tolist(), strict=True)]
        crc = pa.array([zlib.crc32(x) for x in own], pa.int64())
        shown = [pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))] * self.with_ids
        cost = pa.array(self.rules.linear * n + self.rules.quadratic * n * n)
        return _rows(names.take(pa.array(d)), start[d] + at, n, crc, tokens[d], pa.array(seq + number), pa.array(offset), cost, shown), number + int(seq.max()) + 1

    def rest(self) -> pa.RecordBatch | None:
        """What is left, as rows that have no sequence yet and hold their ids."""
        if not self.size:
            return None
        n, ids = np.concatenate(self.length), np.concatenate(self.ids).astype("<u4")
        cut = np.concatenate([[0], np.cumsum(n)]).tolist()
        none = pa.nulls(len(n), pa.int64())
        rows = _rows(pa.concat_arrays(self.names), np.concatenate(self.start), n, none, np.concatenate(self.tokens), none, none, pa.nulls(len(n), pa.float64()), [pa.nulls(len(n), pa.list_(pa.int64()))] * self.with_ids)
        task = np.full(len(n), TaskContext.get().partitionId())
        arrays = [*rows.columns[: rows.num_columns - 2], pa.array(task, pa.int32()), pa.array([ids[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=rows.schema.names)


def _rows(names, start, n, crc, tokens, seq, offset, cost, shown) -> pa.RecordBatch:
    arrays = [names, pa.array(start), pa.array(n), crc, pa.array(tokens), seq, offset, cost, *shown, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", *["ids"] * len(shown), "__task", "__ids"])


def pack(docs: DataFrame, path: str, rules: PackRules = PackRules(), with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost of each piece, and on request its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = tokens.encoder(path, False)
        number = TaskContext.get().partitionId() << 32
        group = _Group(rules, with_ids)
        for batch in batches:
            for at in range(0, len(batch), 512):
                column = batch.column(0).slice(at, 512)
                for a, b, texts in tokens.text_runs(batch.column(1).slice(at, 512).to_pylist()):
                    ids, cut = work.encode(texts)
                    group.add(column.slice(a, b - a), ids, np.diff(cut), np.zeros(b - a, np.int64), np.diff(cut))
                    if group.size >= rules.group_tokens:
                        rows, number = group.pack(number, False)
                        if rows is not None:
                            yield rows
        if group.size:
            rows, number = group.pack(number, False)
            if rows is not None:
                yield rows
        if (rows := group.rest()) is not None:
            yield rows

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("__task", "ascending"), ("__ids", "ascending"), ("start", "ascending")]).combine_chunks()  # whatever order the shuffle left
        group = _Group(rules, with_ids)
        ids = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("__ids").chunk(0)]
        group.add(table.column("doc_id").chunk(0), np.concatenate(ids), *(table.column(c).to_numpy() for c in ("length", "start", "doc_tokens")))
        rows, _ = group.pack(_MERGED | key[0].as_py() << 32, True)
        return pa.Table.from_batches([rows]).select(names)

    kind = docs.select("doc_id").schema[0].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double" + ", ids array<long>" * with_ids)])
    names = schema.names
    inner = T.StructType([*schema, *T.StructType.fromDDL("__task int, __ids binary")])
    pieces = Scratch(docs.sparkSession, "packing").put(docs.select("doc_id", "text").mapInArrow(run, inner), "pieces")
    whole = pieces.where("sequence_id IS NOT NULL").select(*names)
    rest = pieces.where("sequence_id IS NULL").select(F.expr(f"__task div {rules.merge_tasks}").alias("__group"), *names, "__task", "__ids")
    return whole.unionAll(rest.groupBy("__group").applyInArrow(merge, schema))
