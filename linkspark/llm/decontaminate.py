"""Benchmark decontamination by greedy string tiling.

Test items that share a run of ``min_match`` words with a document are its
candidates (found by a hash join of word windows). For each candidate, the
longest common run of words that no earlier tile has marked is marked again
and again, running Karp-Rabin hashes giving the seeds, until none of
``min_match`` words is left. A document is contaminated by an item when the
tiles, in whatever order they stand, cover ``threshold`` of its words.

Words are lower-cased (A-Z) and lose surrounding ASCII punctuation; words
that are all punctuation don't count.

Test items of up to ``block_bytes`` are broadcast, and each document is judged
where it lies. Beyond that, hashes of the items' windows and of those windows
of documents that may be among them are joined, and each pair that shares one
is judged with both of its texts. Equal texts are judged once there.

Seeds are gone through in blocks of bounded size and kept as maximal runs
only, so texts of one word repeated take no more memory than others.

Defined results: null and empty texts, and items of fewer than ``min_match``
words, match nothing; very long texts are judged whole; of tiles of one
length the first in the document, then in the item, is marked first; repeated
documents or items are each judged; an empty table on either side gives no
match; other columns pass through, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from linkspark.llm import bytescan as B
from linkspark.llm.storage import Scratch, as_struct, extended, packed, quoted, unpacked

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass(frozen=True)
class TilingRules:
    min_match: int = 5
    threshold: float = 0.6
    block_bytes: int = 32 << 20  # of test texts that are broadcast; more are joined
    filter_bits: int = 28  # 2 ** bits bits, 32 MB, tell which windows of documents are joined


def bare_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without surrounding punctuation, and where each document's begin."""
    starts, ends, _ = B.words(raw, at)
    starts, ends = starts.copy(), ends.copy()
    edge = _PUNCT[raw]
    while True:
        cut = (ends > starts) & edge[ends - 1]
        if not cut.any():
            break
        ends -= cut
    while True:
        cut = (ends > starts) & edge[np.minimum(starts, len(raw) - 1)]
        if not cut.any():
            break
        starts += cut
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return B.hashes(raw, starts, ends, lower=True), np.searchsorted(starts, at)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
_SEEDS = 1 << 18  # gone through at once
_TRIED = 1 << 12  # runs looked at together


def _free_windows(taken: np.ndarray, size: int) -> np.ndarray:
    """Running count (n+1 numbers) of the places from which ``size`` words are free."""
    total = np.concatenate([[0], np.cumsum(taken)])
    free = np.zeros(len(taken) + 1, np.int64)
    if len(taken) >= size:
        free[1 : len(taken) - size + 2] = total[size:] == total[:-size]
    return np.cumsum(free)


def tile(own: int, other: int, runs: Runs, size: int) -> list[tuple[int, int, int]]:
    """Tiles (start in one, start in the other, length) of a greedy tiling of texts of ``own`` and ``other`` words.

    runs: starts in both and lengths of all maximal common runs of ``size`` words or more.
    """
    order = np.lexsort((runs[1], runs[0], -runs[2]))
    i, j, n = (x[order] for x in runs)
    marked, used = np.zeros(own, bool), np.zeros(other, bool)
    free = [_free_windows(marked, size), _free_windows(used, size)]
    pieces: list[tuple[int, int, int]] = []  # of runs that tiles have cut: a heap of (-length, start, start)
    ready: list[tuple[int, int, int]] = []  # the next runs that may be free, the first one last
    tiles, at, stale = [], 0, False
    while True:
        while not ready and at < len(i):
            if stale:
                free, stale = [_free_windows(marked, size), _free_windows(used, size)], False
            a, b, c = i[at : at + _TRIED], j[at : at + _TRIED], n[at : at + _TRIED]
            may = (free[0][a + c - size + 1] > free[0][a]) & (free[1][b + c - size + 1] > free[1][b])
            ready = list(zip((-c[may]).tolist(), a[may].tolist(), b[may].tolist()))[::-1]
            at += _TRIED
            if not free[0][-1] or not free[1][-1]:
                at, ready, pieces = len(i), [], []
        if not ready and not pieces:
            return tiles
        c, a, b = ready.pop() if not pieces or ready and ready[-1] < pieces[0] else heapq.heappop(pieces)
        open_ = ~(marked[a : a - c] | used[b : b - c])
        if open_.all():
            marked[a : a - c] = True
            used[b : b - c] = True
            tiles.append((a, b, -c))
            stale = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if y - x >= size:
                heapq.heappush(pieces, (x - y, a + x, b + x))


@dataclass(frozen=True)
class Index:
    """The windows of test items, whose words lie one after the other."""

    ids: list
    first: np.ndarray  # where each item's words begin, and the end of the last
    key: np.ndarray  # ascending window hashes
    place: np.ndarray  # the word at which each window begins
    quick: np.ndarray  # by the low 16 bits of the hash

    def words(self, item: int) -> int:
        return int(self.first[item + 1] - self.first[item])


def build_index(items: list[tuple[object, str | None]], rules: TilingRules) -> Index:
    raw, at = B.text_buffers(pa.array([t for _, t in items], pa.string()))
    word, first = bare_words(raw, at) if len(raw) else (np.zeros(0, np.uint64), np.zeros(len(items) + 1, np.int64))
    key, where = B.windows(word, first, rules.min_match)
    order = np.argsort(key, kind="stable")
    quick = np.zeros(1 << 16, bool)
    quick[(key & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Index([i for i, _ in items], first, key[order], where[order], quick)


def _joined(at: np.ndarray, place: np.ndarray, n: np.ndarray, doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of seeds with those joined that follow each other on one diagonal."""
    order = np.lexsort((at, at - place))
    at, place, n, doc, item = (x[order] for x in (at, place, n, doc, item))
    head = np.ones(len(at), bool)
    head[1:] = (np.diff(at - place) != 0) | (at[1:] != at[:-1] + n[:-1]) | (np.diff(doc) != 0) | (np.diff(item) != 0)
    begin = np.flatnonzero(head)
    return at[begin], place[begin], np.add.reduceat(n, begin), doc[begin], item[begin]


def _runs(near: np.ndarray, lo: np.ndarray, count: np.ndarray, first: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
    """All maximal runs of seeds: start in the documents' words and in the items', number of seeds, document, item.

    near, lo, count: windows of documents, and where and how many of the index are equal to each.
    """
    ends = np.cumsum(count)
    found = []
    for a in range(0, int(ends[-1]), _SEEDS):
        seed = np.arange(a, min(a + _SEEDS, int(ends[-1])))
        which = np.searchsorted(ends, seed, "right")
        at, place = near[which], index.place[lo[which] + seed - (ends - count)[which]]
        doc, item = np.searchsorted(first, at, "right") - 1, np.searchsorted(index.first, place, "right") - 1
        found.append(_joined(at, place, np.ones(len(at), np.int64), doc, item))
    return found[0] if len(found) == 1 else _joined(*(np.concatenate(x) for x in zip(*found, strict=True)))


def matches(raw: np.ndarray, at: np.ndarray, index: Index, rules: TilingRules) -> list[tuple[int, int, int, int]]:
    """(document, item, words covered, tiles) for all pairs whose common runs are long enough together for ``threshold``."""
    word, first = bare_words(raw, at)
    key, where = B.windows(word, first, rules.min_match)
    if not len(key) or not len(index.key):
        return []
    near = np.flatnonzero(index.quick[(key & np.uint64(0xFFFF)).astype(np.int64)])
    lo = np.searchsorted(index.key, key[near], "left")
    count = np.searchsorted(index.key, key[near], "right") - lo
    near, lo, count = near[count > 0], lo[count > 0], count[count > 0]
    if not len(near):
        return []
    begin, place, n, doc, item = _runs(where[near], lo, count, first, index)
    n = n + rules.min_match - 1
    order = np.lexsort((item, doc))
    begin, place, n, doc, item = (x[order] for x in (begin, place, n, doc, item))
    head = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0)]))
    enough = np.add.reduceat(n, head) >= rules.threshold * np.diff(index.first)[item[head]]
    out = []
    for a, b in zip(head[enough].tolist(), np.append(head[1:], len(doc))[enough].tolist(), strict=True):
        d, k = int(doc[a]), int(item[a])
        own = begin[a:b] - first[d], place[a:b] - index.first[k], n[a:b]
        tiles = tile(int(first[d + 1] - first[d]), index.words(k), own, rules.min_match)
        out.append((d, k, sum(m for _, _, m in tiles), len(tiles)))
    return out


_FIGURE_NAMES = ["item_words", "covered_words", "n_tiles", "coverage", "contaminated"]
_FIGURES = "item_words long, covered_words long, n_tiles long, coverage double, contaminated boolean"


def _figures(rows: list[tuple[int, int, int]]) -> list[pa.Array]:
    """Columns of (item words, words covered, tiles)."""
    size, covered, tiles = zip(*rows, strict=True)
    return [*(pa.array(x, pa.int64()) for x in (size, covered, tiles)), pa.array([c / s for s, c in zip(size, covered, strict=True)], pa.float64()), pa.array([True] * len(rows))]


def _few(benchmark: DataFrame, rules: TilingRules) -> bool:
    """Whether all test items, with some bytes for each, are within the bound of a broadcast."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 64 * F.count(F.lit(1))).first()[0]
    return size <= rules.block_bytes


def _shared_index(benchmark: DataFrame, rules: TilingRules):
    rows = sorted(((r[0], r[1]) for r in benchmark.select("item_id", "text").collect()), key=lambda r: (str(r[0]), r[1] or ""))
    return benchmark.sparkSession.sparkContext.broadcast(build_index(rows, rules))


def _text_key(text: Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def _windows(df: DataFrame, rules: TilingRules, slots=None) -> DataFrame:
    """(name, key): the different window hashes of each text; df: name, text. With ``slots``, those whose upper bits are among them."""
    schema = T.StructType([df.schema["name"], *T.StructType.fromDDL("key long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, raw, at in B.slices(batch.column(1)):
                word, first = bare_words(raw, at) if len(raw) else (np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
                key, where = B.windows(word, first, rules.min_match)
                if slots is not None:
                    near = _has(slots.value, key, rules.filter_bits)
                    key, where = key[near], where[near]
                owner = np.searchsorted(first, where, "right") - 1
                pair = np.unique(np.stack([owner.astype(np.uint64), key], 1), axis=0) if len(key) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[:, 0].astype(np.int64) + i)), pa.array(pair[:, 1].view(np.int64))], names=["name", "key"])

    return df.select("name", "text").mapInArrow(run, schema)


def _has(bits: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    slot = (key >> np.uint64(64 - width)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _slots(windows: DataFrame, rules: TilingRules) -> np.ndarray:
    """A bit for each value of the upper bits of a window hash; the driver gets that many bits and no more."""
    width = rules.filter_bits
    high = max(0, width - 20)  # a part has 2 ** 20 bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = (batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)
            low = width - high
            for part in np.unique(slot >> low).tolist():
                own = slot[slot >> low == part] & ((1 << low) - 1)
                bits = parts.setdefault(part, np.zeros(1 << low, bool))
                bits[own] = True
        for part, bits in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros(max(1, 1 << width >> 3), np.uint8)
    size = len(out) >> high
    parted = windows.repartition(F.shiftrightunsigned("key", 64 - high) if high else F.lit(0))
    for part, bits in parted.mapInArrow(run, "part int, bits binary").toLocalIterator():
        out[part * size : (part + 1) * size] |= np.frombuffer(bits, np.uint8)
    return out


def seed_join(docs: DataFrame, benchmark: DataFrame, rules: TilingRules = TilingRules()) -> DataFrame:
    """(k1, k2, item_id, figures) of each contaminated text and item, stored. docs: text. No table is broadcast whole; the texts of pairs are joined."""
    scratch = Scratch(docs.sparkSession, "tiling")
    items = scratch.put(benchmark.select(F.monotonically_increasing_id().alias("name"), "item_id", "text"), "items")
    seeds = scratch.put(_windows(items.select("name", "text"), rules), "seeds")
    slots = docs.sparkSession.sparkContext.broadcast(_slots(seeds, rules))
    named = docs.where(F.col("text").isNotNull()).select(_text_key(F.col("text")).alias("name"), "text")
    near = scratch.put(_windows(named, rules, slots).select("name.*", "key").distinct(), "near")
    pairs = scratch.put(near.join(seeds, "key").select("k1", "k2", "name").distinct(), "pairs")
    wanted = pairs.select("k1", "k2").distinct()
    texts = named.select("name.*", "text").join(wanted, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    both = pairs.join(texts, ["k1", "k2"]).join(items.withColumnRenamed("text", "item"), "name").select("k1", "k2", "item_id", "text", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for k in range(len(batch)):
                index = build_index([(None, batch.column(4)[k].as_py())], rules)
                raw, at = B.text_buffers(batch.column(3).slice(k, 1))
                for _, _, covered, tiles in matches(raw, at, index, rules):
                    if covered >= rules.threshold * index.words(0):
                        rows.append((index.words(0), covered, tiles))
                        kept.append(k)
            if rows:
                taken = batch.select([0, 1, 2]).take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*taken.columns, *_figures(rows)], names=["k1", "k2", "item_id", *_FIGURE_NAMES])

    out = scratch.put(both.mapInArrow(run, extended(both.select("k1", "k2", "item_id").schema, _FIGURES)), "found")
    scratch.drop(items, seeds, near, pairs)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: TilingRules = TilingRules()) -> DataFrame:
    """One row for each contaminated document and item: id, item_id, item_words, covered_words, n_tiles, coverage, contaminated."""
    source = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    items = benchmark.select("item_id", "text")
    if not _few(items, rules):
        found = seed_join(source.select("text"), items, rules)
        keyed = source.where(F.col("text").isNotNull()).select("doc_id", _text_key(F.col("text")).alias("k")).select("doc_id", "k.*")
        return keyed.join(found, ["k1", "k2"]).drop("k1", "k2")
    shared = _shared_index(items, rules)
    kind = T.StructType([source.schema["doc_id"], items.schema["item_id"]])
    item_kind = to_arrow_type(items.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        item_ids = None
        for batch in batches:
            for i, _, raw, at in B.slices(batch.column(1)):
                rows = [(i + d, k, c, n) for d, k, c, n in matches(raw, at, index, rules) if c >= rules.threshold * index.words(k)]
                if rows:
                    if item_ids is None:
                        item_ids = pa.array(index.ids, item_kind)
                    named = [batch.column(0).take(pa.array([r[0] for r in rows])), item_ids.take(pa.array([r[1] for r in rows]))]
                    yield pa.RecordBatch.from_arrays([*named, *_figures([(index.words(k), c, n) for _, k, c, n in rows])], names=["doc_id", "item_id", *_FIGURE_NAMES])

    return source.mapInArrow(run, extended(kind, _FIGURES))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", rules: TilingRules = TilingRules()) -> DataFrame:
    """The rows that no item contaminates; columns as they came. With few items nothing is shuffled: each row is judged where it lies."""
    items = benchmark.select("item_id", "text")
    if not _few(items, rules):
        found = seed_join(docs.select(F.col(quoted(text)).alias("text")), items, rules).select("k1", "k2").distinct()
        key = _text_key(F.col(quoted(text)))
        rows = docs.select(as_struct(docs), key.getField("k1").alias("k1"), key.getField("k2").alias("k2"))
        return rows.join(found, ["k1", "k2"], "left_anti").select(*unpacked(docs.columns))
    shared = _shared_index(items, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for i, _, raw, at in B.slices(batch.column(1)):
                for d, k, covered, _ in matches(raw, at, index, rules):
                    if covered >= rules.threshold * index.words(k):
                        keep[i + d] = False
            yield batch if keep.all() else batch.filter(pa.array(keep))

    source, back = packed(docs, text, [])
    return back(source.mapInArrow(run, source.schema))
