"""Similarity self-join on word shingles: rare-first prefix filtering.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is at least 3/4. A set is named by a 64-bit hash of its members, so
equal sets are one node from the start.

1. Document frequencies of all shingles are counted into a sketch of bounded
   size: the count of all shingles of a hash range, on a logarithmic scale.
   It orders the shingles of each set, rare ones first and then by hash. Any
   one order gives exact results; this one keeps shared passages out of the
   prefixes. Counts are added up before they are shuffled.
2. Each set sends the shingles of its prefix, with its size and their
   positions, packed by hash range. Lists with one set are dropped.
3. Stars: each list's centre is the set with the fewest prefix shingles of
   its own; each set is paired with that centre with which it shares most,
   under the length and the positional filter, and verified once. This takes
   large groups of near copies together with one pair a set.
4. The rest: within each list, sets of *different* components are paired
   under the length and the positional filter, as far as their own pair's
   prefixes reach; then the suffix filter compares how many shingles fall
   into each of 64 hash ranges; each pair left is verified once. Nothing is
   lost: a pair inside a component cannot change the components.

Postings are dealt over as many tasks as their number asks for, so a task's
memory doesn't grow with the input.

Hashes are of 64 bits: two different sets among 10**9 share a name with
probability 0.03.

Defined results: null texts and those without words have no shingles and
link with nothing, not even with each other; texts with fewer than five
words have their whole sequence as one shingle; very long texts are whole
sets like others; repeated rows get the same component; a null id never names
a component, but its text links others; of a component's ties the least id
names it; an empty table gives no row; other columns are ignored, or pass
through ``keep_one`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm import bytescan as B
from linkspark.llm.components import components
from linkspark.llm.storage import Scratch, as_struct, extended, unpacked

BINS = 64


@dataclass(frozen=True)
class JoinRules:
    sketch_bits: int = 24  # 2 ** bits counts of one byte are known to every task: 16 MB
    spread_from: int = 100_000  # lists of shingles so frequent are dealt over all tasks ...
    spread_factor: float = 8.0  # ... if they are also so many times more frequent than a count of the sketch is on average
    bucket_shingles: int = 1 << 21  # prefix shingles in one task's lists
    flush: int = 1 << 21  # hashes that a task holds
    chunk: int = 256  # members of a list that are paired as one row


def needed(a: int, b: int) -> int:
    """Least intersection of sets of sizes a and b that link."""
    return -(-3 * (a + b) // 7)


def set_name(shingles: np.ndarray) -> int:
    """Of a set with a member; as a signed 64-bit number, never 0."""
    with np.errstate(over="ignore"):
        total = B.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(B.mix(np.array([total], np.uint64)).view(np.int64)[0]) or 1


def _planes(values: np.ndarray) -> bytes:
    """Bytes of like weight together, so that the shuffle's compression sees the empty ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: memoryview, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data[: n * width], np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash range, and 32 more bits inside it."""
    return (((hashes & np.uint64(0xFFFFFF)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64), (hashes >> np.uint64(32)).astype(np.uint32)


def _key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    bucket, inside = _bucket(hashes, buckets)
    return bucket << 32 | inside


def _sets(batches: Iterator[pa.RecordBatch], column: int, once: bool) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, int]]:
    """(batch, row, shingles, name); with ``once`` each set of the task comes once, and no empty ones."""
    seen: set[int] = set()
    for batch in batches:
        for i, _, raw, at in B.slices(batch.column(column)):
            for k, shingles in enumerate(B.shingle_sets(raw, at)):
                name = set_name(shingles) if len(shingles) else 0
                if once:
                    if not name or name in seen:
                        continue
                    seen.add(name)
                yield batch, i + k, shingles, name


def named_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``__n`` (size of its set) and ``__node`` (its name, 0 if empty)."""
    schema = extended(docs.schema, "__n long, __node long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = [], []
            for _, _, shingles, name in _sets(iter([batch]), batch.schema.get_field_index(text), False):
                n.append(len(shingles))
                node.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=[*batch.schema.names, "__n", "__node"])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Sketch:
    """How frequent the shingles of each hash range are together."""

    weight: np.ndarray  # by the upper bits of the hash, one byte each
    bits: int
    total: int  # shingles of all sets

    def of(self, key: np.ndarray) -> np.ndarray:
        """Weights of keys: a function of the shingle alone."""
        return self.weight[(key & 0xFFFFFFFF) >> (32 - self.bits)]

    def spread(self, rules: JoinRules) -> int:
        """The weight from which lists are dealt over all tasks."""
        least = max(rules.spread_from, rules.spread_factor * self.total / len(self.weight))
        return int(scaled(np.array([least]))[0])


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale, eight steps for each power of two."""
    return np.minimum(8 * np.log2(1.0 + counts), 255).astype(np.uint8)


def shingle_sketch(docs: DataFrame, rules: JoinRules) -> Sketch:
    """Counted over all sets, each set once a task. Tasks send sums, never single shingles; the driver gets the sketch alone."""
    bits = rules.sketch_bits
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << bits)
    edge = [-(-(p << bits) // parts) for p in range(parts + 1)]  # of the slots of each part

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, shingles, _ in _sets(batches, 0, True):
            held.append((shingles >> np.uint64(64 - bits)).astype(np.uint32))
            size += len(shingles)
            if size >= rules.flush:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        slot, n = np.unique(np.concatenate(held), return_counts=True)
        part = (slot.astype(np.int64) * parts) >> bits
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        data = [_planes(np.diff(slot[a:b], prepend=np.uint32(0))) + _planes(n[a:b].astype(np.uint32)) for a, b in zip(cut, [*cut[1:], len(slot)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(data, pa.binary())], names=["part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(data.as_buffer())
                m = len(raw) // 8
                if part not in counts:
                    counts[part] = np.zeros(edge[part + 1] - edge[part], np.int64)
                counts[part][np.cumsum(_from_planes(raw, m, "<u4"), dtype=np.uint32) - edge[part]] += _from_planes(raw[4 * m :], m, "<u4")
        for part, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([scaled(own).tobytes()], pa.binary()), pa.array([int(own.sum())])], names=["part", "weight", "total"])

    summed = docs.select("text").mapInArrow(send, "part int, data binary").repartition(parts, "part").mapInArrow(add, "part int, weight binary, total long")
    weight, total = np.zeros(1 << bits, np.uint8), 0
    for part, own, n in summed.collect():  # as many bytes as the sketch has
        weight[edge[part] : edge[part + 1]] = np.frombuffer(own, np.uint8)
        total += n
    return Sketch(weight, bits, total)


def postings(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """(token, node, n, pos) of all prefix shingles that two sets or more have."""
    sketch = shingle_sketch(docs, rules)
    spread = sketch.spread(rules)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sketch.total // (4 * rules.bucket_shingles)))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held, size = [], 0
        for _, _, shingles, name in _sets(batches, 0, True):
            key = _key(shingles, buckets)
            weight = shared.value.of(key)
            n = len(key)
            first = np.argsort(weight, kind="stable")[: n - (3 * n + 3) // 4 + 1]
            held.append((key[first], weight[first], name, n))
            size += len(first)
            if size >= rules.flush // 4:
                yield packed(held, task)
                held, size = [], 0
        if held:
            yield packed(held, task)

    def packed(held, task: int) -> pa.RecordBatch:
        length = [len(k) for k, _, _, _ in held]
        key, weight = np.concatenate([k for k, _, _, _ in held]), np.concatenate([w for _, w, _, _ in held])
        pos = np.concatenate([np.arange(m, dtype=np.uint32) for m in length])
        owner = np.repeat(np.arange(len(held)), length)
        name, n = np.array([x for _, _, x, _ in held], np.int64), np.array([x for _, _, _, x in held], np.uint32)
        to = np.where(weight >= spread, ((key >> 32) + 1 + task) % buckets, key >> 32)
        order = np.lexsort((key, to))
        key, to, pos, owner = key[order], to[order], pos[order], owner[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1) | np.diff(key >> 32, prepend=-1))
        rows = []
        for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
            own, place = np.unique(owner[a:b], return_inverse=True)
            low = np.diff((key[a:b] & 0xFFFFFFFF).astype(np.uint32), prepend=np.uint32(0))
            head = np.array([b - a, len(own)], "<u4").tobytes()
            rows.append(head + _planes(low) + _planes(pos[a:b]) + _planes(place.astype(np.uint32)) + _planes(n[own]) + name[own].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int32)), pa.array((key[cut] >> 32).astype(np.int32)), pa.array(rows, pa.binary())], names=["to", "bucket", "data"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for bucket, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = memoryview(value.as_buffer())
                m, sets = np.frombuffer(raw[:8], "<u4").tolist()
                low, pos, place = (_from_planes(raw[8 + 4 * m * k :], m, "<u4") for k in range(3))
                rest = raw[8 + 12 * m :]
                n, name = _from_planes(rest, sets, "<u4"), np.frombuffer(rest[4 * sets :], "<i8")
                found.setdefault(bucket, []).append((np.cumsum(low, dtype=np.uint32), pos, n[place], name[place]))
        for bucket in list(found):
            low, pos, n, name = (np.concatenate(x) for x in zip(*found.pop(bucket), strict=True))
            token = low.astype(np.int64) + (bucket << 32)
            order = np.lexsort((name, token))
            token, pos, n, name = token[order], pos[order], n[order], name[order]
            fresh = np.ones(len(token), bool)  # the same set may come from several tasks
            fresh[1:] = (np.diff(token) != 0) | (np.diff(name) != 0)
            token, pos, n, name = token[fresh], pos[fresh], n[fresh], name[fresh]
            same = np.diff(token) == 0
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (shared.value.of(token) >= spread)
            at = np.flatnonzero(keep)
            for a in range(0, len(at), 1 << 16):
                k = at[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(token[k]), pa.array(name[k]), pa.array(n[k].astype(np.int32)), pa.array(pos[k].astype(np.int32))], names=["token", "node", "n", "pos"])

    sent = docs.select("text").mapInArrow(send, "to int, bucket int, data binary")
    return sent.repartition(buckets, "to").mapInArrow(match, "token long, node long, n int, pos int")


def _may_link(x: str, y: str) -> Column:
    """The length filter, and a bound by the prefix shingles that any other set has.

    Of the shared shingles those in the prefix that ends first lie in both prefixes; the others are at most the rest of that set.
    """
    size = F.expr(f"4 * least({x}n, {y}n) >= 3 * greatest({x}n, {y}n)")
    return size & F.expr(f"7 * (least({x}m, {y}m) + greatest((3 * {x}n + 3) div 4 - 1, (3 * {y}n + 3) div 4 - 1)) >= 3 * ({x}n + {y}n)")


def _positions_fit(x: str, y: str) -> Column:
    """The positional filter for a pair's first shared shingle."""
    return F.expr(f"7 * (1 + least({x}n - {x}pos - 1, {y}n - {y}pos - 1)) >= 3 * ({x}n + {y}n)")


def _met_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two lists' members that pass ``_may_link`` and ``_positions_fit``, each once a batch."""
    for batch in batches:
        sides = []
        for column in batch.columns:
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            flat = column.flatten()
            sides.append((at, *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))))
        (at1, node1, n1, m1, pos1), (at2, node2, n2, m2, pos2) = sides
        size1, size2 = np.diff(at1), np.diff(at2)
        ends = np.cumsum(size1 * size2)
        found, i = [np.zeros((0, 2), np.int64)], 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 19), "right")))
            each = (size1 * size2)[i:j]
            row = np.repeat(np.arange(i, j), each)
            k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            x, y = at1[row] + k // size2[row], at2[row] + k % size2[row]
            nx, ny = n1[x], n2[y]
            need = -(-3 * (nx + ny) // 7)
            keep = 4 * np.minimum(nx, ny) >= 3 * np.maximum(nx, ny)
            keep &= (pos1[x] <= nx - need) & (pos2[y] <= ny - need)
            keep &= np.minimum(m1[x], m2[y]) + np.maximum((3 * nx + 3) // 4, (3 * ny + 3) // 4) - 1 >= need
            at = np.flatnonzero(keep)
            a, b = node1[x[at]], node2[y[at]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            i = j
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def members_of(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, bins, members) of the sets in the pairs (a, b): the members in each hash range, and all. nodes: (node, doc_id of one such document)."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = named.join(nodes, "node").select("doc_id").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        for _, _, shingles, name in _sets(batches, 0, True):
            bins = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=BINS).astype("<u4")
            held.append((name, bins.tobytes(), shingles.tobytes()))
            if len(held) >= 256:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def batch(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        name, bins, shingles = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(bins, pa.binary()), pa.array(shingles, pa.binary())], names=["node", "bins", "members"])

    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").select("text")
    nameless = named_sets(docs.where("doc_id IS NULL").select("text")).select(F.col("__node").alias("node"), "text")  # found by their sets
    texts = texts.unionAll(nameless.join(named, "node", "left_semi").dropDuplicates(["node"]).select("text"))
    return texts.mapInArrow(sets, "node long, bins binary, members binary")  # a set may come more than once


def _compared(pairs: DataFrame, members: DataFrame, column: str, links) -> DataFrame:
    """The pairs whose sides' values of ``column`` pass ``links``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [links(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x = members.select(F.col("node").alias("a"), F.col(column).alias("x"))
    y = members.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _may_overlap(left, right) -> bool:
    u, v = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
    return int(np.minimum(u, v).sum()) >= needed(int(u.sum()), int(v.sum()))


def _overlap(left, right) -> bool:
    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y))


def suffix_filter(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Drops pairs whose members fall too differently into the hash ranges to overlap enough."""
    return _compared(pairs, members, "bins", _may_overlap)


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the exact intersection."""
    return _compared(pairs, members, "members", _overlap)


def linked_sets(docs: DataFrame, sets: DataFrame, scratch: Scratch, rules: JoinRules = JoinRules()) -> DataFrame:
    """(node, component) of all sets that link with another, stored. sets: doc_id, __n, __node, stored."""
    plain = scratch.put(postings(docs, rules), "postings")
    nodes = sets.where("__n > 0").groupBy(F.col("__node").alias("node")).agg(F.min("doc_id").alias("doc_id"))
    count = plain.groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    lists = scratch.put(plain.join(count, "node").select("token", "node", "n", "pos", "m"), "counted")
    scratch.drop(plain)

    lone = F.expr("n - (3 * n + 3) div 4 + 1 - m")  # prefix shingles that no other set has
    least = lists.groupBy("token").agg(F.min(F.struct(lone.alias("lone"), "node", "n", "pos", "m")).alias("r"))
    stars = lists.join(least, "token").where("node <> r.node").where(_may_link("", "r.") & _positions_fit("", "r."))
    shared = stars.groupBy(F.col("node").alias("a"), F.col("r.node").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    pairs = scratch.put(shared.groupBy("a").agg(F.max(F.struct("k", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "stars")
    members = scratch.put(members_of(pairs, docs, nodes), "members")
    links = scratch.put(verified(pairs, members), "links")
    first = components(links, scratch)
    scratch.drop(members, links)

    known = scratch.put(lists.join(first, "node", "left").select("token", "node", "n", "m", "pos", F.coalesce("component", "node").alias("c")), "lists")
    scratch.drop(lists)
    mixed = known.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("token", "size")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / rules.chunk))
    reach = F.expr("4 * n - 7 * pos")  # three times the size of the largest set that this member can still link with
    bounds = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(reach).alias("reach")]
    keys = ["token", "c", "chunk"]  # a long list's chunks go to different tasks
    rows = known.join(mixed, "token").withColumn("chunk", chunk).repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("node", "n", "m", "pos")).alias("m"), *bounds)
    rows = scratch.put(rows.drop("chunk"), "chunks")
    one, two = (rows.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("c", "m", "lo", "hi", "reach"))) for k in (1, 2))
    lengths = F.expr("4 * hi1 >= 3 * lo2 AND 4 * hi2 >= 3 * lo1")
    met = one.join(two, (one.token == two.token) & (F.col("c1") < F.col("c2")) & lengths & F.expr("reach1 >= 3 * lo2 AND reach2 >= 3 * lo1")).select("m1", "m2")
    rest = met.mapInArrow(_met_pairs, "a long, b long").distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.put(rest.join(done, ["a", "b"], "left_anti"), "rest")
    scratch.drop(known, rows, pairs)
    members = scratch.put(members_of(rest, docs, nodes), "members")
    near = scratch.put(suffix_filter(rest, members), "near")
    more = scratch.put(verified(near, members), "links")
    scratch.drop(rest, near, members)
    of = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(joined, scratch)
    every = first.select("node", F.col("component").alias("c")).union(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first, "node", "left_anti").select("node", F.col("node").alias("c")))
    out = every.join(second.select(F.col("node").alias("c"), F.col("component").alias("top")), "c", "left").select("node", F.coalesce("top", "c").alias("component"))
    return scratch.put(out, "linked")


def _placed(docs: DataFrame, scratch: Scratch, rules: JoinRules) -> DataFrame:
    """doc_id, __n, __node and __component (0 where the set is empty) of every row, stored."""
    sets = scratch.put(named_sets(docs.select("doc_id", "text")).drop("text"), "sets")
    linked = linked_sets(docs, sets, scratch, rules).select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    placed = scratch.put(sets.join(linked, "__node", "left").withColumn("__component", F.coalesce("__component", "__node")), "placed")
    scratch.drop(sets)
    return placed


def join_components(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable by links) of every row."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    placed = _placed(docs, scratch, rules)
    least = placed.where("__n > 0").groupBy("__component").agg(F.min("doc_id").alias("component_id"))
    least = scratch.put(least, "least")  # so that Spark can split a large component's rows
    out = placed.where("__n > 0").join(least, "__component").select("doc_id", F.col("__n").alias("n_shingles"), "component_id")
    return out.unionAll(placed.where("__n = 0").select("doc_id", F.col("__n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """One row of each component, that of the least id; rows without shingles or id all stay. Columns as they came."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    placed = _placed(docs, scratch, rules)
    best = placed.where("__n > 0 AND doc_id IS NOT NULL").groupBy("__component").agg(F.min(F.struct("doc_id", "__node")).alias("b")).select("b.*")
    best = scratch.put(best, "kept")
    scratch.drop(placed)
    named = named_sets(docs.select("text", "doc_id", as_struct(docs))).drop("text")
    alone = named.where("__n = 0 OR doc_id IS NULL").select("__row")
    kept = named.where("__n > 0").join(best, ["doc_id", "__node"], "left_semi").dropDuplicates(["doc_id", "__node"]).select("__row")
    return kept.unionAll(alone).select(*unpacked(docs.columns))
