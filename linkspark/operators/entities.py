"""Models of entities from the links of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import text as X
from linkspark.operators.ranking import ranked


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, target) of all links. Anchors are cut from the text first, so that no row has a copy of it."""
    cut = F.transform("links", lambda link: F.struct(F.substring(F.col("text"), link["start"] + 1, link["stop"] - link["start"]).alias("anchor"), link["target"].alias("target")))
    return docs.select(cut.alias("cut")).select(F.explode("cut").alias("c")).select("c.*")


def _shown(lowercase: bool) -> Column:
    shown = X.strip(F.col("anchor"))
    return F.lower(shown) if lowercase else shown


def _prefixed(df: DataFrame, column: str, prefix: str | None) -> DataFrame:
    return df.where(F.startswith(F.col(column), F.lit(prefix))) if prefix else df


def _counts_map(key: str, value: str) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))


def entity_counts(docs: DataFrame, min_count: int = 1, filter_target: str | None = None) -> DataFrame:
    """(_id, count) of link targets with more than ``min_count`` links."""
    targets = docs.select(F.explode(F.transform("links", lambda link: link["target"])).alias("target")).select(X.trim_link(F.col("target")).alias("_id"))
    return _prefixed(targets, "_id", filter_target).groupBy("_id").count().where(F.col("count") > min_count)


def entity_name_counts(docs: DataFrame, lowercase: bool = False, filter_target: str | None = None) -> DataFrame:
    """(_id: anchor text, counts by target, total)."""
    named = _anchors(docs).select(_shown(lowercase).alias("_id"), X.trim_link(F.col("target")).alias("target")).where("_id <> '' AND target <> ''")
    each = _prefixed(named, "target", filter_target).groupBy("_id", "target").count()
    return each.groupBy("_id").agg(_counts_map("target", "count").alias("counts"), F.sum("count").alias("total"))


def name_part_counts(docs: DataFrame, max_ngram: int = 2, lowercase: bool = False, most_names: int = 500_000) -> DataFrame:
    """(_id: n-gram, counts of its places): B, E, I begin, end and lie inside anchors; O is its count in all texts, above one.

    Up to ``most_names`` n-grams of anchors are sent to all tasks, which then count no others; more are joined with the counts of all.
    """
    anchors = _anchors(docs).select(X.tokens(_shown(lowercase)).alias("toks"))
    parts = []
    for n in range(1, max_ngram + 1):
        grams = X.grams_of(F.col("toks"), n, n)
        last = F.size(grams) - 1
        place = lambda g, kind: F.struct(g.alias("_id"), F.lit(kind).alias("kind"))
        parts.append(F.when(last >= 0, F.array(place(F.get(grams, F.lit(0)), "B"), place(F.get(grams, last), "E"))))
        parts.append(F.when(last >= 2, F.transform(F.slice(grams, 2, last - 1), lambda g: place(g, "I"))))
    none = F.array().cast("array<struct<_id:string,kind:string>>")
    inside = anchors.select(F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("p")).groupBy("p._id", "p.kind").count()
    grams = docs.select(F.explode(X.ngrams(F.col("text"), max_ngram)).alias("_id"))
    names = inside.select("_id").distinct()
    if names.limit(most_names + 1).count() <= most_names:
        grams = grams.join(F.broadcast(names), "_id", "left_semi")
    outside = grams.groupBy("_id").count().where("count > 1")
    known = inside.groupBy("_id").agg(F.collect_list(F.struct("kind", "count")).alias("parts"))  # three entries at most
    own = F.array(F.struct(F.lit("O").alias("kind"), F.col("count")))
    return known.join(outside, "_id").select("_id", F.map_from_entries(F.array_sort(F.concat("parts", own))).alias("counts"))


def _raw_inlinks(docs: DataFrame) -> DataFrame:
    """(_id: target, source). A source counts once for each different raw target, however many rows have its ``_id``."""
    raw = docs.select("_id", F.explode(F.array_distinct(F.transform("links", lambda link: link["target"]))).alias("target")).distinct()
    return raw.select(X.trim_link(F.col("target")).alias("_id"), F.col("_id").alias("source"))


def entity_inlinks(docs: DataFrame) -> DataFrame:
    """(_id: target, inlinks). A document counts once for each different raw target."""
    return _raw_inlinks(docs).groupBy("_id").agg(F.array_sort(F.collect_list("source")).alias("inlinks"))


def entity_inlink_pairs(docs: DataFrame) -> DataFrame:
    """(_id: target, source): ``entity_inlinks`` with a row for each source, ranged and sorted by both.

    For targets with more sources than a row can hold; a frequent target's rows go to several tasks.
    """
    return _raw_inlinks(docs).repartitionByRange("_id", "source").sortWithinPartitions("_id", "source")


def entity_vocab(docs: DataFrame, min_rank: int | None = 0, max_rank: int | None = 10_000, min_count: int = 1, filter_target: str | None = None) -> DataFrame:
    """(_id, count, rank) of targets by descending count."""
    return ranked(entity_counts(docs, min_count, filter_target), min_rank, max_rank)


def _comentions(docs: DataFrame, order: str | None) -> DataFrame:
    """(_id, entity, at): each document's different targets, and where each stands first in its links; with ``order``, also the least of its rows that hold it. Rows of one ``_id`` are one document."""
    row = [] if order is None else [F.col(order).alias("row")]
    each = docs.select("_id", *row, F.posexplode(F.transform("links", lambda link: X.trim_link(link["target"]))).alias("pos", "entity"))
    return each.groupBy("_id", "entity").agg(F.struct(F.min("pos").alias("pos"), *(F.min("row").alias("row") for _ in row)).alias("at"))


def entity_comentions(docs: DataFrame, order: str | None = None) -> DataFrame:
    """(_id, entities): the different targets of each document in order of appearance; targets at one place, of rows with one ``_id``, by the first row by ``order`` that holds them, if it is given, and by name."""
    pairs = F.array_sort(F.collect_list(F.struct("at", "entity")))
    return _comentions(docs, order).groupBy("_id").agg(F.transform(pairs, lambda p: p["entity"]).alias("entities"))


def mapped_comentions(docs: DataFrame, vocab: DataFrame, order: str | None = None) -> DataFrame:
    """Comentions as ranks of ``vocab``; unknown targets go. Spark broadcasts the vocabulary if it is small enough."""
    known = _comentions(docs, order).join(vocab.select(F.col("_id").alias("entity"), "rank"), "entity")
    pairs = F.array_sort(F.collect_list(F.struct("at", "entity", "rank")))
    return known.groupBy("_id").agg(F.transform(pairs, lambda p: p["rank"]).alias("entities"))
