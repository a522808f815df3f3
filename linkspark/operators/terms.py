"""Models of terms and of the contexts of links."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark import schemas
from linkspark.functions import text as X
from linkspark.operators import grams
from linkspark.operators.lookup import Lookup
from linkspark.operators.ranking import ranked
from linkspark.storage import Scratch

# Fixed value: how a whole sentence ends.
SENTENCE_ENDS = frozenset(".!?\"'")


def term_frequencies(docs: DataFrame, lowercase: bool = False, max_ngram: int = 1) -> DataFrame:
    """(_id, count) of n-grams that occur more than once."""
    return grams.counts(docs, F.lower("text") if lowercase else F.col("text"), max_ngram, more_than=1)


def term_document_frequencies(docs: DataFrame, lowercase: bool = False, max_ngram: int = 1, min_df: int = 2) -> DataFrame:
    """(_id, count) of n-grams in more than ``min_df`` documents."""
    return grams.counts(docs, F.lower("text") if lowercase else F.col("text"), max_ngram, more_than=min_df, once=True)


def term_vocab(docs: DataFrame, max_rank: int | None, min_rank: int | None = 100, lowercase: bool = False, max_ngram: int = 1, min_df: int = 2) -> DataFrame:
    """(_id, count, rank) of n-grams by descending document frequency; ranks keep their place when ``min_rank`` cuts."""
    return ranked(term_document_frequencies(docs, lowercase, max_ngram, min_df), min_rank, max_rank)


def term_idfs(docs: DataFrame, lowercase: bool = False, max_ngram: int = 1, min_df: int = 2) -> DataFrame:
    """(_id, idf): ln of all documents over those with the term."""
    total = docs.agg(F.count(F.lit(1)).alias("__total"))  # one row
    frequencies = term_document_frequencies(docs, lowercase, max_ngram, min_df)
    return frequencies.join(F.broadcast(total)).select("_id", F.ln(F.col("__total") / F.col("count")).alias("idf"))


def entity_mentions(docs: DataFrame, sentence_window: int = 1, lowercase: bool = False, normalize_url: bool = True, strict_sentences: bool = True) -> DataFrame:
    """(_id: target, source, text: the sentences around the link, span inside it).

    One Arrow pass makes the rows: sentences are found once a document, and no link's row holds the document.
    """
    left = sentence_window // 2
    right = sentence_window - left - 1
    schema = "_id string, source string, text string, start int, stop int"

    names = ["_id", "source", "text", "start", "stop"]

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        """The mentions of some documents. Lists of links are read flat, as there are many to a document."""
        links = part.column(2)
        flat = links.flatten()
        starts, stops = (flat.field(k).to_pylist() for k in (1, 2))
        kept: list[int] = []
        documents: list[int] = []
        contexts: list[str] = []
        begins: list[int] = []
        at = 0
        for d, (text, n) in enumerate(zip(part.column(1).to_pylist(), links.value_lengths().fill_null(0).to_pylist(), strict=True)):
            heads, tails = X.sentence_places(text)
            seen: dict[tuple[int, int], str | None] = {}  # sentences of several links are cut and judged once
            for k in range(at, at + n) if heads else ():
                first = max(bisect_right(heads, starts[k]) - 1, 0)
                last = max(bisect_left(heads, stops[k]) - 1, first)
                begin, end = place = heads[max(first - left, 0)], tails[min(last + right, len(tails) - 1)]
                if starts[k] == begin and stops[k] == end:
                    continue
                if place not in seen:
                    context = text[begin:end]
                    bare = context.strip()
                    seen[place] = context if not strict_sentences or bare and not bare.startswith("*") and bare[-1] in SENTENCE_ENDS else None
                if (context := seen[place]) is not None:
                    kept.append(k)
                    documents.append(d)
                    contexts.append(context)
                    begins.append(begin)
            at += n
        own, shift = flat.take(pa.array(kept, pa.int64())), pa.array(begins, pa.int32())
        columns = [own.field(0), part.column(0).take(pa.array(documents, pa.int64())), pa.array(contexts, pa.string()), pc.subtract(own.field(1), shift), pc.subtract(own.field(2), shift)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = rows(batch.slice(at, 256))
                if len(found):
                    yield found

    each = docs.select("_id", "text", "links").mapInArrow(run, schema)  # not filtered before, as Spark would find the links once more for that
    target = X.trim_link(F.col("_id")) if normalize_url else F.col("_id")
    text = F.lower("text") if lowercase else F.col("text")
    return each.select(target.alias("_id"), "source", text.alias("text"), F.struct("start", "stop").alias("span"))


def _ranks_of(tokens: pa.ListArray, lookup: Lookup, ranks: np.ndarray, unknown: int) -> pa.ListArray:
    place = lookup.find(tokens.flatten())
    found = np.append(ranks, unknown)[place]  # place -1 is the last
    ends = np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(found))


def index_mentions(mentions: DataFrame, vocab: DataFrame, oov: int | str = "last", most_broadcast: int = 1_000_000) -> DataFrame:
    """(_id, source, sequence of vocabulary ranks, span in tokens). Unknown tokens get ``oov``; "last": the vocabulary's size less one.

    The parts before, inside and after the link are tokenised apart. A term that the vocabulary repeats has its least
    rank. A vocabulary of up to ``most_broadcast`` terms is sent to all tasks, which look tokens up without a shuffle.
    A larger one is joined with the different tokens of each mention; Spark splits the rows of a frequent token.
    """
    vocab = vocab.groupBy("_id").agg(F.min("rank").alias("rank"))
    cut = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    start, stop = F.col("span.start"), F.col("span.stop")
    pre, mid = X.tokens(cut(F.lit(0), start)), X.tokens(cut(start, stop))
    toks = mentions.select("_id", "source", pre.alias("pre"), mid.alias("mid"), X.tokens(F.substring(F.col("text"), stop + 1, 1 << 30)).alias("post"))
    span = F.struct(F.size("pre").alias("start"), (F.size("pre") + F.size("mid")).alias("stop")).alias("span")
    toks = toks.select("_id", "source", F.concat("pre", "mid", "post").alias("toks"), span)
    entries = vocab.select("_id", "rank").limit(most_broadcast + 1).toArrow()
    if entries.num_rows <= most_broadcast:
        unknown = entries.num_rows - 1 if oov == "last" else int(oov)
        shared = mentions.sparkSession.sparkContext.broadcast((Lookup(entries.column(0)), entries.column(1).to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ranks_of(batch.column(2), *shared.value, unknown), batch.column(3)], names=["_id", "source", "sequence", "span"])

        return toks.mapInArrow(run, schemas.INDEXED_MENTIONS)
    unknown = F.lit(vocab.count() - 1 if oov == "last" else int(oov)).cast("bigint")
    rows = Scratch(mentions.sparkSession, "mentions").put(toks.withColumn("row", F.monotonically_increasing_id()), "tokens")
    each = rows.select("row", F.explode(F.array_distinct("toks")).alias("token")).join(vocab.select(F.col("_id").alias("token"), "rank"), "token")
    known = each.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("token", "rank"))).alias("known"))
    sequence = F.transform("toks", lambda t: F.coalesce(F.try_element_at("known", t), unknown))
    return rows.join(known, "row", "left").select("_id", "source", sequence.alias("sequence"), "span")


def entity_term_weight_rows(mentions: DataFrame, idfs: DataFrame, max_ngram: int = 1, normalize: bool = True) -> DataFrame:
    """(_id: entity, term, weight: sqrt(count) * idf, scaled to unit length over the entity). A row for each, so entities may have any number of terms.

    Terms without idf go; the weights of a zero vector are null. The length is a sum that tasks make in parts, joined back.
    """
    scratch = Scratch(mentions.sparkSession, "weights")
    counts = mentions.select("_id", F.explode(X.ngrams(F.col("text"), max_ngram)).alias("term")).groupBy("_id", "term").count()
    weighted = counts.join(idfs.select(F.col("_id").alias("term"), "idf"), "term").select("_id", "term", (F.sqrt("count") * F.col("idf")).alias("weight"))
    if not normalize:
        return weighted
    weighted = scratch.put(weighted, "weighted")
    lengths = weighted.groupBy("_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("__length"))
    return weighted.join(lengths, "_id").select("_id", "term", F.try_divide("weight", "__length").alias("weight"))


def entity_term_weights(mentions: DataFrame, idfs: DataFrame, max_ngram: int = 1, normalize: bool = True) -> DataFrame:
    """(_id: entity, counts: term to weight) of ``entity_term_weight_rows``."""
    rows = entity_term_weight_rows(mentions, idfs, max_ngram, normalize)
    return rows.groupBy("_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "weight")))).alias("counts"))
