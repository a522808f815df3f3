"""Dumps, crawls and stored models as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark import schemas
from linkspark.functions.language import MARKUP, guess_language
from linkspark.functions.links import WIKI_PREFIX
from linkspark.operators import languages
from linkspark.sources import warc


# Fixed value: the end of each page in a dump.
PAGE_END = "\n  </page>\n"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def redirects(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.REDIRECTS)


def vocab(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.VOCAB)


def vectors(spark: SparkSession, rows) -> DataFrame:
    """(_id, embedding) from pairs in memory."""
    return spark.createDataFrame(rows, schemas.EMBEDDINGS)


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an encyclopedia XML dump: _id, pid, namespace, redirect, content (null for redirects and empty pages).

    Pages are records of text, so a dump of one file is read by many tasks; what stands outside of pages is left out.
    """
    schema = "title string, ns string, id bigint, redirect struct<_title:string>, revision struct<text:string>"
    begin = F.instr("value", "<page>")
    page = F.concat(F.substring(F.col("value"), begin, F.length("value")), F.lit("</page>"))
    records = spark.read.option("lineSep", PAGE_END).text(path).where(begin > 0)
    raw = records.select(F.from_xml(page, schema, {"rowTag": "page", "ignoreSurroundingSpaces": "false"}).alias("p")).select("p.*")
    uri = F.concat(F.lit(WIKI_PREFIX), F.translate("title", " ", "_"))
    text = F.col("revision.text")
    content = F.when(F.col("redirect._title").isNull() & (text != ""), text)
    return raw.where(F.col("title").isNotNull()).select(uri.alias("_id"), F.col("id").alias("pid"), F.col("ns").alias("namespace"), F.col("redirect._title").alias("redirect"), content.alias("content"))


def kb_lines(lines: DataFrame) -> DataFrame:
    """Raw JSON text, one item a row, of the lines of a knowledge-base dump."""
    bare = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return lines.select(bare.alias("value")).where(~F.col("value").isin("[", "]", "")).select(F.regexp_replace("value", r"[,\s]+$", "").alias("value"))


def kb_dump(spark: SparkSession, path: str) -> DataFrame:
    """Items of a knowledge-base JSON dump: id, labels, sitelinks, claims."""
    items = kb_lines(spark.read.text(path)).select(F.from_json("value", schemas.KB_ITEM).alias("i")).select("i.*")
    return items.where(F.col("id").isNotNull())


def kb_dump_variant(spark: SparkSession, path: str) -> DataFrame:
    """(_id, data): the whole items, of any shape."""
    parsed = kb_lines(spark.read.text(path)).select(F.try_parse_json("value").alias("data"))
    return parsed.select(F.try_variant_get("data", "$.id", "string").alias("_id"), "data").where("_id IS NOT NULL")


def parse_warc(record: Column) -> Column:
    """Struct (_id, content) of a crawl record whose payload is an HTTP answer 200 OK; else null."""
    gap = "\r\n\r\n"
    at = F.instr(record, gap)
    header = F.substring(record, F.lit(1), at - 1)
    payload = F.substring(record, at + len(gap), F.length(record))
    url = F.regexp_extract(header, r"(?im)^WARC-Target-URI:\s*<?([^\s>]+)", 1)
    body_at = F.instr(payload, gap)
    top = F.substring(payload, 1, 15)
    fits = (at > 0) & (url != "") & (body_at > 0) & F.startswith(top, F.lit("HTTP/")) & F.endswith(top, F.lit("200 OK"))
    body = F.regexp_replace(F.substring(payload, body_at + len(gap), F.length(payload)), r"(\r\n){2}\z", "")
    return F.when(fits, F.struct(url.alias("_id"), body.alias("content")))


def warc_crawl(spark: SparkSession, path: str, language: str | None = None, partitions: int | None = None, model: DataFrame | None = None, split_bytes: int | None = None) -> DataFrame:
    """(_id, content) of a crawl's pages, framed and decoded as in ``warc``; with ``language``, those of that language.

    The language is that of the content without its markup, by ``model`` (``languages.language_model``) or else by stop
    words. A gzip file is read by one task: pass ``split_bytes`` if its records are gzip members, and each task reads so
    many bytes, or else ``partitions`` to spread what comes out of it.
    """
    pages = warc.pages(spark, path, split_bytes)
    if partitions:
        pages = pages.repartition(partitions)
    if language is None:
        return pages
    if model is None:
        return pages.where(guess_language(F.col("content")) == language)
    shown = pages.withColumn("__shown", F.regexp_replace("content", MARKUP, " "))
    return languages.with_language(shown, model, "__shown").where(F.col("language") == language).select("_id", "content")
