"""The driver's queries over its tables, each with its SQL where SQL can say it.

Linked documents are the web pages: ``_id`` is the URL, and anchors in the
HTML are the links. Results are flat: maps and arrays are exploded or joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import links
from linkspark.functions import language as lang
from linkspark.functions import text as X
from linkspark.operators import embeddings, entities, languages, redirects, relations, skipgram, terms
from linkspark.operators.ranking import ranked
from linkspark.plans import corpora
from linkspark.sources import members, readers, writers
from linkspark.storage import Scratch, prepare

QUERIES: dict = {}
SQL: dict[str, str] = {}

_R = links.ANCHOR.removeprefix("(?d)")
_TOK = X.TOKEN
#: links of pages as (url, i, t, a); trimmed targets; page texts
_LINKS = f"l AS (SELECT url, unnest(range(len(regexp_extract_all(html, '{_R}', 1)))) AS i, unnest(regexp_extract_all(html, '{_R}', 1)) AS t, unnest(regexp_extract_all(html, '{_R}', 2)) AS a FROM pages), k AS (SELECT *, regexp_replace(split_part(t, '#', 1), '(?s)\\A.*?://', '') AS target FROM l)"
_TEXTS = f"x AS (SELECT url, regexp_replace(html, '{_R}', '\\2', 'g') AS text FROM pages)"
_TRIM = "regexp_replace({0}, '(?s)\\A.*?://', '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def page_documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("url").alias("_id"), F.col("html").alias("content"), *more)
    return corpora.linked(pages, "content", more=more)


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text")


@query(f"WITH {_LINKS} SELECT target AS _id, count(*) AS count FROM k GROUP BY target HAVING count(*) > 1")
def entity_counts(spark, sf_dir):
    return entities.entity_counts(page_documents(spark, sf_dir))


@query(f"WITH {_LINKS}, c AS (SELECT trim(a, ' ' || chr(9) || chr(10) || chr(13)) AS _id, target, count(*) AS n FROM k WHERE trim(a, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND target <> '' GROUP BY ALL) SELECT _id, target, n, (sum(n) OVER (PARTITION BY _id))::BIGINT AS total FROM c")
def entity_name_counts(spark, sf_dir):
    return entities.entity_name_counts(page_documents(spark, sf_dir)).select("_id", F.explode("counts").alias("target", "n"), "total")


@query(
    rf"""WITH {_LINKS}, {_TEXTS},
g AS (SELECT regexp_extract_all(a, '{_TOK}') AS w FROM k),
s AS (SELECT w AS p FROM g UNION ALL SELECT [w[j] || ' ' || w[j + 1] FOR j IN range(1, len(w))] FROM g),
i AS (SELECT p[1] AS _id, 'B' AS kind FROM s WHERE len(p) > 0 UNION ALL SELECT p[len(p)], 'E' FROM s WHERE len(p) > 0 UNION ALL SELECT unnest(p[2:len(p) - 1]), 'I' FROM s WHERE len(p) > 2),
t AS (SELECT regexp_extract_all(text, '{_TOK}') AS w FROM x),
o AS (SELECT _id, count(*) AS n FROM (SELECT unnest(w) AS _id FROM t UNION ALL SELECT unnest([w[j] || ' ' || w[j + 1] FOR j IN range(1, len(w))]) FROM t) GROUP BY _id HAVING count(*) > 1),
c AS (SELECT _id, kind, count(*) AS n FROM i GROUP BY ALL)
SELECT c._id, kind, c.n FROM c JOIN o USING (_id) UNION ALL SELECT _id, 'O', n FROM o WHERE _id IN (SELECT _id FROM c)"""
)
def name_part_counts(spark, sf_dir):
    return entities.name_part_counts(page_documents(spark, sf_dir)).select("_id", F.explode("counts").alias("kind", "n"))


@query(f"WITH {_LINKS}, d AS (SELECT DISTINCT url, t, target FROM k) SELECT target AS _id, string_agg(url, ' ' ORDER BY url) AS inlinks FROM d GROUP BY target")
def entity_inlinks(spark, sf_dir):
    return entities.entity_inlinks(page_documents(spark, sf_dir)).select("_id", F.array_join("inlinks", " ").alias("inlinks"))


@query(f"WITH {_LINKS}, c AS (SELECT target AS _id, count(*) AS count FROM k GROUP BY target HAVING count(*) > 1), r AS (SELECT _id, count, row_number() OVER (ORDER BY count DESC, _id) - 1 AS rank FROM c) SELECT * FROM r WHERE rank < 10000")
def entity_vocab(spark, sf_dir):
    return entities.entity_vocab(page_documents(spark, sf_dir))


_COMENTIONS = "f AS (SELECT url, target, min(i) AS i FROM k GROUP BY ALL)"


@query(f"WITH {_LINKS}, {_COMENTIONS} SELECT url AS _id, string_agg(target, ' ' ORDER BY i) AS entities FROM f GROUP BY url")
def entity_comentions(spark, sf_dir):
    return entities.entity_comentions(page_documents(spark, sf_dir, "page_id"), "page_id").select("_id", F.array_join("entities", " ").alias("entities"))


@query(f"WITH {_LINKS}, {_COMENTIONS}, c AS (SELECT target, count(*) AS n FROM k GROUP BY target HAVING count(*) > 1), r AS (SELECT target, row_number() OVER (ORDER BY n DESC, target) - 1 AS rank FROM c) SELECT url AS _id, string_agg(rank::VARCHAR, ' ' ORDER BY i) AS entities FROM f JOIN r USING (target) WHERE rank < 10000 GROUP BY url")
def mapped_comentions(spark, sf_dir):
    docs = page_documents(spark, sf_dir, "page_id")
    out = entities.mapped_comentions(docs, entities.entity_vocab(docs), "page_id")
    return out.select("_id", F.array_join(F.col("entities").cast("array<string>"), " ").alias("entities"))


@query(
    f"""WITH x AS (SELECT url, regexp_extract_all(html, '{_R}', 1) AS t, [length(s) FOR s IN string_split_regex(html, '{_R}')] AS g, [length(s) FOR s IN regexp_extract_all(html, '{_R}', 2)] AS n FROM pages),
y AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM x), z AS (SELECT url AS _id, t[i] AS target, list_sum(g[1:i]) + coalesce(list_sum(n[1:i - 1]), 0) AS s, n[i] AS m FROM y)
SELECT _id, target, s::INT AS start, (s + m)::INT AS stop FROM z"""
)
def extract_links(spark, sf_dir):
    return page_documents(spark, sf_dir).select("_id", F.explode("links").alias("l")).select("_id", "l.*")


@query(f"SELECT page_id, split_part(url, '#', 1) AS subsection, {_TRIM.format('url')} AS protocol, {_TRIM.format("split_part(url, '#', 1)")} AS trimmed FROM pages")
def trim_links(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", X.trim_subsection(url).alias("subsection"), X.trim_protocol(url).alias("protocol"), X.trim_link(url).alias("trimmed"))


_TITLES = "'en.wikipedia.org/wiki/ ' || replace(lower(a), '-', ' ') || ' _'"


@query(f"WITH {_LINKS}, n AS (SELECT DISTINCT {_TITLES} AS link FROM k), b AS (SELECT link, trim(trim(replace(substr(link, 23), ' ', '_'), '_')) AS t FROM n) SELECT link, 'en.wikipedia.org/wiki/' || CASE WHEN t[1] = 'ß' THEN t ELSE upper(substr(t, 1, 1)) || substr(t, 2) END AS normal FROM b")
def normalise_links(spark, sf_dir):
    a = F.regexp_extract_all("html", F.lit(links.ANCHOR), F.lit(2))
    names = _table(spark, sf_dir, "pages").select(F.explode(a).alias("a"))
    link = F.concat(F.lit("en.wikipedia.org/wiki/ "), F.replace(F.lower("a"), F.lit("-"), F.lit(" ")), F.lit(" _"))
    return names.select(link.alias("link")).distinct().select("link", links.normalise_link(F.col("link")).alias("normal"))


_WORDS = f"w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS t FROM documents)"


@query(f"WITH {_WORDS} SELECT t AS _id, count(*) AS count FROM w GROUP BY t HAVING count(*) > 1")
def term_frequencies(spark, sf_dir):
    return terms.term_frequencies(text_documents(spark, sf_dir), lowercase=True)


@query(f"WITH d AS (SELECT regexp_extract_all(lower(text), '{_TOK}') AS w FROM documents) SELECT _id, count(*) AS count FROM (SELECT unnest(w) AS _id FROM d UNION ALL SELECT unnest([w[j] || ' ' || w[j + 1] FOR j IN range(1, len(w))]) FROM d) GROUP BY _id HAVING count(*) > 1")
def ngram_counts(spark, sf_dir):
    return terms.term_frequencies(text_documents(spark, sf_dir), lowercase=True, max_ngram=2)


@query(f"WITH {_WORDS} SELECT t AS _id, count(DISTINCT doc_id) AS count FROM w GROUP BY t HAVING count(DISTINCT doc_id) > 2")
def term_document_frequencies(spark, sf_dir):
    return terms.term_document_frequencies(text_documents(spark, sf_dir), lowercase=True)


@query(f"WITH {_WORDS}, c AS (SELECT t, count(DISTINCT doc_id) AS n FROM w GROUP BY t HAVING count(DISTINCT doc_id) > 5), r AS (SELECT t AS _id, n AS count, row_number() OVER (ORDER BY n DESC, t) - 1 AS rank FROM c) SELECT * FROM r WHERE rank >= 100 AND rank < 100000")
def term_vocab(spark, sf_dir):
    return terms.term_vocab(text_documents(spark, sf_dir), max_rank=100_000, lowercase=True, min_df=5)


@query(f"WITH {_WORDS}, c AS (SELECT t, count(DISTINCT doc_id) AS n FROM w GROUP BY t HAVING count(DISTINCT doc_id) > 5) SELECT t AS _id, n AS count, row_number() OVER (ORDER BY n DESC, t) - 1 AS rank FROM c")
def term_vocab_unbounded(spark, sf_dir):
    return terms.term_vocab(text_documents(spark, sf_dir), max_rank=None, min_rank=None, lowercase=True, min_df=5)


@query(f"WITH {_WORDS} SELECT t AS _id, round(ln((SELECT count(*) FROM documents) / count(DISTINCT doc_id)), 9) AS idf FROM w GROUP BY t HAVING count(DISTINCT doc_id) > 2")
def term_idfs(spark, sf_dir):
    return terms.term_idfs(text_documents(spark, sf_dir), lowercase=True).select("_id", F.round("idf", 9).alias("idf"))


@query(
    f"""WITH {_LINKS}, {_TEXTS}, w AS (SELECT url, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM x),
i AS (SELECT t, ln((SELECT count(*) FROM pages) / count(DISTINCT url)) AS idf FROM w GROUP BY t HAVING count(DISTINCT url) > 2),
c AS (SELECT target AS _id, t AS term, count(*) AS n FROM (SELECT target, unnest(regexp_extract_all(a, '{_TOK}')) AS t FROM k) GROUP BY ALL),
v AS (SELECT _id, term, sqrt(n) * idf AS v FROM c JOIN i ON term = t)
SELECT _id, term, round(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY _id)), 0), 6) AS weight FROM v"""
)
def entity_term_weights(spark, sf_dir):
    docs = page_documents(spark, sf_dir)
    each = docs.select("_id", "text", F.explode("links").alias("l"))
    anchor = F.substring(F.col("text"), F.col("l.start") + 1, F.col("l.stop") - F.col("l.start"))
    mentions = each.select(X.trim_link(F.col("l.target")).alias("_id"), F.col("_id").alias("source"), anchor.alias("text"))
    out = terms.entity_term_weights(mentions, terms.term_idfs(docs))
    return out.select("_id", F.explode("counts").alias("term", "weight")).withColumn("weight", F.round("weight", 6))


def _redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the names of link targets in order: of each four the first two lead to the one after them."""
    names = page_documents(spark, sf_dir).select(F.explode("links").alias("l")).select(F.col("l.target").alias("_id")).distinct()
    placed = ranked(names.withColumn("count", F.lit(1).cast("bigint")))
    onward = placed.select((F.col("rank") - 1).alias("rank"), F.col("_id").alias("target"))
    return placed.where("(rank + 1) % 4 IN (1, 2)").join(onward, "rank").select("_id", "target")


_REDIRECTS = f"{_LINKS}, o AS (SELECT t, row_number() OVER (ORDER BY t) AS n FROM (SELECT DISTINCT t FROM l)), r AS (SELECT p.t AS _id, q.t AS target FROM o p JOIN o q ON q.n = p.n + 1 WHERE p.n % 4 IN (1, 2))"


@query(f"WITH {_REDIRECTS} SELECT DISTINCT _id, target FROM r")
def redirects_distinct(spark, sf_dir):
    return _redirects(spark, sf_dir).distinct()


@query(f"WITH {_REDIRECTS} SELECT DISTINCT p._id, coalesce(q.target, p.target) AS target FROM r p LEFT JOIN r q ON p.target = q._id")
def redirects_transitive(spark, sf_dir):
    return redirects.resolve(_redirects(spark, sf_dir))


@query("SELECT 'c' || c_custkey AS _id, 'c' || least((c_custkey // 100 + 1) * 100, (SELECT max(c_custkey) + 1 FROM customer)) AS target FROM customer WHERE c_custkey % 100 <> 0")
def redirect_chains(spark, sf_dir):
    """Each customer redirects to the next one, but for each hundredth."""
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    key = F.col("c_custkey")
    return redirects.resolve_chains(_table(spark, sf_dir, "customer").where(key % 100 != 0).select(name(key).alias("_id"), name(key + 1).alias("target")))


@query("SELECT DISTINCT 'en.wikipedia.org/wiki/' || replace(c_name, '#', ' ') AS _id, 'en.wikipedia.org/wiki/' || 'M' || substr(trim(lower(c_mktsegment)), 2) || '_x' AS target FROM customer WHERE c_custkey % 3 = 0")
def wiki_redirects(spark, sf_dir):
    name = F.concat(F.lit("en.wikipedia.org/wiki/"), F.replace("c_name", F.lit("#"), F.lit(" ")))
    to = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" m"), F.substring(F.lower("c_mktsegment"), 2, 100), F.lit(" x_ ")))
    return redirects.wiki_redirects(_table(spark, sf_dir, "customer").select(name.alias("_id"), to.alias("redirect")))


@query(
    f"""WITH {_REDIRECTS}, f AS (SELECT _id, target FROM r WHERE hash_even(_id)), g AS (SELECT _id, target FROM r WHERE NOT hash_even(_id)),
a AS (SELECT coalesce(f.target, g._id) AS _id, g.target FROM g LEFT JOIN f ON g._id = f._id), b AS (SELECT f._id, a.target FROM f JOIN a ON f.target = a._id),
m AS (SELECT * FROM a UNION SELECT * FROM b) SELECT DISTINCT p._id, coalesce(q.target, p.target) AS target FROM m p LEFT JOIN m q ON p.target = q._id""".replace("NOT hash_even(_id)", "length(_id) % 2 = 1").replace("hash_even(_id)", "length(_id) % 2 = 0")
)
def map_redirects(spark, sf_dir):
    own = _redirects(spark, sf_dir)
    return redirects.map_redirects(own.where(F.length("_id") % 2 == 0), own.where(F.length("_id") % 2 == 1))


@query(f"WITH {_REDIRECTS} SELECT url AS _id, i::INT AS pos, coalesce(target2, t) AS target FROM (SELECT url, i, t, r.target AS target2 FROM l LEFT JOIN r ON t = r._id)")
def relink_documents(spark, sf_dir):
    out = redirects.relink(page_documents(spark, sf_dir), _redirects(spark, sf_dir))
    return out.select("_id", F.posexplode("links").alias("pos", "l")).select("_id", "pos", "l.target")


@query(
    """WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_size AS s FROM part)
SELECT 'Part ' || p.k AS _id, 'brand' AS label, b AS value FROM p
UNION ALL SELECT 'Part ' || p.k, 'next', coalesce(q.n, (p.k + 1)::VARCHAR) FROM p LEFT JOIN p q ON q.k = p.k + 1
UNION ALL SELECT 'Part ' || k, 'made', '+19' || (50 + s)::VARCHAR || '-00-00T00:00:00Z' FROM p WHERE k % 2 = 0"""
)
def kb_relations(spark, sf_dir):
    def claim(prop: str, kind: str, value, snak="value"):
        return F.concat(F.lit(f'"{prop}":[{{"mainsnak":{{"snaktype":"'), F.lit(snak) if isinstance(snak, str) else snak, F.lit(f'","datatype":"{kind}","datavalue":{{"value":'), value, F.lit("}}}]"))

    k, quote = F.col("p_partkey").cast("string"), F.lit('"')
    made = F.concat(F.lit('{"time":"+19'), (F.col("p_size") + 50).cast("string"), F.lit('-00-00T00:00:00Z"}'))
    body = F.concat(
        F.lit('{"id":"Q'), k, F.lit('","labels":{"en":{"value":"'), F.col("p_name"), F.lit('"}},"sitelinks":{"enwiki":{"title":"Part '), k, F.lit('"}},"claims":{'),
        claim("P1", "string", F.concat(quote, F.col("p_brand"), quote)), F.lit(","),
        claim("P2", "wikibase-item", F.concat(F.lit('{"numeric-id":'), (F.col("p_partkey") + 1).cast("string"), F.lit("}"))), F.lit(","),
        claim("P3", "time", made, F.when(F.col("p_partkey") % 2 == 0, "value").otherwise("novalue")), F.lit(","),
        claim("P4", "quantity", F.lit('{"amount":"1"}')), F.lit("}},"),
    )
    kinds = [(f'{{"id":"P{n}","labels":{{"en":{{"value":"{v}"}}}}}},',) for n, v in ((1, "brand"), (2, "next"), (3, "made"), (4, "amount"))]
    lines = _table(spark, sf_dir, "part").select(body.alias("value")).unionAll(spark.createDataFrame([("[",), *kinds, ("]",)], "value string"))
    dump = Scratch(spark, "kb").path("dump")
    lines.write.text(dump)
    return relations.relations(readers.kb_dump(spark, dump)).select("_id", F.explode("relations").alias("label", "value"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    crlf = "\r\n"
    status = F.when(F.col("page_id") % 5 == 0, "404 Not Found").otherwise("200 OK")
    record = F.concat(
        F.lit(f"WARC-Type: response{crlf}WARC-Target-URI: "), F.col("url"), F.lit(f"{crlf}Content-Type: application/http{crlf}{crlf}HTTP/1.1 "), status,
        F.lit(f"{crlf}Server: x{crlf}{crlf}"), F.col("html"), F.lit(crlf * 2),
    )
    return _table(spark, sf_dir, "pages").select(record.alias("value"))


_CRAWL = "SELECT url AS _id, html AS content FROM pages WHERE page_id % 5 <> 0"


@query(_CRAWL)
def warc_parse(spark, sf_dir):
    return _records(spark, sf_dir).select(readers.parse_warc(F.col("value")).alias("p")).where("p IS NOT NULL").select("p.*")


@query(_CRAWL)
def warc_files(spark, sf_dir):
    """Through files of a crawl."""
    crawl = Scratch(spark, "crawl").path("warc")
    _records(spark, sf_dir).write.option("lineSep", "WARC/1.0\r\n").option("compression", "gzip").text(crawl)
    return readers.warc_crawl(spark, crawl)


@query(
    """SELECT 'en.wikipedia.org/wiki/Doc_' || doc_id || '_x' AS _id, doc_id AS pid, CASE WHEN doc_id % 5 = 0 THEN '1' ELSE '0' END AS namespace,
CASE WHEN doc_id % 7 = 0 THEN 'Doc ' || (doc_id + 1) END AS redirect, CASE WHEN doc_id % 7 <> 0 THEN text END AS content FROM documents"""
)
def wiki_files(spark, sf_dir):
    """Through files of an encyclopedia's dump."""
    name = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    onward = F.concat(F.lit('<redirect title="Doc '), (F.col("doc_id") + 1).cast("string"), F.lit('" />'))
    shown = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shown = F.coalesce(F.replace(shown, F.lit("\r"), F.lit("&#13;")), F.lit(""))  # a parser takes a bare one for a line feed; null texts are pages without text
    page = F.concat(
        F.lit("  <page>\n    <title>"), name, F.lit(" x</title>\n    <ns>"), F.when(F.col("doc_id") % 5 == 0, "1").otherwise("0"), F.lit("</ns>\n    <id>"), F.col("doc_id").cast("string"), F.lit("</id>\n    "),
        F.when(F.col("doc_id") % 7 == 0, onward).otherwise(""), F.lit('<revision>\n      <text xml:space="preserve">'), shown, F.lit("</text>\n    </revision>\n  </page>"),
    )
    dump = Scratch(spark, "wiki").path("dump")
    _table(spark, sf_dir, "documents").select(page.alias("value")).write.text(dump)
    return readers.wiki_dump(spark, dump)


_COUNTS = f"WITH {_LINKS}, c AS (SELECT target AS _id, count(*) AS count FROM k GROUP BY target HAVING count(*) > 1)"


@query(_COUNTS + """ SELECT '{"_id":"' || _id || '","count":' || count || '}' AS value FROM c""")
def json_format(spark, sf_dir):
    return writers.json_lines(entity_counts(spark, sf_dir))


@query(_COUNTS + " SELECT _id || chr(9) || count AS value FROM c")
def tsv_format(spark, sf_dir):
    return writers.tsv_lines(entity_counts(spark, sf_dir))


@query(_COUNTS + """, b AS (SELECT 'k:' || _id AS k, '{"count":' || count || '}' AS v FROM c) SELECT array_to_string(['*3', '$3', 'SET', '$' || strlen(k), k, '$' || strlen(v), v], chr(13) || chr(10)) AS value FROM b""")
def redis_format(spark, sf_dir):
    return writers.redis_lines(entity_counts(spark, sf_dir), "k:")


@query(_COUNTS + """, b AS (SELECT 'k:' || _id AS k, count::VARCHAR AS v FROM c) SELECT array_to_string(['*3', '$3', 'SET', '$' || strlen(k), k, '$' || strlen(v), v], chr(13) || chr(10)) AS value FROM b""")
def redis_raw(spark, sf_dir):
    return writers.redis_lines(entity_counts(spark, sf_dir), "k:", "raw", "count")


# One entry, whose key "count" has five letters, and a whole number in its shortest form.
@query(
    _COUNTS
    + """, b AS (SELECT 'k:' || _id AS k, to_base64(unhex('81A5636F756E74' || CASE WHEN count < 128 THEN printf('%02X', count) WHEN count < 256 THEN printf('CC%02X', count) WHEN count < 65536 THEN printf('CD%04X', count) ELSE printf('CE%08X', count) END)) AS v FROM c)
SELECT array_to_string(['*3', '$3', 'SET', '$' || strlen(k), k, '$' || strlen(v), v], chr(13) || chr(10)) AS value FROM b"""
)
def redis_msgpack(spark, sf_dir):
    return writers.redis_lines(entity_counts(spark, sf_dir), "k:", "msgpack")


@query(f"WITH {_LINKS}, c AS (SELECT target AS _id, count(*) AS count FROM k GROUP BY target HAVING count(*) > 1) SELECT _id, count, row_number() OVER (ORDER BY count DESC, _id) - 1 AS rank FROM c")
def vocab_files(spark, sf_dir):
    """A vocabulary of all ranks, saved and loaded again."""
    saved = Scratch(spark, "vocab").path("json")
    writers.save_json(entities.entity_vocab(page_documents(spark, sf_dir), max_rank=None), saved)
    return readers.vocab(spark, saved)


@query(f"WITH {_REDIRECTS} SELECT DISTINCT _id, target FROM r")
def redirect_files(spark, sf_dir):
    saved = Scratch(spark, "redirects").path("json")
    writers.save_json(_redirects(spark, sf_dir).distinct(), saved)
    return readers.redirects(spark, saved)


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum([(x::DOUBLE) * x FOR x IN embedding])) AS n FROM embeddings) SELECT vec_id, unnest(range(len(embedding)))::INT AS place, round(unnest(embedding)::DOUBLE / n, 6) AS value FROM n WHERE n > 0")
def unit_embeddings(spark, sf_dir):
    v = embeddings.unit(F.transform("embedding", lambda x: x.cast("double")))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("place", "value")).withColumn("value", F.round("value", 6))


def linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose words of four letters and more after a comma are anchors."""
    marked = F.regexp_replace("text", r"(?<=, )(\p{L}{4,})", '<a href="en.wikipedia.org/wiki/$1#x">$1</a>')
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), marked.alias("content"))
    return corpora.linked(docs, "content")


# Sentences (_id, start, stop) of texts d (_id, text): words and the white space between them in turn. White space ends a
# sentence at its first sign if the word before it ends one and no guard holds, and all of it does if it has a line break.
_SENTENCES = r"""d AS (SELECT doc_id::VARCHAR AS _id, text FROM documents),
tk AS (SELECT _id, unnest(regexp_extract_all(text, '[^ \x09-\x0D]+|[ \x09-\x0D]+')) AS p, unnest(range(len(regexp_extract_all(text, '[^ \x09-\x0D]+|[ \x09-\x0D]+')))) AS i FROM d),
tp AS (SELECT *, (sum(length(p)) OVER (PARTITION BY _id ORDER BY i) - length(p))::BIGINT AS o, lag(p) OVER (PARTITION BY _id ORDER BY i) AS q FROM tk),
ws AS (SELECT _id, o, p, coalesce(regexp_matches(q, '[.?!]$') AND NOT (i >= 2 AND regexp_full_match(q, '[a-z]\.')) AND NOT regexp_matches(q, '\w\.\w.$') AND NOT regexp_matches(q, '[A-Z][a-z]\.$') AND NOT regexp_matches(q, '([Ii]nc|[Pp]ty|[Ll]td)\.$'), false) AS ends FROM tp WHERE regexp_matches(p, '^[ \x09-\x0D]')),
cuts AS (SELECT _id, o AS a, o + 1 AS b FROM ws WHERE ends UNION ALL SELECT _id, o + 1, o + length(p) FROM ws WHERE ends AND contains(substr(p, 2), chr(10)) UNION ALL SELECT _id, o, o + length(p) FROM ws WHERE NOT ends AND contains(p, chr(10))),
gaps AS (SELECT _id, coalesce(lag(b) OVER (PARTITION BY _id ORDER BY a), 0) AS start, a AS stop FROM cuts UNION ALL SELECT d._id, coalesce(max(b), 0), any_value(length(text)) FROM d LEFT JOIN cuts USING (_id) GROUP BY d._id),
s AS (SELECT _id, start::INT AS start, stop::INT AS stop FROM gaps WHERE start < stop)"""
# Mentions m (_id, source, text, start, stop) of the links of linked_texts.
_MENTIONS = _SENTENCES + r""",
la AS (SELECT _id, text, regexp_extract_all(text, ', (\p{L}{4,})', 1) AS w, string_split_regex(text, ', \p{L}{4,}') AS g FROM d),
lb AS (SELECT _id, text, unnest(range(len(w))) AS i, unnest(w) AS w, unnest(g[1:len(w)]) AS g FROM la),
lc AS (SELECT _id, text, w, sum(length(g) + 2 + length(w)) OVER (PARTITION BY _id ORDER BY i) AS stop FROM lb),
ld AS (SELECT _id, text, 'en.wikipedia.org/wiki/' || w AS target, (stop - length(w))::INT AS start, stop::INT AS stop FROM lc),
le AS (SELECT ld.*, f.start AS begin FROM ld ASOF JOIN s f ON ld._id = f._id AND ld.start >= f.start),
lf AS (SELECT le.*, e.stop AS fin FROM le ASOF JOIN s e ON le._id = e._id AND le.stop > e.start),
lg AS (SELECT target AS _id, _id AS source, substr(text, begin + 1, fin - begin) AS text, start - begin AS start, stop - begin AS stop FROM lf),
lh AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM lg),
m AS (SELECT _id, source, text, start, stop FROM lh WHERE NOT (start = 0 AND stop = length(text)) AND bare <> '' AND NOT starts_with(bare, '*') AND right(bare, 1) IN ('.', '!', '?', '"', chr(39)))"""


@query(f"WITH {_SENTENCES} SELECT * FROM s")
def sentences(spark, sf_dir):
    return text_documents(spark, sf_dir).select("_id", F.explode(X.sentence_spans(F.col("text"))).alias("s")).select("_id", "s.*")


@query(f"WITH {_MENTIONS} SELECT * FROM m")
def mentions(spark, sf_dir):
    return terms.entity_mentions(linked_texts(spark, sf_dir)).select("_id", "source", "text", "span.start", "span.stop")


_MENTION_TOKENS = f"t AS (SELECT *, regexp_extract_all(substr(text, 1, start), '{_TOK}') AS pre, regexp_extract_all(substr(text, start + 1, stop - start), '{_TOK}') AS mid, regexp_extract_all(substr(text, stop + 1), '{_TOK}') AS post FROM m)"


@query(
    f"""WITH {_MENTIONS}, {_MENTION_TOKENS}, n AS (SELECT row_number() OVER () AS r, *, pre || mid || post AS toks FROM t),
vw AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM documents), vc AS (SELECT t, count(DISTINCT doc_id) AS n FROM vw GROUP BY t HAVING count(DISTINCT doc_id) > 2),
v AS (SELECT t, rank FROM (SELECT t, row_number() OVER (ORDER BY n DESC, t) - 1 AS rank FROM vc) WHERE rank < 10000),
e AS (SELECT r, unnest(toks) AS t, unnest(range(len(toks))) AS i FROM n), q AS (SELECT r, string_agg(coalesce(rank, (SELECT count(*) - 1 FROM v))::VARCHAR, ' ' ORDER BY i) AS sequence FROM e LEFT JOIN v USING (t) GROUP BY r)
SELECT _id, source, sequence, len(pre)::INT AS start, (len(pre) + len(mid))::INT AS stop FROM n JOIN q USING (r)"""
)
def index_mentions(spark, sf_dir):
    vocab = terms.term_vocab(text_documents(spark, sf_dir), max_rank=10_000, min_rank=0)
    out = terms.index_mentions(terms.entity_mentions(linked_texts(spark, sf_dir)), vocab)
    return out.select("_id", "source", F.array_join(F.col("sequence").cast("array<string>"), " ").alias("sequence"), "span.start", "span.stop")


@query(
    f"""WITH {_MENTIONS}, w AS (SELECT _id, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM m),
i AS (SELECT t, ln((SELECT count(*) FROM d) / count(DISTINCT _id)) AS idf FROM (SELECT _id, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM d) GROUP BY t HAVING count(DISTINCT _id) > 2),
c AS (SELECT _id, t AS term, count(*) AS n FROM w GROUP BY ALL), v AS (SELECT _id, term, sqrt(n) * idf AS v FROM c JOIN i ON term = t)
SELECT _id, term, round(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY _id)), 0), 6) AS weight FROM v"""
)
def mention_term_weights(spark, sf_dir):
    """Weights of the terms in the sentences around links."""
    found = terms.entity_mentions(linked_texts(spark, sf_dir))
    out = terms.entity_term_weight_rows(found, terms.term_idfs(text_documents(spark, sf_dir)))
    return out.withColumn("weight", F.round("weight", 6))


# The template, the footnote and the category go; the file leaves its caption; the title, the cap and the marked words are links.
# Of the texts' own signs, cells at the start of a line and brackets without content are markup.
@query(
    r"""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, '||', chr(10) || '|'), '\n[|!](?:.*\|)?', chr(10), 'g'), ' \(\s*\)', '', 'g') AS text, len(regexp_extract_all(text, ', \p{L}{4,}')) AS n FROM documents)
SELECT 'en.wikipedia.org/wiki/Doc_' || doc_id AS _id, rtrim('Doc (A cap.) ' || regexp_replace(text, ', (\p{L}{4,})', ', "\1"', 'g') || chr(10) || 'End', ' ' || chr(10)) AS text, (n + 2)::INT AS n_links FROM x"""
)
def wiki_articles(spark, sf_dir):
    title = F.concat(F.lit("en.wikipedia.org/wiki/Doc_"), F.col("doc_id").cast("string"))
    source = F.concat(F.lit("{{Infobox|a={{b}}}}'''Doc'''<ref>r</ref> ([[File:x.png|thumb|A [[cap]]]]) "), F.regexp_replace("text", r"(?<=, )(\p{L}{4,})", "[[$1|''$1'']]"), F.lit("\n== End ==\n[[Category:Docs]]"))
    pages = _table(spark, sf_dir, "documents").select(title.alias("_id"), F.lit("0").alias("namespace"), F.lit(None).cast("string").alias("redirect"), source.alias("content"))
    return corpora.wiki_articles(pages).select("_id", "text", F.size("links").alias("n_links"))


# Blocks lie between the tags of blocks; what the pages have in their heads, bars and feet is silent. Anchors stand in bars only.
# An entity that the page cuts off before its semicolon is one.
@query(
    r"""WITH a AS (SELECT url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<!DOCTYPE[^>]*>|<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|</?(article|body|br|div|h1|html|li|p|ul)\b[^>]*>', chr(30), 'g') AS x FROM pages),
b AS (SELECT url, [regexp_replace(regexp_replace(p, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') FOR p IN string_split(x, chr(30))] AS p FROM a),
c AS (SELECT url, [regexp_replace(q, '<[^>]*>', '', 'g') FOR q IN p IF list_sum([length(trim(r, ' ' || chr(9) || chr(10) || chr(13))) FOR r IN string_split_regex(q, '<[^>]*>')]) >= 25] AS p FROM b)
SELECT url AS _id, replace(trim(array_to_string(p, chr(10)), ' ' || chr(9) || chr(10) || chr(13)), '&', '&amp;') AS text, 0 AS n_links FROM c"""
)
def web_articles(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("url").alias("_id"), F.col("html").alias("content"))
    return corpora.web_articles(pages, most_chars=None).select("_id", "text", F.size("links").alias("n_links"))


# The content ends where the article does, whatever the tree takes in before it on pages whose articles are as short as their advertisements.
@query(
    r"""WITH a AS (SELECT url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<!--.*?-->', '', 'g'), '</?(br|h1|p|div|ul|li)\b[^>]*>', chr(30), 'g') AS x FROM pages),
b AS (SELECT url, [trim(regexp_replace(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), ' ' || chr(9) || chr(10) || chr(13)) FOR p IN string_split(x, chr(30))] AS p FROM a)
SELECT url AS _id, right(replace(array_to_string([q FOR q IN p IF q <> ''], chr(10)), '&', '&amp;'), 60) AS ending, 0 AS n_links FROM b"""
)
def main_contents(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("url").alias("_id"), F.col("html").alias("content"))
    return corpora.web_articles(pages, most_chars=None, by_tree=True).select("_id", F.right("text", F.lit(60)).alias("ending"), F.size("links").alias("n_links"))


_HITS = ", ".join(f"{{'n': len([x FOR x IN w IF x IN ({', '.join(repr(x) for x in words)})]), 'code': '{code}'}}" for code, words in lang.PROFILES.items())


_GUESSES = rf"""t AS (SELECT page_id, url, html, regexp_extract_all(lower(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g')), '\p{{L}}+') AS w FROM pages),
h AS (SELECT page_id, url, html, list_reverse_sort([{_HITS}]) AS h FROM t), u AS (SELECT page_id, url, html, CASE WHEN h[1].n >= 5 AND h[1].n >= 1.2 * h[2].n THEN h[1].code END AS language FROM h)"""


@query(f"WITH {_GUESSES} SELECT url AS _id, html AS content FROM u WHERE language = 'en' AND page_id % 5 <> 0")
def warc_language(spark, sf_dir):
    """English pages of a crawl's files."""
    crawl = Scratch(spark, "crawl").path("warc")
    _records(spark, sf_dir).write.option("lineSep", "WARC/1.0\r\n").option("compression", "gzip").text(crawl)
    return readers.warc_crawl(spark, crawl, language="en")


@query(_CRAWL)
def warc_members(spark, sf_dir):
    """Through archives of gzip members, each read by as many tasks as its size asks for."""
    crlf = "\r\n"
    status = F.when(F.col("page_id") % 5 == 0, "404 Not Found").otherwise("200 OK")
    block = F.concat(F.lit("HTTP/1.1 "), status, F.lit(f"{crlf}Content-Type: text/html; charset=utf-8{crlf * 2}"), F.col("html"))
    size = F.octet_length("block").cast("string")
    record = F.concat(F.lit(f"WARC/1.0{crlf}WARC-Type: response{crlf}WARC-Target-URI: "), F.col("url"), F.lit(f"{crlf}Content-Length: "), size, F.lit(crlf * 2), F.col("block"), F.lit(crlf * 2))
    crawl = Scratch(spark, "crawl").path("members")
    members.write(_table(spark, sf_dir, "pages").withColumn("block", block).select(record.alias("value")), crawl)
    return readers.warc_crawl(spark, crawl, split_bytes=members.SPLIT_BYTES)


@query(f"WITH {_GUESSES} SELECT page_id, language FROM u")
def page_languages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", lang.guess_language(F.col("html")).alias("language"))


# Which tokens have vectors, and that these are of length one; the training itself is no matter of SQL.
@query(
    f"""WITH {_MENTIONS}, {_MENTION_TOKENS}, w AS (SELECT unnest(pre || [_id] || post) AS t FROM t)
SELECT t AS _id, 100 AS dimensions, 1.0::DOUBLE AS norm FROM w GROUP BY t HAVING count(*) >= CASE WHEN starts_with(t, 'en.wikipedia.org/wiki/') THEN 5 ELSE 20 END"""
)
def entity_embeddings(spark, sf_dir):
    found = terms.entity_mentions(linked_texts(spark, sf_dir))
    out = embeddings.entity_embeddings(found, min_word_count=20, min_entity_count=5)
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 6)
    return out.select("_id", F.size("embedding").alias("dimensions"), norm.alias("norm"))


# All trigrams of the labelled four fifths teach, if they are among their language's 5000 most frequent; ties by code points, as by UTF-8.
@query(
    r"""WITH d AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE regexp_matches(text, '\p{L}')),
g AS MATERIALIZED (SELECT doc_id, lang, substr(t, i, 3) AS g FROM (SELECT *, unnest(range(1, length(t) - 1)) AS i FROM d)),
c AS (SELECT lang, g, count(*) AS n FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL),
m AS (SELECT lang, g, n, total FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS place FROM c) WHERE place <= 5000),
v AS (SELECT g FROM m GROUP BY g), t AS (SELECT lang, any_value(total) AS total FROM m GROUP BY lang),
p AS (SELECT t.lang, v.g, ln((coalesce(m.n, 0) + 1) / (t.total + (SELECT count(*) FROM v))) AS p FROM t CROSS JOIN v LEFT JOIN m ON m.lang = t.lang AND m.g = v.g),
k AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT doc_id, p.lang, sum(k.n * p) AS score, sum(k.n) AS n FROM k JOIN p USING (g) GROUP BY ALL),
b AS (SELECT doc_id, arg_max(lang, score) AS lang, max(score) AS best, any_value(n) AS n, list(score ORDER BY score DESC)[2] AS second FROM s GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN (best - second) / b.n >= 0.1 THEN b.lang END AS language FROM documents LEFT JOIN b USING (doc_id)"""
)
def learned_languages(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languages.language_model(docs.where("doc_id % 5 <> 0"))
    return languages.with_language(docs.select("doc_id", "text"), model).select("doc_id", "language")


@query("SELECT DISTINCT 'en.wikipedia.org/wiki/Nation_' || c_nationkey AS query, 'n' || c_nationkey || letter AS _id FROM customer, (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']) AS letter)")
def embedding_neighbours(spark, sf_dir):
    """Each nation's nearest eight: the words that only its own contexts have, six of eight in turn, beside words that all share."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")

    def word(i: int):
        return F.concat(F.lit("n"), nation, F.element_at(F.array(*map(F.lit, "abcdefgh")), (F.pmod(key * 3 + i, F.lit(8)) + 1).cast("int")))

    before, after = (F.concat_ws(" ", *(word(3 * side + i) for i in range(3)), F.concat(F.lit("shared"), F.pmod(key * (side + 1), F.lit(7)).cast("string"))) for side in (0, 1))
    name = F.concat(F.lit("Nation "), nation)
    span = F.struct((F.length(before) + 1).alias("start"), (F.length(before) + 1 + F.length(name)).alias("stop"))
    contexts = _table(spark, sf_dir, "customer").select(F.concat(F.lit("en.wikipedia.org/wiki/Nation_"), nation).alias("_id"), key.cast("string").alias("source"), F.concat_ws(" ", before, name, after).alias("text"), span.alias("span"))
    vectors = Scratch(spark, "vectors").put(embeddings.entity_embeddings(contexts, min_word_count=1, min_entity_count=1, sample=0), "all")
    words, nations = vectors.where(~F.startswith("_id", F.lit("en."))), vectors.where(F.startswith("_id", F.lit("en.")))
    return skipgram.neighbours(words, nations, 8).select("query", "_id")


@query(f"WITH {_LINKS} SELECT target AS _id, url AS source FROM (SELECT DISTINCT url, t, target FROM k)")
def entity_inlink_pairs(spark, sf_dir):
    return entities.entity_inlink_pairs(page_documents(spark, sf_dir))
