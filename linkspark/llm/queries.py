"""The queries of this folder, each over its whole table with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import decontaminate, fill_middle, langid, ngram_join, packing, quality, secrets, sharding, storage, token_binary, toxicity, url_filter, warc_index, whitening
from linkspark.llm.sampling import fold
from linkspark.llm.storage import Scratch, prepare

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words of hosts, between dots and hyphens, by which URLs are labelled as unwanted for training: of gambling, drugs, adult content, spam, advertising and fraud.
URL_SEEDS = (
    "bet", "bets", "betting", "casino", "gambling", "jackpot", "lottery", "poker", "slots",
    "pharma", "pharmacy", "pill", "pills", "viagra",
    "adult", "escort", "porn", "sex", "xxx",
    "spam", "spammer", "spammers",
    "ad", "ads", "adserver", "adtrack", "banner", "banners", "click", "clicks", "popup", "track", "tracker", "trackers", "tracking",
    "malware", "phish", "phishing", "scam", "virus", "warez",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return storage.table(prepare(spark), sf_dir, name)


def url_labels(pages: DataFrame) -> DataFrame:
    """(url, label) of pages: 1 where a word of the host is one of ``URL_SEEDS``. No table labels URLs; whoever has labels passes them to the filter."""
    words = F.split(url_filter.host_of(F.col("url")), "[.-]")
    return pages.select("url", F.arrays_overlap(words, F.array(*map(F.lit, URL_SEEDS))).cast("int").alias("label"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.line_quality(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = Scratch(spark, "token-files").path("all")
    token_binary.write_tokens(docs, tokenizer_file("byte_bpe_50k.json"), out)
    return token_binary.read_tokens(spark, out)


def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "toxic_spans", "n_toxic_tokens")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_labels(pages))
    return url_filter.judge(pages, model, URL_RULES).drop("url")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train_model(docs)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    return whitening.components(whitening.whiten(vectors, model).drop("embedding"), model)


def op12_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "archives").path("all")
    warc_index.write_archives(table(spark, sf_dir, "pages"), out)
    index = warc_index.capture_index(warc_index.captures(spark, out))
    return index.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url_key", "timestamp", "position")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_quality, op2_token_binary, op3_toxicity_crf, op4_url_filter, op5_secret_scan, op6_string_tiling, op7_hilbert_shards, op8_ngram_join, op9_language_codes, op10_cost_packing, op11_jacobi_whitening, op12_warc_index, op13_fill_middle)}


# Lines and words as the contract has them; the rules are those of quality.LineRules. DuckDB's \\s is ASCII only.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^ \x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, hash(list_slice(w, i, i + 7)::VARCHAR) AS h, list_slice(w, i, i + 7)::VARCHAR AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM p) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
l AS (SELECT *, len(regexp_extract_all(line, '[^ \x09-\x0D]+')) AS n, regexp_replace(line, '[ \x09-\x0D]+', '', 'g') AS dense, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM l0),
j AS (SELECT r, n, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup,
  (len(regexp_extract_all(line, '[|]')) >= 2 AND 5 * len(regexp_extract_all(line, '[|]')) >= n)
  OR 5 * len(regexp_extract_all(line, '[#*$%&|<>]')) > length(dense)
  OR (len(regexp_extract_all(line, '!')) > 0 AND 2 * len(regexp_extract_all(line, '!')) >= n)
  OR (NOT regexp_matches(dense, '[.!?:;"'')\]…”’»。！？]$') AND n < 8)
  OR (regexp_matches(low, 'all rights reserved|licensed under|released under|terms of use|terms of service|privacy policy|cookie|subscribe|click here|sign up|log in|read more|share this|javascript') AND n <= 30) AS failed
  FROM l WHERE n > 0),
q AS (SELECT r, sum(dup::BIGINT)::BIGINT AS n_dup_lines, sum(CASE WHEN failed THEN n ELSE 0 END)::BIGINT AS lost FROM j GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost
  FROM w LEFT JOIN q USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - lost) >= 50 * n_words AS kept, (n_words - lost)::BIGINT AS n_kept_words FROM f
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.b, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) c USING (doc_id)
"""


# Base32 of a SHA-1: of each five hexadecimal digits four letters. Labels of hosts are put in reverse by their number.
OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, regexp_replace(regexp_replace(coalesce(url, ''), '(?s)#.*\z', ''), '(?s)\A[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id, [('0x' || substr(h, 5 * k + 1, 5))::INT FOR k IN range(8)] AS w, string_split(lower(regexp_extract(bare, '\A[^/?]*')), '.') AS labels, length(regexp_extract(bare, '\A[^/?]*')) AS host_length FROM p),
i AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(labels), ',') || ')' || substr(bare, host_length + 1) END AS url_key,
  strftime(make_timestamp((1577836800 + page_id % 1000000000) * 1000000), '%Y%m%d%H%M%S') AS timestamp FROM f)
SELECT *, row_number() OVER (ORDER BY url_key, timestamp, page_id::VARCHAR) - 1 AS position FROM i
"""

# Units are matched here, where the operator splits between them.
OP13_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \x09-\x0D]*[^ \x09-\x0D]+|[ \x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, text, u, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM u),
c AS (SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM h),
p AS (SELECT doc_id, text, len(u)::BIGINT AS n, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, len(u)), '') AS suf,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_quality": OP1_SQL, "op8_ngram_join": OP8_SQL, "op12_warc_index": OP12_SQL, "op13_fill_middle": OP13_SQL}
