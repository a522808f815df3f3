"""URL filter: host rules first, then gradient-boosted trees on lexical features.

Native throughout: hosts, paths, rules and features are SQL expressions, the
trees are trained by Spark's own boosting from a bounded sample of labelled
URLs, weighted back to the shares of the labels, and scored as nested CASE
expressions. The blocked shares of suffixes and sites, and of all URLs for
those without labels, are counted over all distinct labelled URLs.

The hosts are dealt to a few folds. For each fold, trees learn from the hosts of
all others, with the shares that this fold has, so that they learn what a share
tells of a host not seen yet, and every host teaches; the mean of the margins
decides. Where all hosts of a label are in one fold, no trees learn without it;
where no two folds have hosts, the trees learn from all with the shares of all.

A rule like ``net/de/`` fits the host ``net`` and all its subdomains where
the path starts with ``/de/``; the longest rule that fits decides. Few rules
are one CASE expression; more are joined by host.

Defined results: a null URL or one without ``://`` has empty host and path,
no rule, and the method's verdict on the empty URL; very long URLs are judged
whole; of rules of one length that with the longer host wins, and of equal
rules that which blocks; a URL with several labels has the largest; without
labels of both kinds the method allows; repeated rows are judged alike; an
empty table gives no row; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.storage import Scratch, quoted, without

FEATURES = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digits", "hyphens",
    "entropy", "parameters", "query_length", "longest_label", "suffix_share", "site_share",
)
MOST_CASES = 200  # rules in one expression


@dataclass(frozen=True)
class UrlRules:
    sample: int = 20_000  # labelled URLs for training for each fold, those of least hash
    folds: int = 4
    rounds: int = 10
    depth: int = 3
    step: float = 0.3
    prior_weight: float = 20.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rank(rule: tuple[str, str]) -> tuple[int, int, bool]:
    """The rule of the largest rank wins."""
    return len(rule[1]), len(rule[1].partition("/")[0]), rule[0] == "block"


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or null, as one expression. rules: (verdict, rule)."""
    out: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=_rank):
        site, _, rest = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """Adds ``__found`` as ``longest_rule`` has it, from __host and __path. rules: (verdict, rule) pairs, or a table of the two.

    A table's rules, or many, are joined with the different hosts, by every end of a host; a host's few rules are then
    joined with its URLs. Spark splits a frequent host's rows.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= MOST_CASES:
            return df.withColumn("__found", longest_rule(F.col("__host"), F.col("__path"), rules))
        rules = df.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    site = F.substring_index("rule", "/", 1)
    strength = F.struct(F.length("rule").alias("n"), F.length(site).alias("m"), (F.col("verdict") == "block").alias("block"), "rule", "verdict", F.concat(F.lit("/"), F.substring(F.col("rule"), F.length(site) + 2, F.length("rule"))).alias("rest"))
    own = rules.select(site.alias("site"), strength.alias("r"))
    labels = F.split("__host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    known = df.select("__host").distinct().select("__host", F.explode(ends).alias("site")).join(own, "site").groupBy("__host").agg(F.array_sort(F.collect_list("r")).alias("__rules"))
    fits = F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["rest"]))
    best = F.try_element_at(fits, F.lit(-1))
    found = F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))
    return df.join(known, "__host", "left").withColumn("__found", found).drop("__rules")


def _label(host: Column, k: int) -> Column:
    return F.coalesce(F.get(F.reverse(F.split(host, r"\.")), F.lit(k)), F.lit(""))


def _site(host: Column) -> Column:
    return F.concat(_label(host, 1), F.lit("."), _label(host, 0))


def _lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone, from __url, __host and __path."""
    url, host, path = F.col("__url"), F.col("__host"), F.col("__path")
    length = F.length(url).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    signs = F.array_distinct(F.split(url, ""))

    def term(c: Column) -> Column:
        p = (length - F.length(F.replace(url, c, F.lit("")))) / length
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return df.select(
        "*",
        length.alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.size(F.split(host, r"\.")).cast("double").alias("host_depth"),
        (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double").alias("path_depth"),
        F.when(length > 0, digits / length).otherwise(0.0).alias("digit_ratio"),
        F.length(F.regexp_replace(host, "[^0-9]", "")).cast("double").alias("host_digits"),
        (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.when(length > 0, F.aggregate(F.transform(F.filter(signs, lambda c: c != ""), term), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0).alias("entropy"),
        F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0).cast("double").alias("parameters"),
        F.length(query).cast("double").alias("query_length"),
        F.aggregate(F.transform(F.split(host, r"\."), F.length), F.lit(0), lambda a, x: F.greatest(a, x)).cast("double").alias("longest_label"),
        _label(host, 0).alias("__suffix"),
        _site(host).alias("__site"),
    )


def _with_shares(df: DataFrame, tables: dict[str, DataFrame], prior: float, rules: UrlRules) -> DataFrame:
    """Adds the smoothed shares of blocked URLs. Spark splits the rows of frequent values, or broadcasts small tables."""
    for column, name in (("__suffix", "suffix_share"), ("__site", "site_share")):
        share = (F.col("bad") + prior * rules.prior_weight) / (F.col("n") + rules.prior_weight)
        df = df.join(tables[column].select(column, share.alias(name)), column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(prior)))
    return df


def _of_least_hash(labelled: DataFrame, most: int, total: int) -> list:
    """(url, label) of the ``most`` URLs of least hash, of ``total``. URLs beyond a cut, which few more than those are within, go before any task sorts."""
    place = F.shiftrightunsigned(F.xxhash64("url"), 1)
    share = 1.2 * most / max(1, total)
    while True:
        near = labelled.where(place < F.lit(int(share * (1 << 63)))) if share < 1 else labelled
        found = near.orderBy(place, "url").limit(most).select("url", "label").collect()
        if len(found) >= min(most, total) or share >= 1:
            return found
        share *= 2


def _tree(node) -> Column:
    """A tree of Spark's as a CASE expression."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    left = F.col(FEATURES[split.featureIndex()]) <= float(split.threshold())
    return F.when(left, _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


@dataclass(frozen=True)
class Model:
    margin: Column | None  # over FEATURES; positive means block
    tables: dict[str, DataFrame]  # labelled and blocked URLs of each suffix and site
    prior: float
    fitted: tuple = ()  # Spark's own models, whose trees the margin has


def train(labelled: DataFrame, url: str = "url", rules: UrlRules = UrlRules()) -> Model:
    """labelled: a URL column and ``label`` (1: block). In each sample both labels get half where they have so many."""
    spark = labelled.sparkSession
    scratch = Scratch(spark, "urls")
    distinct = labelled.where(F.col(quoted(url)).isNotNull() & F.col("label").isNotNull()).groupBy(F.col(quoted(url)).alias("url")).agg(F.max("label").cast("double").alias("label"))
    distinct = scratch.put(distinct.withColumn("__fold", F.pmod(F.xxhash64(host_of(F.col("url"))), F.lit(rules.folds)).cast("int")), "labelled")
    sites = _prepared(distinct, "url").select("label", "__fold", _label(F.col("__host"), 0).alias("__suffix"), _site(F.col("__host")).alias("__site"))
    counted = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    counts = scratch.put(sites.groupBy("__suffix", "__site", "__fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")), "sites")
    tables = {c: scratch.put(counts.groupBy(c).agg(*counted), c.strip("_")) for c in ("__suffix", "__site")}
    folds = {h: (n, bad) for h, n, bad in counts.groupBy("__fold").agg(*counted).collect()}
    n, bad = (sum(x) for x in zip((0, 0.0), *folds.values(), strict=True))
    prior = bad / max(1, n)
    if not 0 < bad < n:
        return Model(None, tables, prior)
    taught = []
    for fold, (known, blocked) in sorted(folds.items()):
        if 0 < bad - blocked < n - known:
            own = counts.where(F.col("__fold") == fold)
            shares = {c: own.groupBy(c).agg(*counted) for c in ("__suffix", "__site")}
            taught.append(_fitted(distinct.where(F.col("__fold") != fold), n - known, bad - blocked, shares, blocked / known, rules))
    taught = taught or [_fitted(distinct, n, bad, tables, prior, rules)]
    scratch.drop(distinct, counts)
    margin = F.lit(0.0)
    for fitted in taught:
        for tree, weight in zip(fitted.trees, fitted.treeWeights, strict=True):
            margin = margin + float(weight) / len(taught) * _tree(tree._java_obj.rootNode())
    return Model(margin, tables, prior, tuple(taught))


def _fitted(learned: DataFrame, n: int, bad: float, shares: dict[str, DataFrame], prior: float, rules: UrlRules):
    """Spark's model of a bounded sample of the ``n`` labelled URLs, ``bad`` of which are blocked."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = learned.sparkSession
    rows = []
    for k, size in ((0.0, n - bad), (1.0, bad)):
        found = _of_least_hash(learned.where(F.col("label") == k), rules.sample // 2, int(size))
        rows += [(r[0], r[1], size / len(found)) for r in found]
    order = ("url", *FEATURES, "label", "weight")
    sample = spark.createDataFrame(rows, "url string, label double, weight double")
    known = _with_shares(_lexical(_prepared(sample, "url")), shares, prior, rules).select(*order).collect()
    known = spark.createDataFrame(sorted(known, key=lambda r: r[0]), T.StructType([T.StructField(c, T.StringType() if c == "url" else T.DoubleType()) for c in order]))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known.coalesce(2)).select("features", "label", "weight").cache()
    fitted = GBTClassifier(maxIter=rules.rounds, maxDepth=rules.depth, stepSize=rules.step, seed=7, minInstancesPerNode=5, weightCol="weight", featureSubsetStrategy="onethird").fit(table)
    table.unpersist()
    return fitted


def _prepared(df: DataFrame, url: str) -> DataFrame:
    clean = F.when(F.instr(F.col(quoted(url)), "://") > 0, F.col(quoted(url))).otherwise("")
    return df.withColumns({"__url": clean, "__host": host_of(clean), "__path": path_of(clean)})


def features_of(df: DataFrame, model: Model, url: str = "url", rules: UrlRules = UrlRules()) -> DataFrame:
    """``df`` with __url, __host, __path and FEATURES."""
    return _with_shares(_lexical(_prepared(df, url)), model.tables, model.prior, rules)


def judge(pages: DataFrame, model: Model, host_rules: Sequence[tuple[str, str]] | DataFrame, url: str = "url", rules: UrlRules = UrlRules()) -> DataFrame:
    """Adds ``host, path, rule, verdict, block_score`` to every row; columns of those names are replaced."""
    others = without(pages, ["host", "path", "rule", "verdict", "block_score"])
    packed = pages.select(F.struct(F.lit(None).alias("__none"), *(F.col(quoted(c)) for c in others)).alias("__row"), F.col(quoted(url)).alias("__raw"))
    df = features_of(packed, model, "__raw", rules)
    margin = model.margin if model.margin is not None else F.lit(-math.inf)
    df = with_rule(df, host_rules).withColumn("__margin", margin)
    return df.select(
        *(F.col(f"__row.{quoted(c)}").alias(c) for c in others),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__found.rule").alias("rule"),
        F.coalesce(F.col("__found.verdict"), F.when(F.col("__margin") > 0, "block").otherwise("allow")).alias("verdict"),
        (1 / (1 + F.exp(-2 * F.col("__margin")))).alias("block_score"),
    )
