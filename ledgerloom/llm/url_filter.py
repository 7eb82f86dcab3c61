"""URL filter [native]: longest-match rules, then gradient-boosted trees on lexical features.

Everything on the main path is DataFrame operations and JVM-side ML: the trees are fitted by
``pyspark.ml`` on a bounded sample of labelled URLs and compiled into one Spark column
expression, so scoring stays inside whole-stage code generation.

Defined results: a null URL, or one without ``://``, has empty host and path; no rule fits an
empty host, so the trees judge it. With no labelled URLs of both classes (an empty table, say)
the score is the share of blocked labels (0 if there are none). Repeated rows are judged each.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path prefix, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
FEATURES = ["f_len", "f_host_len", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_tld_rate", "f_domain_rate"]
#: Bound of what is fitted on the driver: labelled URLs (and so at most two suffixes for each in the statistics).
MAX_TRAIN_ROWS = 20_000


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null. Ties in length go to the rule first in text order."""
    hit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
    return hit


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, the lexical features and the two suffixes whose statistics are looked up."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("host"), F.col("path")
    n = F.greatest(F.char_length(host), F.lit(1))
    share = F.transform(F.array_distinct(F.split(host, "")), lambda c: (F.char_length(host) - F.char_length(F.replace(host, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.coalesce(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), F.lit(""))
    return (
        df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
        .withColumns(
            {
                "f_len": F.char_length(u).cast("double"),
                "f_host_len": F.char_length(host).cast("double"),
                "f_depth": (F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
                "f_labels": (F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit("")))).cast("double"),
                "f_digits": (F.char_length(u) - F.char_length(F.translate(u, string.digits, ""))) / F.greatest(F.char_length(u), F.lit(1)),
                "f_entropy": entropy,
                "f_params": F.when(query == "", 0.0).otherwise((F.char_length(query) - F.char_length(F.replace(query, F.lit("&"), F.lit(""))) + 1).cast("double")),
                "f_hyphens": (F.char_length(host) - F.char_length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
                "tld": F.substring_index(host, ".", -1),
                "domain": F.substring_index(host, ".", -2),
            }
        )
    )


@dataclass
class UrlModel:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values; ``prior`` where nothing could be fitted."""

    prior: float = 0.0
    trees: list[tuple[float, object]] = field(default_factory=list)
    suffix_rates: list[tuple[str, float]] = field(default_factory=list)

    def score(self) -> Column:
        if not self.trees:
            return F.lit(self.prior)
        margin = sum((F.lit(w) * _tree_column(t) for w, t in self.trees), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _tree_column(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    i, threshold, left, right = node
    return F.when(F.col(FEATURES[i]) <= threshold, _tree_column(left)).otherwise(_tree_column(right))


def _tree_tuple(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    return (node.split().featureIndex(), float(node.split().threshold()), _tree_tuple(node.leftChild()), _tree_tuple(node.rightChild()))


def _with_rates(df: DataFrame, model: UrlModel) -> DataFrame:
    """Look up the suffix statistics: a table of at most two rows for each fitted URL, broadcast."""
    spark = df.sparkSession
    rates = spark.createDataFrame(model.suffix_rates or [("", model.prior)], "suffix string, rate double")
    for key, out in (("tld", "f_tld_rate"), ("domain", "f_domain_rate")):
        r = F.broadcast(rates.withColumnsRenamed({"suffix": f"_s_{key}", "rate": f"_r_{key}"}))
        df = df.join(r, F.col(key) == F.col(f"_s_{key}"), "left").withColumn(out, F.coalesce(F.col(f"_r_{key}"), F.lit(model.prior))).drop(f"_s_{key}", f"_r_{key}")
    return df


def _rates(sample: DataFrame, prior: float) -> list[tuple[str, float]]:
    """Each suffix with its share of blocked URLs, drawn towards the prior; at most two rows a URL of the sample."""
    by = sample.select(F.explode(F.array_distinct(F.array("tld", "domain"))).alias("s"), "label").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    return [(r.s, (r.k + 10 * prior) / (r.n + 10)) for r in by.orderBy("s").collect()]


def fit(labelled: DataFrame, url: str = "url", label: str = "label", *, max_rows: int = MAX_TRAIN_ROWS, iterations: int = 10, depth: int = 3, seed: int = 7) -> UrlModel:
    """Fit on at most ``max_rows`` distinct labelled URLs (1 = block), chosen by the hash of the URL over the whole table.

    The trees are fitted to suffix statistics of the other half of the URLs, as new URLs have no part in theirs either;
    the model keeps those of all.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = labelled.sparkSession
    rows = (
        labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).where("label is not null").distinct()
        .orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    )
    sample = with_features(rows).cache()
    try:
        n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        model = UrlModel(prior=ones / n if n else 0.0)
        if not 0 < ones < n:
            return model
        model.suffix_rates = _rates(sample, model.prior)
        half = lambda i: sample.where(F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2)) == i)
        halves = [_with_rates(half(i), UrlModel(prior=model.prior, suffix_rates=_rates(half(1 - i), model.prior))) for i in (0, 1)]
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(halves[0].unionByName(halves[1])).select("features", "label").coalesce(1)
        fitted = GBTClassifier(maxIter=iterations, maxDepth=depth, maxBins=32, seed=seed).fit(data)
        model.trees = [(float(w), _tree_tuple(t._java_obj.rootNode())) for w, t in zip(fitted.treeWeights, fitted.trees)]
        return model
    finally:
        sample.unpersist()


def judge(df: DataFrame, model: UrlModel, url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, score and verdict to ``df``: all its rows stay, and all columns but those under these five names, which are replaced."""
    own = [c for c in df.columns if c not in ("host", "path", "rule", "score", "verdict")]
    # Its own columns travel in a struct, so that none clashes with a feature.
    slim = df.select(F.struct(F.lit(None).cast("int").alias("_none"), *[F.col(f"`{c}`") for c in own]).alias("_own"), F.col(url).alias("_url"))
    out = _with_rates(with_features(slim, "_url"), model).withColumn("score", model.score())
    out = out.withColumn("_hit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_hit.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(*[F.col("_own")[c].alias(c) for c in own], "host", "path", F.col("_hit.rule").alias("rule"), "score", verdict.alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page. The labelled URLs are those that a rule decides; the trees decide the rest."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    hit = rule_of(host_of(F.col("url")), path_of(F.col("url")))
    labelled = pages.select("url", hit.alias("hit")).where("hit is not null").select("url", (F.col("hit.verdict") == "block").cast("int").alias("label"))
    model = fit(labelled)
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")
