"""URL filters: allow and block rules, and logistic regression on hashed
character n-grams of host and path for the urls that no rule decides.

Everything is DataFrame expressions and Spark ML (JVM) on one scan of the
urls: no shuffle, no Python. The model is fitted on a small table of labelled
urls, at most ``FIT_URLS`` of them (those with the smallest hashes).

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged by the model; without labelled urls of both kinds
the verdict is the labelled kind, allow if there are none; repeated rows are
judged alike; an empty table gives an empty result; input columns named like a
result column give way to it.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import UPPER, col, table

#: The rules of the query (verdict, host, path), by contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labelled urls that the model is fitted on, at most.
FIT_URLS = 20_000
BUCKETS = 1 << 16
_RESULT = ["host", "path", "rule", "verdict", "block_probability"]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(column: str, mark: str) -> str:
    """SQL for the character 3- and 4-grams of ``^column$``, marked."""
    chars = f"filter(split(concat('^', {column}, '$'), ''), x -> x != '')"
    three = f"transform(sequence(0, size(c) - 3), i -> concat('{mark}', c[i], c[i + 1], c[i + 2]))"
    four = f"transform(sequence(0, size(c) - 4), i -> concat('{mark}', c[i], c[i + 1], c[i + 2], c[i + 3]))"
    empty = "cast(array() as array<string>)"
    both = f"concat(if(size(c) >= 3, {three}, {empty}), if(size(c) >= 4, {four}, {empty}))"
    # One-element arrays bind the characters once: expressions have no let.
    return f"transform(array({chars}), c -> {both})[0]"


def featurised(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with the n-grams of both."""
    return urls.withColumn("_grams", F.expr(f"concat({_grams('host', 'h')}, {_grams('path', 'p')})"))


def fit(labelled: DataFrame, rows: int = FIT_URLS, buckets: int = BUCKETS):
    """A model from (url, label 0 allow or 1 block): a Spark ML pipeline
    model, or the one known label if there are not two."""
    sample = (
        labelled.filter(F.col("url").isNotNull() & F.col("label").isNotNull())
        .groupBy("url")
        .agg(F.max("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("url"), "url")
        .limit(rows)
    )
    train = featurised(sample.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")).cache()
    kinds = [r["label"] for r in train.select("label").distinct().collect()]
    if len(kinds) < 2:
        train.unpersist()
        return kinds[0] if kinds else 0.0
    tf = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=buckets, binary=True)
    lr = LogisticRegression(
        featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
        regParam=1e-3, maxIter=40, standardization=False,
    )
    model = Pipeline(stages=[tf, lr]).fit(train)
    train.unpersist()
    return model


def judge(pages: DataFrame, model, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the model's probability."""
    names = [c for c in pages.columns if c.lower() not in _RESULT]
    plain = pages.select(
        *[col(c).alias(f"c{i}") for i, c in enumerate(names)], host_of(col(url)).alias("host"), path_of(col(url)).alias("path")
    )
    if isinstance(model, float):
        scored = plain.withColumn("p", F.lit(model))
    else:
        scored = model.transform(featurised(plain)).withColumn("p", vector_to_array("_probability")[1])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    guess = F.when(F.col("p") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, guess).alias("verdict"),
        F.col("p").alias("block_probability"),
    )


def rule_labels(urls: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """(url, label) of the urls that a rule decides."""
    _, verdict = rule_of(host_of(col(url)), path_of(col(url)), rules)
    return urls.select(col(url).alias("url"), (verdict == "block").cast("int").alias("label")).filter("label is not null")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(rule_labels(pages))).drop("url")
