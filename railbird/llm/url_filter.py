"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Rules are a short list of ``host/path`` prefixes that allow or block.  The model is trained on a
small table of labelled URLs.  Both are expressions on the URL's row: no page is shuffled.

Defined results.  The host stands behind the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z in
lower case; the path follows, up to ``?``, ``#`` or the end.  Without ``://`` (or without a URL) both are
empty.  A rule fits its host and the hosts below it, if the path starts with the rule's path;
the longest rule decides, then the longer host.  Without labelled URLs the model allows all; with
labels of one kind it gives that kind's verdict.  Rows that repeat are each judged.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railbird.session import written

#: (verdict, rule) as the query fixes them.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
GRAMS = (3, 4)
DIMENSIONS = 1 << 14
#: Labelled URLs that the query takes from the pages that rules decide.
LABELLED = 4_000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The deciding rule as a struct of rule and verdict, or null."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        chain = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def grams(host: Column, path: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """The character n-grams of ``^host$`` and of the path, told apart by a letter."""
    def cut(text: Column, mark: str, n: int) -> Column:
        last = F.greatest(F.length(text) - (n - 1), F.lit(0))
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    whole = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*[cut(text, mark, n) for text, mark in ((whole, "h"), (path, "p")) for n in sizes])


def train(labelled: DataFrame, *, dimensions: int = DIMENSIONS, iterations: int = 30, ridge: float = 0.01) -> PipelineModel | None:
    """The model of a small table (url, label: 1 to block, 0 to allow); none without rows."""
    rows = labelled.where("label is not null").select(F.col("label").cast("double").alias("label"), grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"))
    if rows.isEmpty():
        return None
    hashed = HashingTF(inputCol="grams", outputCol="x", numFeatures=dimensions, binary=True)
    model = LogisticRegression(featuresCol="x", maxIter=iterations, regParam=ridge, probabilityCol="p", rawPredictionCol="raw", predictionCol="y")
    return Pipeline(stages=[hashed, model]).fit(rows)


def judged(pages: DataFrame, model: PipelineModel | None, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (the model's) of every row."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumns({"ruling": ruled(F.col("host"), F.col("path"), rules), "grams": grams(F.col("host"), F.col("path"))})
    if model is None:
        rows = rows.withColumn("block_score", F.lit(0.0))
    else:
        # With labels of one kind the model knows one class only: that of label 0 or, beside an empty 0, of 1.
        rows = model.transform(rows).withColumn("block_score", F.coalesce(F.get(vector_to_array("p"), F.lit(1)), F.lit(0.0)))
    verdict = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("ruling.rule").alias("rule"), F.coalesce("ruling.verdict", verdict).alias("verdict"), "block_score")


def labelled_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, most: int = LABELLED) -> DataFrame:
    """A small labelled table for training, written once: different URLs that a rule decides, as many of each rule as there
    are, up to its share of ``most``, by lowest hash.

    So no rule drowns another one; Spark applies the limit before the shuffle too.
    """
    url = F.col("url")
    found = pages.select("url", ruled(host_of(url), path_of(url), rules).alias("ruling")).where("ruling is not null").select("url", "ruling.*").distinct()
    first = F.row_number().over(Window.partitionBy("rule").orderBy(F.xxhash64("url"), "url"))
    found = found.withColumn("nth", first).where(F.col("nth") <= max(1, most // max(1, len(rules))))
    return written(found.select("url", (F.col("verdict") == "block").cast("int").alias("label")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by the rules, else by a model of what the rules judge."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, train(labelled_by_rules(pages))).select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES = {"op9_url_filter": op9}
ORACLE: dict[str, str] = {}
