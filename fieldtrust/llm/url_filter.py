"""URL filters: rules first, gradient-boosted trees on lexical features for the rest; DataFrame operations only.

The URLs that a rule judges are the labelled ones. The trees are fitted on a bounded sample of them
(``SAMPLE``, by hash) and judge every URL that no rule fits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import materialised, sample_by_hash, table

#: Labelled URLs that the trees are fitted on, at most, and suffixes that have statistics of their own.
SAMPLE, SUFFIXES = 20_000, 200
#: Labelled URLs' worth of the overall rate in a suffix's statistics.
PRIOR = 10
FEATURES = ("f_length", "f_host_length", "f_labels", "f_depth", "f_digits", "f_entropy", "f_parameters", "f_fragment", "f_suffix")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path. Without ``://`` (or a url) both are empty; only A to Z are lower-cased."""
    rest = F.when(F.instr("url", "://") > 0, F.substring(F.col("url"), F.instr("url", "://") + 3, F.length("url"))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        pages.withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), upper, upper.lower()))
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def ruled(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``pages`` (host, path) with rule, the longest that fits, and its verdict; of equally long ones the blocking one."""
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "block"))
    fits = [((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path) for r in order]
    found = F.coalesce(*[F.when(f, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for f, r in zip(fits, order)])
    return pages.withColumn("_found", found).withColumns({"rule": F.col("_found.rule"), "_verdict": F.col("_found.verdict")}).drop("_found")


def suffix() -> Column:
    """The last label of the host."""
    return F.substring_index("host", ".", -1)


def features(pages: DataFrame, rates: dict[str, float], overall: float) -> DataFrame:
    """``pages`` (url, host, path) with the lexical features; a null url counts as empty."""
    url = F.coalesce("url", F.lit(""))
    length = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / length
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda total, c: total - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    known = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]) if rates else F.create_map(F.lit(""), F.lit(overall))
    return pages.withColumns({
        "f_length": F.length(url), "f_host_length": F.length("host"),
        "f_labels": F.size(F.split("host", r"\.")), "f_depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
        "f_digits": F.length(F.regexp_replace(url, r"[^0-9]", "")) / length, "f_entropy": entropy,
        "f_parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "f_fragment": F.contains(url, F.lit("#")).cast("int"),
        "f_suffix": F.coalesce(F.try_element_at(known, suffix()), F.lit(overall)),
    })


class Filter(NamedTuple):
    """Trees, or the verdict of all where there is but one kind of label; the suffixes' statistics."""

    trees: GBTClassificationModel | None
    constant: str
    rates: dict[str, float]
    overall: float


def fit(labelled: DataFrame, size: int = SAMPLE) -> Filter:
    """A filter from ``labelled`` (url, host, path, _verdict); rows without a verdict are not looked at.

    At most ``size`` different urls are used, the first by their hash; each counts as often as it occurs. Without
    labels everything is allowed.
    """
    rows = labelled.where(F.col("_verdict").isNotNull()).select("url", "host", "path", (F.col("_verdict") == "block").cast("double").alias("label"))
    different = rows.groupBy("url", "host", "path", "label").agg(F.count("*").cast("double").alias("_n"))
    rows = materialised(sample_by_hash(different, size, "url"), "labelled-urls")
    counts = rows.groupBy("label").agg(F.sum("_n").alias("count")).collect()
    total, blocked = sum(r["count"] for r in counts), sum(r["count"] for r in counts if r["label"] == 1)
    overall = blocked / max(1, total)
    if len(counts) < 2:
        return Filter(None, "block" if blocked else "allow", {}, overall)
    by_suffix = rows.groupBy(suffix().alias("suffix")).agg(F.sum("_n").alias("n"), F.sum(F.col("label") * F.col("_n")).alias("blocked"))
    top = by_suffix.orderBy(F.desc("n"), "suffix").limit(SUFFIXES).collect()
    rates = {r["suffix"]: (r["blocked"] + PRIOR * overall) / (r["n"] + PRIOR) for r in top}
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(rows, rates, overall))
    trees = GBTClassifier(maxIter=10, maxDepth=4, seed=1, cacheNodeIds=False, weightCol="_n").fit(data.select("features", "label", "_n").coalesce(1))
    return Filter(trees, "", rates, overall)


def judged(pages: DataFrame, model: Filter) -> DataFrame:
    """``pages`` (url, host, path, _verdict) with verdict: the rule's, else the trees'."""
    if model.trees is None:
        return pages.withColumn("verdict", F.coalesce("_verdict", F.lit(model.constant)))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(pages, model.rates, model.overall))
    rows = model.trees.transform(rows)
    return rows.withColumn("verdict", F.coalesce("_verdict", F.when(F.col("prediction") == 1, "block").otherwise("allow")))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url); extra columns are ignored."""
    rows = ruled(parts(pages.select("page_id", "url")), rules)
    return judged(rows, fit(rows)).select("page_id", "host", "path", "rule", "verdict")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_url_filter": op7_url_filter}
