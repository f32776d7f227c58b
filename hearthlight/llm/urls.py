"""URL filter: host and path rules first, boosted trees on lexical features for the rest.

The trees learn from the URLs that a rule labels. Every feature is computed with built-in
functions, and no feature names a host: they are lengths, depths, shares of digits, entropy, counts
of parameters, and how often URLs with the same last host label, or the same word at the start of
the path, were blocked (smoothed, from all labelled URLs).

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; its
verdict comes from the trees like any other. Repeated rows are judged alike. Without labelled URLs,
or with labels of one kind only, the verdict is that kind (allow if there is none). Extra columns
are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight.llm.common import hash_sample, let
from hearthlight.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
FEATURES = (
    "length", "host_length", "path_length", "depth", "host_labels", "digit_share", "entropy",
    "parameters", "hyphens", "has_fragment", "secure", "suffix_rate", "suffix_share", "head_rate",
)
#: The trees are fitted on about this many labelled URLs, those with the lowest hashes.
SAMPLE = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase
    )
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def by_rule(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the columns ``host`` and ``path``."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = F.concat(F.lit("."), F.col("host")).endswith("." + rule.host) & F.col(
            "path"
        ).startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    def of(chars: Column) -> Column:
        n = F.size(chars)
        shares = F.transform(
            F.array_distinct(chars), lambda c: (n - F.size(F.array_remove(chars, c))) / n
        )
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.length(text) > 0, let(F.split(text, ""), of)).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """The columns of the pages and their features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.length(url)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return pages.select(
        "*",
        length.cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count(F.col("path"), "/").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        F.when(length > 0, count(url, "[0-9]") / length).otherwise(0.0).alias("digit_share"),
        entropy(url).alias("entropy"),
        count(F.regexp_extract(url, r"\?([^#]*)", 1), "[^&]+").alias("parameters"),
        count(F.col("host"), "-").alias("hyphens"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(F.lower(url), F.lit("https:")).cast("double").alias("secure"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        F.regexp_extract("path", "^/([^/]*)", 1).alias("head"),
    )


def _rates(rows: DataFrame, key: str, prior: float = 20.0) -> DataFrame:
    """Share of blocked URLs by key, drawn towards one half, and share of all URLs."""
    blocked = F.coalesce(F.col("label"), F.lit(0.0))
    labelled = F.count("label")
    return rows.groupBy(key).agg(
        ((F.sum(blocked) + prior / 2) / (labelled + prior)).alias(f"{key}_rate"),
        F.count("*").alias(f"{key}_n"),
    )


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(rules)
    rows = cut_lineage(lexical(named.select("*", rule.alias("rule"), verdict.alias("ruled"))).withColumn(
        "label", F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)
    ))
    # Keys are many and uneven, so each table is aggregated first and written; Spark then chooses
    # the join from its size.
    suffixes, heads = cut_lineage(_rates(rows, "suffix")), cut_lineage(_rates(rows, "head"))
    ready = rows.join(suffixes.withColumn("suffix_share", F.log1p("suffix_n")), "suffix").join(
        heads, "head"
    )
    fitted = _fit(ready, sample)
    if isinstance(fitted, str):
        judged = ready.withColumn("by_trees", F.lit(fitted))
    else:
        judged = fitted.transform(ready).withColumn(
            "by_trees", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
        )
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "by_trees").alias("verdict")
    )


def _fit(rows: DataFrame, sample: int) -> PipelineModel | str:
    labelled = cut_lineage(
        hash_sample(rows.where(F.col("label").isNotNull()), sample, "page_id", "url")
        .select("label", *FEATURES)
    )
    kinds = sorted(r.label for r in labelled.select("label").distinct().collect())
    if len(kinds) < 2:
        return "block" if kinds == [1.0] else "allow"
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, maxBins=64, stepSize=0.2,
        seed=7, subsamplingRate=1.0,
    )
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees
    ]).fit(labelled)
