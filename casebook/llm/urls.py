"""Block and allow rules for urls, extended by boosted trees on lexical features.

A rule names a host, which stands for its subdomains too, and a path prefix; the
longest rule that fits decides.  Urls that no rule fits are judged by gradient-
boosted trees trained from labelled urls: here those that a rule decides.

Features are built-in expressions over the url: lengths, depth, digit ratio,
character entropy, parameter counts, and how often labelled urls of the same
host suffix are blocked (counted over all of them).  Training reads at most
MAX_TRAINING distinct labelled urls, those with the smallest hash, each weighted
by its number of rows.

Defined cases: a url that is null or has no '://' has an empty host and path and
is judged like any other; repeated urls get one verdict; with labels of one kind
only, that is the verdict of all, and without labels 'allow'; an empty table
gives an empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import stored

MAX_TRAINING = 20_000
TREES, DEPTH, SEED = 20, 4, 7
SMOOTHING = 5.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(rules: tuple[Rule, ...] = RULES) -> Column:
    """Number of the longest rule that fits columns host and path, the first of equals; null if none."""
    found = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i].text), -i)):
        fits = ((F.col("host") == rules[i].host) | F.col("host").endswith(f".{rules[i].host}")) & F.col("path").startswith(rules[i].path)
        found = F.when(fits, i).otherwise(found)
    return found


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def entropy(text: Column) -> Column:
    """Bits per character of the text's own character frequencies."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: F.when(
        c == "", total).otherwise(total - share(c) * F.log2(share(c))))
    return F.when(size > 0, bits).otherwise(0.0)


FEATURES = [
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters",
    "fragment", "hyphens", "suffix_blocked", "suffix_seen", "domain_blocked", "domain_seen",
]


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path) with the features that need no labels, and the host's suffix and domain."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.length(url)
    labels = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(F.concat(F.array_repeat(F.lit(""), n), labels), -n, n), ".")
    return rows.withColumns({
        "url_length": size.cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "depth": _count(F.col("path"), "[^/]+"),
        "host_labels": F.size(labels).cast("double"),
        "digit_ratio": F.when(size > 0, _count(url, "[0-9]") / size).otherwise(0.0), "entropy": entropy(url),
        "parameters": _count(F.regexp_extract(url, r"\?([^#]*)", 1), "[^&;]+"),
        "fragment": url.contains("#").cast("double"), "hyphens": _count(url, "-"),
        "suffix": last(1), "domain": last(2),
    })


def suffix_statistics(labelled: DataFrame, key: str) -> DataFrame:
    """Per suffix the smoothed share of blocked labelled urls and how many there are."""
    counts = labelled.groupBy(key).agg(F.sum("label").alias("b"), F.count("*").alias("n"))
    return counts.select(
        key, ((F.col("b") + SMOOTHING / 2) / (F.col("n") + SMOOTHING)).alias(f"{key}_blocked"), F.log1p("n").alias(f"{key}_seen"))


def with_statistics(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    for key in ("suffix", "domain"):
        rows = rows.join(suffix_statistics(labelled, key), key, "left")
    return rows.fillna(0.5, ["suffix_blocked", "domain_blocked"]).fillna(0.0, ["suffix_seen", "domain_seen"])


def assemble(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def train(labelled: DataFrame, max_training: int = MAX_TRAINING) -> GBTClassificationModel | float:
    """Trees fitted on rows with url, FEATURES and label (1 block, 0 allow); a constant if there is one label only."""
    same = [c for c in labelled.columns if c in (*FEATURES, "label")]  # alike in all rows of a url
    distinct = labelled.groupBy("url").agg(F.count("*").cast("double").alias("times"), *[F.first(c).alias(c) for c in same])
    sample = distinct.orderBy(F.xxhash64("url"), "url").limit(max_training).select(*FEATURES, "label", "times")
    sample = stored(sample, "url-training")
    kinds = sorted(r["label"] for r in sample.groupBy("label").count().collect())
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, weightCol="times").fit(assemble(sample))


def predict(rows: DataFrame, model: GBTClassificationModel | float) -> DataFrame:
    """rows with `prediction` (1 block, 0 allow)."""
    return rows.withColumn("prediction", F.lit(model)) if isinstance(model, float) else model.transform(assemble(rows))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("hit", matching_rule(rules))
    seen = stored(lexical(rows), "url-features")
    blocks = F.array(*[F.lit(float(r.verdict == "block")) for r in rules])
    labelled = seen.where("hit IS NOT NULL").withColumn("label", F.element_at(blocks, F.col("hit") + 1))
    model = train(with_statistics(labelled, labelled))
    open_ = predict(with_statistics(seen.where("hit IS NULL"), labelled), model).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.when(F.col("prediction") > 0.5, "block").otherwise("allow").alias("verdict"))
    texts, verdicts = F.array(*[F.lit(r.text) for r in rules]), F.array(*[F.lit(r.verdict) for r in rules])
    ruled = seen.where("hit IS NOT NULL").select(
        "page_id", "host", "path", F.element_at(texts, F.col("hit") + 1).alias("rule"),
        F.element_at(verdicts, F.col("hit") + 1).alias("verdict"))
    return ruled.unionByName(open_)
