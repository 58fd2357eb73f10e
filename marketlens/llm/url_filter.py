"""URL filter: rules for hosts and paths, and gradient-boosted trees on lexical features for the rest.

The rules label the URLs they fit. The trees learn from those, by length, depth, digits, entropy,
parameters and statistics of the host's suffix and the first folder over all pages, and judge the
URLs that no rule fits.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.storage import broadcast_if_small, written

ALLOW, BLOCK = "allow", "block"
#: Different labelled URLs that the trees are fitted to: the first in a seeded order.
SAMPLE = 10_000


class Rule(NamedTuple):
    """Fits ``host`` and all its subdomains if the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", ALLOW),
    Rule("example.org", "/es/", BLOCK),
    Rule("example.org", "/en/1", BLOCK),
    Rule("com", "/fr/", ALLOW),
    Rule("com", "/de/", BLOCK),
)

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "digit_run", "entropy", "parameters",
    "query_length", "hyphens", "fragment", "secure", "segment_length", "suffix_share", "suffix_blocked", "folder_share", "folder_blocked",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and for URLs without ``://``."""
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def first_fit(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, its verdict) by the columns host and path: the longest that fits; of equally long ones that with the longest host."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):  # the last that fits counts
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character of the distribution of the characters."""
    n = F.length(text).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    positive = F.filter(shares, lambda p: p > 0)
    return F.when(n > 0, F.aggregate(positive, F.lit(0.0), lambda total, p: total - p * F.log2(p))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, anything else) with the features that need no other URL, the suffix and the first folder."""
    url = F.coalesce("url", F.lit(""))
    length = F.length(url).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = length - F.length(F.regexp_replace(url, "[0-9]", ""))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    count = F.size(segments)
    labels = F.split("host", r"\.")
    return urls.select(
        "*",
        length.alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count.cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        F.when(length > 0, digits / length).otherwise(0.0).alias("digit_ratio"),
        F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit("([0-9]+)")), F.length)), F.lit(0)).cast("double").alias("digit_run"),
        entropy(url).alias("entropy"),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double").alias("parameters"),
        F.length(query).cast("double").alias("query_length"),
        (length - F.length(F.translate(url, "-_", ""))).alias("hyphens"),
        url.contains("#").cast("double").alias("fragment"),
        url.startswith("https").cast("double").alias("secure"),
        F.coalesce(F.length(F.try_element_at(segments, F.lit(-1))), F.lit(0)).cast("double").alias("segment_length"),
        F.element_at(labels, -1).alias("suffix"),
        F.coalesce(F.get(segments, F.lit(0)), F.lit("")).alias("folder"),
    )


def with_statistics(urls: DataFrame, counts: DataFrame, key: str, total: int, rate: float) -> DataFrame:
    """``urls`` with the share of all pages that have its suffix or folder, and the smoothed rate of blocked ones among those labelled.

    ``counts``: suffix, folder, n, labelled and hits.
    """
    stats = counts.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "hits"))).select(
        F.col(key), (F.col("n") / max(total, 1)).alias("share"), ((F.col("hits") + rate) / (F.col("labelled") + 1)).alias("rate")
    )
    joined = urls.join(broadcast_if_small(written(stats, "url-statistics")), key, "left")
    return joined.withColumns({f"{key}_share": F.coalesce("share", F.lit(0.0)), f"{key}_blocked": F.coalesce("rate", F.lit(rate))}).drop("share", "rate")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, rounds: int = 12, depth: int = 4, seed: int = 11) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url, anything else).

    rule is null where none fits; score is the trees' probability that the URL is to be blocked.
    Null and empty URLs, and those without ``://``, have empty hosts and paths, fit no rule and are
    judged like others. If the rules label URLs of one kind only, that verdict goes to all others,
    with score 0 or 1; if they label none, all are allowed. Repeated rows each get a row. Suffixes
    and folders are counted over all rows; the trees are fitted to the first ``sample`` different
    labelled URLs by a seeded hash, and if these are of one kind, to as many of the other.
    """
    host, path = host_and_path(F.col("url"))
    name, verdict = first_fit(rules)
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = urls.select("*", name.alias("rule"), verdict.alias("ruled"))
    order = F.xxhash64("url", F.lit(seed))
    label = (F.col("ruled") == BLOCK).cast("double")
    counts = lexical(urls).groupBy("suffix", "folder").agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0.0)).alias("hits"))
    counts = written(counts, "url-counts")
    pages_in_all, total, blocked = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "labelled", "hits"))).first()
    if not total or blocked in (0, total):
        only = BLOCK if blocked else ALLOW
        scored = urls.select("*", F.lit(1.0 if blocked else 0.0).alias("score"), F.lit(only).alias("guess"))
    else:
        rate = blocked / total

        def prepared(rows: DataFrame) -> DataFrame:
            return with_statistics(with_statistics(rows, counts, "suffix", pages_in_all, rate), counts, "folder", pages_in_all, rate)

        labelled = urls.where("rule is not null").select("url", "host", "path", label.alias("label")).distinct()
        learn = written(lexical(labelled.orderBy(order, "url").limit(sample)), "url-sample")
        kinds = [r["label"] for r in learn.select("label").distinct().collect()]
        if len(kinds) == 1:
            learn = learn.union(written(lexical(labelled.where(F.col("label") != kinds[0]).orderBy(order, "url").limit(sample)), "url-sample"))
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        # a bounded sample in one ordered partition: the same trees in every run
        rows = assembler.transform(prepared(learn)).select("features", "label", "url").coalesce(1).sortWithinPartitions(order, "url")
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed).fit(written(rows, "url-features").coalesce(1))
        out = trees.transform(assembler.transform(prepared(lexical(urls))))
        score = F.element_at(vector_to_array("probability"), 2)
        scored = out.select(*urls.columns, score.alias("score"), F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW).alias("guess"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", "guess").alias("verdict"), "score")
