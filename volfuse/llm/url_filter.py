"""Block and allow verdicts for URLs: listed rules first, boosted trees on lexical features for the rest.

A rule is a host and a path, such as ``net/`` or ``example.net/en/``; it fits its host and every subdomain if
the URL's path starts with the rule's, and the longest rule wins (block before allow among equals). URLs that
a rule decides are the labelled ones: gradient-boosted trees are fitted on a bounded sample of them, on
lengths, depth, digit share, character entropy, counts of parameters, labels and marks, and on statistics of the
host's suffix and domain and of the first part of the path: the share of blocked ones among the labelled URLs of
other hosts. Hosts are dealt to ``FOLDS`` folds and a row sees the labels of the other folds only, so neither its
own label nor one of its host is in its features. Every split of a tree sees a third of the features.

Null URLs and those without ``://`` have an empty host and path; no rule fits them and the trees see zeros.
Without labelled URLs of both kinds there are no trees, and what no rule decides is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volfuse.llm.staging import stage
from volfuse.llm.texts import share

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "parameters", "entropy", "fragment",
    "suffix_share", "domain_share", "section_share",
]
NAMES = ("suffix", "domain", "section")
FOLDS = 5

Rule = tuple[str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased from A to Z, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The rule that decides and its verdict; null if none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in reversed(order):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    host, path = parts(F.col("url").cast("string"))
    out = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": text, "by_rule": verdict})


def lexical(df: DataFrame) -> DataFrame:
    """Columns of lexical features; ``suffix`` and ``domain`` are the last one and two labels of the host,
    ``section`` is the first part of the path."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    letters = F.array_distinct(F.split(url, ""))
    gone = lambda pattern: F.length(url) - F.length(F.regexp_replace(url, pattern, ""))
    shares = F.transform(letters, lambda c: F.when(F.length(c) > 0, (F.length(url) - F.length(F.replace(url, c))) / size).otherwise(1.0))
    columns = {
        "length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.length("path") - F.length(F.replace("path", F.lit("/"))),
        "labels": F.length("host") - F.length(F.replace("host", F.lit("."))),
        "digits": gone("[0-9]") / size,
        "hyphens": gone("-"),
        "parameters": gone("[?&]"),
        "entropy": F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(F.greatest(p, F.lit(1e-9)))),
        "fragment": gone("#"),
    }
    named = {
        "suffix": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
        "section": F.regexp_extract("path", "^/([^/]*)/", 1),
    }
    return df.withColumns({k: c.cast("double") for k, c in columns.items()} | named)


def statistics(df: DataFrame, name: str) -> DataFrame:
    """Of each value of ``name``: for every fold, how many URLs of the other folds are labelled, and how many blocked."""
    taught, blocked = F.col("taught").isNotNull(), F.col("taught") == "block"
    others = lambda what: F.array(*(F.count_if(what & (F.col("fold") != f)) for f in range(FOLDS)))
    return df.where(taught).groupBy(name).agg(others(taught).alias("n"), others(blocked).alias("blocked"))


def with_statistics(df: DataFrame, counts: DataFrame, name: str, smooth: float = 20.0) -> DataFrame:
    """The share of blocked URLs in the other folds; one half where they have no labels, and near it for few."""
    n, blocked = (F.coalesce(F.get(c, F.col("fold")), F.lit(0)) for c in ("n", "blocked"))
    share_ = (blocked + smooth / 2) / (n + smooth)
    return df.join(counts, name, "left").withColumn(f"{name}_share", share_).drop("n", "blocked")


def judge(
    pages: DataFrame, rules: list[Rule], rows: int = 10_000, trees: int = 20, depth: int = 4, threshold: float = 0.5, learn: Column | None = None
) -> DataFrame:
    """Per page: id, host, path, the rule that fits, the verdict, and the trees' probability of a block.

    ``learn`` holds for the URLs, by their host and path, whose labels may be used; all by default.
    """
    seen = lexical(ruled(pages, rules)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    seen = seen.withColumn("taught", F.col("by_rule") if learn is None else F.when(learn, F.col("by_rule")))
    tables = {name: stage(statistics(seen, name), name) for name in NAMES}
    full = reduce(lambda df, name: with_statistics(df, tables[name], name), tables, seen)
    model = fit(full, rows, trees, depth)
    if model is None:
        scored = full.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(full).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def fit(full: DataFrame, rows: int, trees: int, depth: int) -> PipelineModel | None:
    """Boosted trees from about ``rows`` of the URLs that a rule decides at most: of the rarer label up to a half of them,
    of the other one the rest. Each counts for as many as its label has for one drawn."""
    known = full.where("taught is not null").withColumn("label", (F.col("taught") == "block").cast("double"))
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(count) < 2:
        return None
    rare, other = sorted(count, key=count.get)
    drawn = {rare: min(count[rare], max(rows // 2, rows - count[other]))}
    drawn[other] = min(count[other], rows - drawn[rare])
    rate = F.when(F.col("label") == rare, drawn[rare] / count[rare]).otherwise(drawn[other] / count[other])
    some = known.withColumn("weight", 1 / rate).where(share(F.coalesce(F.col("page_id").cast("string"), "url"), 3) < rate)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    sample = stage(some.select("label", "weight", *FEATURES), "urls")
    boosted: GBTClassificationModel = GBTClassifier(
        maxIter=trees, maxDepth=depth, seed=1, weightCol="weight", featureSubsetStrategy="onethird"
    ).fit(assembler.transform(sample))
    return PipelineModel([assembler, boosted])
