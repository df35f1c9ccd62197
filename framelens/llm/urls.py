"""Operator 3: URL filter by gradient-boosted trees on lexical features.

Rules (host and path beginnings) decide the urls they fit; those urls are the
labelled ones. The trees are boosted on a bounded, documented sample of them
(``TRAIN_ROWS``) and written as native expressions, so every other url is
scored inside the scan. Suffix statistics (share of blocked urls per host
suffix, smoothed) count all labelled urls; a labelled url's own label is left
out of its own statistic.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAIN_ROWS = 20_000
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy",
            "parameters", "hyphens", "longest_segment", "upper_ratio", "suffix_block", "tld_block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMOOTH = 20.0


def parts(url: str = "url") -> tuple[Column, Column]:
    """``(host, path)``; both empty for a null url or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character of the character distribution."""
    n = F.length(text)
    share = F.transform(F.array_distinct(F.split(text, "")),
                        lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    bits = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, F.coalesce(bits, F.lit(0.0))).otherwise(0.0)


def lexical(urls: DataFrame, rules=RULES) -> DataFrame:
    """Add host, path, rule, label (1 blocked, 0 allowed by a rule, else null) and lexical features."""
    host, path = parts()
    df = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    url, n = F.coalesce("url", F.lit("")), F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1))
    count = lambda text, what: F.length(text) - F.length(F.regexp_replace(text, what, ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    segments = F.split("path", "/")
    return (df.withColumn("rule", rule).withColumn("_verdict", verdict)
            .withColumn("label", F.when(F.col("_verdict") == "block", 1.0).when(F.col("_verdict") == "allow", 0.0))
            .withColumn("length", F.length(url).cast("double"))
            .withColumn("host_length", F.length("host").cast("double"))
            .withColumn("path_length", F.length("path").cast("double"))
            .withColumn("depth", F.size(F.filter(segments, lambda s: s != "")).cast("double"))
            .withColumn("host_labels", F.size(F.split("host", r"\.")).cast("double"))
            .withColumn("digit_ratio", count(url, "[0-9]") / n)
            .withColumn("entropy", entropy(url))
            .withColumn("parameters", F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")))
            .withColumn("hyphens", count(url, "[-_]").cast("double"))
            .withColumn("longest_segment", F.coalesce(
                F.array_max(F.transform(segments, lambda s: F.length(s))), F.lit(0)).cast("double"))
            .withColumn("upper_ratio", count(url, "[A-Z]") / n)
            .withColumn("_tld", F.substring_index("host", ".", -1))
            .withColumn("_suffix", F.substring_index("host", ".", -2)))


def with_suffix_statistics(df: DataFrame, prior: float, smooth: float = SMOOTH,
                           labelled: DataFrame | None = None) -> DataFrame:
    """Add suffix_block and tld_block: share of blocked urls of ``labelled``, smoothed, the row's own label left out."""
    labelled = df if labelled is None else labelled
    for key, out in (("_suffix", "suffix_block"), ("_tld", "tld_block")):
        stats = labelled.filter("label is not null").groupBy(key).agg(
            F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_b"))
        own = F.col("label").isNotNull().cast("int")
        df = df.join(stats, key, "left").withColumn(out, (
            F.coalesce("_b", F.lit(0.0)) - F.coalesce("label", F.lit(0.0)) + smooth * prior) / (
            F.coalesce("_n", F.lit(0)) - own + smooth)).drop("_n", "_b")
    return df


def boost(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.2,
          bins: int = 64, ridge: float = 1.0, weight: np.ndarray | None = None) -> dict:
    """Gradient-boosted trees for the logistic loss, splits at feature quantiles; rows count ``weight`` times.

    Returns the start margin and trees as nested ``(feature, cut, low, high)`` or leaf values.
    """
    weight = np.ones(len(y)) if weight is None else weight
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    place = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)]  # 0: v <= first cut
    margin, out = np.full(len(y), base), []

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[at].sum(), h[at].sum()
        value = float(-total_g / (total_h + ridge) * rate)
        best = (1e-6, None, None)
        for f, c in enumerate(cuts if left else []):
            if not len(c):
                continue
            gs = np.cumsum(np.bincount(place[f][at], g[at], len(c) + 1))[:-1]
            hs = np.cumsum(np.bincount(place[f][at], h[at], len(c) + 1))[:-1]
            gain = (gs ** 2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge)
                    - total_g ** 2 / (total_h + ridge))
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is None:
            margin[at] += value
            return value
        _, f, k = best
        low = place[f][at] <= k
        return (FEATURES[f], float(cuts[f][k]), grow(at[low], g, h, left - 1), grow(at[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(grow(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), depth))
    return {"base": base, "trees": out}


def tree_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    name, cut, low, high = tree
    return F.when(F.col(name) <= cut, tree_column(low)).otherwise(tree_column(high))


def training_urls(df: DataFrame, rules, train_rows: int) -> DataFrame:
    """At most ``train_rows`` distinct labelled urls, half of each label, drawn by hash, with their number of rows.

    Copies of a url are counted before anything is drawn, so a hot url is one
    weighted row and both kinds are always present.
    """
    counted = df.filter("label is not null").groupBy("url", "label").agg(F.count(F.lit(1)).alias("times"))
    drawn = [counted.filter(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(train_rows // 2)
             for label in (0.0, 1.0)]
    return lexical(drawn[0].unionByName(drawn[1]).select("url", "times"), rules)


def judge(urls: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS, **boosting) -> DataFrame:
    """Add host, path, rule, verdict and block_score to rows with a ``url``.

    The verdict is the rule's, else ``block`` from a score of 0.5 on. Null
    urls and urls without ``://`` have empty host and path and are scored like
    others. Without labelled urls of both kinds the score is their share of
    blocked ones (0 without any). Very long urls are measured whole; repeated
    rows are judged alike. Other columns keep their values; columns
    named like the added ones are replaced.
    """
    plain = urls.select(F.struct("*").alias("_row"), F.col("url"))
    df = lexical(plain, rules)
    counts = df.agg(F.count("label"), F.sum("label")).first()
    n, blocked = counts[0], counts[1] or 0.0
    prior = blocked / n if n else 0.0
    df = with_suffix_statistics(df, prior)
    if 0 < blocked < n:
        sample = training_urls(df, rules, train_rows)
        sample = (with_suffix_statistics(sample, prior, labelled=df)
                  .select("url", "label", "times", *FEATURES).toPandas().sort_values("url"))
        model = boost(sample[list(FEATURES)].to_numpy(np.float64), sample["label"].to_numpy(np.float64),
                      weight=sample["times"].to_numpy(np.float64), **boosting)
        margin = reduce(lambda a, b: a + b, map(tree_column, model["trees"]), F.lit(model["base"]))
        score = 1 / (1 + F.exp(-margin))
    else:
        score = F.lit(float(prior))
    df = df.withColumn("block_score", score)
    verdict = F.coalesce("_verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    added = [F.col("host"), F.col("path"), F.col("rule"), verdict.alias("verdict"), F.col("block_score")]
    names = {"host", "path", "rule", "verdict", "block_score"}
    return df.select(*[F.col(f"_row.`{c}`") for c in urls.columns if c not in names], *added)
