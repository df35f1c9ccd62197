"""Corpus operators: cleaning, stub filter, first-wins dedup, dating, counts.

Order matters and is kept exactly: clean -> compose -> stub filter -> url
dedup -> text dedup -> language -> date drop.

"First" always means the smallest value of an order column (the input
sequence). Dedup is written as an aggregation, ``min(struct(order, ...))``
per key, instead of a window: the partial aggregation reduces a hot key (say
a url that holds a third of the rows) to one row per map task before the
shuffle, so no single task receives the hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, compose_text, parse_date
from ..params import DEFAULT, Params

ARTICLE_COLUMNS = ["id", "title", "body", "text", "date", "year", "source", "domain",
                   "lang", "url"]


def clean_articles(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Clean body and title, then compose ``text``.

    The cleaned values are produced by a one-element ``inline`` (a Generate
    node): the optimizer does not inline generator output into later
    filters and projections, so the regex cleaning runs once per row even
    though the stub filter, ``text`` and the dedup digest all read it.
    """
    others = [c for c in raw.columns if c not in ("body", "title")]
    cleaned = F.struct(clean_text("body", params.boilerplate).alias("body"),
                       clean_text(F.coalesce(F.col("title"), F.lit("")),
                                  params.boilerplate).alias("title"))
    out = raw.select(*others, F.inline(F.array(cleaned)))
    return (out.withColumn("text", compose_text("title", "body"))
               .select(*raw.columns, "text"))


def drop_stubs(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Keep rows whose (cleaned) body has at least ``min_chars`` characters."""
    return df.filter(F.length(F.coalesce(F.col("body"), F.lit(""))) >= params.min_chars)


def first_per_key(df: DataFrame, key: Column | str, order: str = "doc_id") -> DataFrame:
    """Keep the first row (smallest ``order``) of every key value.

    Nulls form one key, as in a pandas ``drop_duplicates``. Skew-safe: a
    partial ``min`` runs before the shuffle.
    """
    key = F.col(key) if isinstance(key, str) else key
    cols = df.columns
    rest = [c for c in cols if c != order]
    packed = F.struct(F.col(order), *[F.col(c) for c in rest]).alias("_row")
    return (df.select(key.alias("_key"), packed)
              .groupBy("_key").agg(F.min("_row").alias("_row"))
              .select(*[F.col("_row." + c).alias(c) for c in cols]))


def dedup_articles(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """Drop later duplicates by url, then by text.

    Only ``(order, url, digest of the text)`` is aggregated; the survivors'
    order values (unique per row) then select the whole rows once.
    """
    narrow = df.select(order, "url", F.sha2(F.col("text"), 256).alias("_digest"))
    by_url = narrow.groupBy("url").agg(F.min(F.struct(order, "_digest")).alias("_f"))
    kept = by_url.groupBy("_f._digest").agg(F.min(f"_f.{order}").alias(order)).select(order)
    return df.join(kept, order, "left_semi").select(*df.columns)


def tag_language(df: DataFrame, detected: DataFrame | None = None,
                 order: str = "doc_id", params: Params = DEFAULT) -> DataFrame:
    """Accepted detected language, else the row's hint (``lang``).

    ``detected`` is ``(order, lang_detected)``; without it the hint is kept.
    """
    if detected is None:
        return df
    accepted = F.col("lang_detected").isin(*params.accepted_languages)
    return (df.join(detected.select(order, "lang_detected"), order, "left")
              .withColumn("lang", F.when(accepted, F.col("lang_detected"))
                          .otherwise(F.col("lang")))
              .drop("lang_detected"))


def date_year(df: DataFrame) -> DataFrame:
    """Parse ``date`` (``yyyy-MM-dd`` only), drop undated rows, add ``year``."""
    return (df.withColumn("date", parse_date("date"))
              .filter(F.col("date").isNotNull())
              .withColumn("year", F.year("date").cast("int")))


def preprocess(raw: DataFrame, detected: DataFrame | None = None, order: str = "doc_id",
               params: Params = DEFAULT) -> DataFrame:
    """clean -> compose -> stubs -> url dedup -> text dedup -> language -> date."""
    return (raw.transform(lambda d: clean_articles(d, params))
               .transform(lambda d: drop_stubs(d, params))
               .transform(lambda d: dedup_articles(d, order))
               .transform(lambda d: tag_language(d, detected, order, params))
               .transform(date_year))


def ensure_not_empty(df: DataFrame) -> DataFrame:
    """An empty corpus is an error (one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError("No articles found; run collection first.")
    return df


def attrition(raw: DataFrame, order: str = "doc_id", params: Params = DEFAULT) -> DataFrame:
    """Rows kept and dropped per reason: one scan, then aggregates of narrow columns.

    Reasons in pipeline order: stub, duplicate_url, duplicate_text, undated,
    kept; a reason without rows is absent.
    """
    narrow = clean_articles(raw, params).select(
        order, "url", F.sha2(F.col("text"), 256).alias("digest"),
        (F.length("body") >= params.min_chars).alias("long_enough"),
        parse_date("date").isNotNull().alias("dated"))
    long_row = F.when(F.col("long_enough"), F.struct(order, "digest", "dated"))
    per_url = narrow.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.count(long_row).alias("n_long"),
                                        F.min(long_row).alias("first"))
    per_text = per_url.groupBy("first.digest").agg(
        F.sum(F.col("n") - F.col("n_long")).alias("stub"),
        F.sum(F.greatest(F.col("n_long") - 1, F.lit(0))).alias("duplicate_url"),
        F.count("first").alias("n_first"),
        F.min(F.when(F.col("first").isNotNull(), F.struct(f"first.{order}", "first.dated"))).alias("kept"))
    one = lambda cond: F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0))
    totals = per_text.agg(
        F.coalesce(F.sum("stub"), F.lit(0)).alias("stub"),
        F.coalesce(F.sum("duplicate_url"), F.lit(0)).alias("duplicate_url"),
        F.coalesce(F.sum(F.greatest(F.col("n_first") - 1, F.lit(0))), F.lit(0)).alias("duplicate_text"),
        one(F.col("kept").isNotNull() & ~F.col("kept.dated")).alias("undated"),
        one(F.col("kept").isNotNull() & F.col("kept.dated")).alias("kept"))
    return totals.unpivot([], totals.columns, "reason", "n").filter(F.col("n") > 0)


def volume_counts(articles: DataFrame) -> DataFrame:
    """Articles per language, per year and per year x source (grouping sets)."""
    return (articles.groupingSets([["lang"], ["year"], ["year", "source"]],
                                  "lang", "year", "source")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.grouping_id("lang", "year", "source").cast("int").alias("gid")))


def corpus_split_counts(articles: DataFrame, languages=("en", "fr")) -> DataFrame:
    """Row count of the ``all`` corpus and of each split-out language."""
    per = (articles.rollup("lang").agg(F.count(F.lit(1)).alias("n"),
                                       F.grouping("lang").alias("g")))
    return (per.filter((F.col("g") == 1) | F.col("lang").isin(*languages))
               .select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("lang"))
                       .alias("split"), "n"))


def write_corpus(articles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Corpus sink split by language: one Parquet dataset, partitioned by lang.

    A sub-corpus is a partition-pruned read: ``read.parquet(path).filter(lang='en')``.
    """
    articles.write.mode(mode).partitionBy("lang").parquet(path)
