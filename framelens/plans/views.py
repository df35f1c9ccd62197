"""Study-shaped views over the driver tables (definitions in FIXTURES.md).

Each view is a plain projection of a given table, so its size grows with the
table; nothing here is collected or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import url_host
from ..params import FRAME_ANNOTATION

# Test outlets of the fixture (ord, name, domain, default language). The last
# one overlaps the first and the third, so the order decides.
FIXTURE_OUTLETS = (
    (0, "Outlet A", "tionsh.example.net", "en"),
    (1, "Outlet B", "thther.example.org", "fr"),
    (2, "Outlet C", "ththan.example.net", "en"),
    (3, "Outlet D", "tiontion.example.com", "fr"),
    (4, "Other net", "example.net", "en"),
)


def table(spark: SparkSession, d: str, name: str, key: str | None = None) -> DataFrame:
    """Scan a table; spread it when the scan gives fewer tasks than cores.

    A cluster-sized table already splits into many scan tasks and is left
    alone; a small single-row-group file (tests, the bench) is hash-spread
    on its key so the text-heavy stages that follow use every core.
    """
    df = spark.read.parquet(f"{d}/{name}.parquet")
    if key is None:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Raw article records with stubs, duplicate urls/texts, null bodies, bad dates."""
    doc = table(spark, d, "documents", "doc_id")
    doc_id = F.col("doc_id")
    nl = F.instr(F.col("text"), "\n")
    return doc.select(
        doc_id,
        F.concat(F.lit("https://www.news.example/"),
                 F.when(doc_id % 10 == 1, doc_id - 1).otherwise(doc_id).cast("string")
                 ).alias("url"),
        F.col("source"),
        F.concat(F.col("source"), F.lit(".example")).alias("domain"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.when(doc_id % 20 == 0, F.lit(None).cast("string"))
         .when(nl > 0, F.expr("substr(text, instr(text, char(10)) + 1)"))
         .otherwise(F.col("text")).alias("body"),
        F.when((doc_id % 50).isin(7, 10), F.lit("bad"))
         .otherwise(F.date_format(
             F.date_add(F.lit("2017-01-01").cast("date"), ((doc_id * 37) % 3400).cast("int")),
             "yyyy-MM-dd")).alias("date"),
        F.col("lang"),
        (doc_id % 22 - 1).cast("int").alias("topic"),
    )


def frame_annotation(spark: SparkSession) -> DataFrame:
    """The delivered annotation as a 22-row dimension (topic_id, frame_label)."""
    return spark.createDataFrame(list(FRAME_ANNOTATION), "topic_id int, frame_label string")


def outlets(spark: SparkSession, rows=FIXTURE_OUTLETS) -> DataFrame:
    return spark.createDataFrame(list(rows), "ord int, name string, domain string, lang string")


def media_export(spark: SparkSession, d: str, keep_html: bool = False) -> DataFrame:
    """Metadata export shaped rows built from ``pages`` (no body)."""
    p = table(spark, d, "pages", "page_id")
    extra = [F.col("html")] if keep_html else []
    return p.select(
        F.col("page_id").cast("string").alias("id"),
        F.lit(None).cast("string").alias("indexed_date"),
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
         .alias("language"),
        url_host("url").alias("media_name"),
        F.lit(None).cast("string").alias("media_url"),
        F.date_format(F.date_add(F.lit("2017-01-01").cast("date"),
                                 ((F.col("page_id") * 13) % 3400).cast("int")),
                      "yyyy-MM-dd").alias("publish_date"),
        F.lit(None).cast("string").alias("title"),
        F.col("url"),
        *extra,
    )


def snapshot_index(spark: SparkSession, d: str) -> DataFrame:
    """Three archive snapshots per page around its publish date."""
    p = table(spark, d, "pages", "page_id")
    base = F.date_add(F.lit("2017-01-01").cast("date"), ((F.col("page_id") * 13) % 3400).cast("int"))
    k = F.col("k")
    return (
        p.select("page_id", "url", "html", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
        .select(
            "url",
            F.concat(F.date_format(F.date_add(base, ((k - 1) * 90 + F.col("page_id") % 30).cast("int")),
                                   "yyyyMMdd"), F.lit("000000")).alias("stamp"),
            ((F.col("page_id") + k) % 4 != 0).alias("available"),
            "html",
        )
    )
