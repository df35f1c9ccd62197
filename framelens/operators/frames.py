"""Topic -> frame mapping and the frame tables (year, language, contingency).

All frame tables are built from one ``framed`` DataFrame
``(doc_id, model_group, topic, frame, year, lang)``; counts are aggregated
first (partial aggregation, so a hot frame or year costs nothing extra) and
zero cells are filled on the aggregated table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import CODEBOOK


def frame_names(topic_info: DataFrame, annotation: DataFrame) -> DataFrame:
    """``(model_group, topic, frame)``: annotated label, else the automatic name.

    An annotation with a ``model_group`` column (split strategy) labels the
    topics of that group alone; without one it labels the topic ids of all.
    """
    keys = ["model_group", "topic"] if "model_group" in annotation.columns else ["topic"]
    ann = annotation.withColumnRenamed("topic_id", "topic").select(
        *keys, F.trim("frame_label").alias("frame_label"))
    return (topic_info.join(ann, keys, "left")
                      .select("model_group", "topic",
                              F.coalesce("frame_label", "name").alias("frame")))


def framed(docs: DataFrame, names: DataFrame, drop_outliers: bool = True) -> DataFrame:
    """Attach the frame to each document by key (never by row position).

    Topics without a name (unknown to the model) get no frame and vanish.
    """
    d = docs.filter(F.col("topic") != -1) if drop_outliers else docs
    return d.join(F.broadcast(names), ["model_group", "topic"])        # one row per topic


def complete_counts(df: DataFrame, row: str, col: str, value: str = "n") -> DataFrame:
    """Long ``(row, col, n)`` counts with absent cells as 0 (null keys dropped).

    Every row value is exploded over the sorted column labels (a scalar
    subquery on the counts), so labels are only ever values, never column names.
    """
    clean = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    counts = clean.groupBy(row, col).agg(F.count(F.lit(1)).alias(value))
    labels = counts.select(F.sort_array(F.collect_set(col))).scalar()
    grid = counts.select(row).distinct().select(row, F.explode(labels).alias(col))
    return (grid.join(counts, [row, col], "left")
                .select(row, col, F.coalesce(value, F.lit(0)).alias(value)))


def frames_over_time(framed_docs: DataFrame) -> DataFrame:
    """Year x frame counts and shares (each year's shares sum to 1)."""
    counts = complete_counts(framed_docs, "year", "frame")
    return counts.withColumn(
        "share", F.col("n") / F.sum("n").over(Window.partitionBy("year")))


def compare_lang(framed_docs: DataFrame) -> DataFrame:
    """Frame share within each language (outliers are always dropped upstream)."""
    counts = complete_counts(framed_docs, "lang", "frame")
    return counts.withColumn(
        "share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))


def frame_contingency(framed_docs: DataFrame) -> DataFrame:
    """Language x frame counts, zero-completed, null language or frame not counted."""
    return complete_counts(framed_docs, "lang", "frame")


def expected_counts(contingency: DataFrame) -> DataFrame:
    """Row total x column total / n for every cell."""
    return (contingency
            .withColumn("row_total", F.sum("n").over(Window.partitionBy("lang")))
            .withColumn("col_total", F.sum("n").over(Window.partitionBy("frame")))
            .withColumn("total", F.sum("n").over(Window.partitionBy()))
            .withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("total")))


def annotation_gaps(annotation: DataFrame, topic_info: DataFrame,
                    codebook=CODEBOOK) -> DataFrame:
    """Labels outside the codebook, and topics with no annotation."""
    spark = annotation.sparkSession
    book = spark.createDataFrame([(c,) for c in codebook], "frame_label string")
    ann = annotation.select("topic_id", F.trim("frame_label").alias("frame_label"))
    off_book = (ann.join(book, "frame_label", "left_anti")
                   .select(F.lit("label_not_in_codebook").alias("kind"),
                           F.col("topic_id").alias("topic"), "frame_label"))
    unannotated = (topic_info.select("topic").distinct()
                   .join(ann.withColumnRenamed("topic_id", "topic"), "topic", "left_anti")
                   .select(F.lit("topic_without_label").alias("kind"), "topic",
                           F.lit(None).cast("string").alias("frame_label")))
    return off_book.unionByName(unannotated)


def annotation_template(summary: DataFrame) -> DataFrame:
    """Rows to hand-label: every topic of every group but -1, a blank ``frame_label`` column."""
    return (summary.filter(F.col("topic_id") != -1)
                   .select("model_group", "topic_id", F.lit(None).cast("string").alias("frame_label"),
                           "keywords", "count"))
