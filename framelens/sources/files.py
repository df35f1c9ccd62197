"""Sources and sinks: export CSV, raw JSON Lines, annotation CSV, Parquet tables.

Every reader takes an explicit schema (no inference); malformed JSON lines
are kept apart in a quarantine column instead of failing or vanishing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import ANNOTATION, EXPORT, MISSING, RAW


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Metadata export (CSV with header; quoted fields may span lines), columns taken by name.

    A column that the header lacks is null.
    """
    raw = (spark.read.option("header", True).option("multiLine", True)
                .option("quote", '"').option("escape", '"').csv(path))
    schema = EXPORT if not isinstance(EXPORT, str) else StructType.fromDDL(EXPORT)
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in schema.fields])


def read_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw corpus (JSON Lines): (records, quarantined malformed lines).

    Blank lines are skipped; a line that is no JSON object lands in the quarantine frame
    (column ``line``) rather than failing the job or vanishing silently.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    ok = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    good = lines.filter(ok).select(F.from_json("value", RAW).alias("r")).select("r.*")
    bad = lines.filter(~ok).select(F.col("value").alias("line"))
    return good, bad


def read_known_urls(spark: SparkSession, path: str) -> DataFrame:
    """Set of urls already collected; malformed lines and lines without url ignored."""
    good, _ = read_raw(spark, path)
    return good.filter(F.col("url").isNotNull()).select("url").distinct()


def append_records(records: DataFrame, path: str, fmt: str = "json") -> None:
    """Append sink: a re-run adds new files and keeps what exists."""
    records.write.mode("append").format(fmt).save(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Missing ledger as CSV with header (six columns)."""
    ledger.select(*MISSING.names).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result table as Parquet (any size)."""
    df.write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """CSV report of any size (counts, shares, test result), header in each part file.

    Rows are sorted at the sink (keys ascending), the only place where order
    matters: the sort is a range partition, so the part files are in key
    order, and adaptive execution merges a small report into one file.
    """
    if order_by:
        df = df.orderBy(*order_by)
    df.write.mode("overwrite").option("header", True).csv(path)


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Frame annotation CSV -> ``([model_group,] topic_id int, frame_label string)``.

    Rows with a non-integer id or without a label column are skipped; labels
    are trimmed; when a topic repeats, the last line wins. A missing file is
    an empty annotation.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        raw = (spark.read.option("header", True).option("inferSchema", False).csv(path)
                    .withColumn("_line", F.monotonically_increasing_id()))
    except (AnalysisException, Py4JJavaError):
        return spark.createDataFrame([], ANNOTATION)
    if "topic_id" not in raw.columns or "frame_label" not in raw.columns:
        return spark.createDataFrame([], ANNOTATION)
    group = ["model_group"] if "model_group" in raw.columns else []
    rows = (raw.select(*group, F.expr("try_cast(trim(topic_id) AS INT)").alias("topic_id"),
                       F.trim("frame_label").alias("frame_label"), "_line")
               .filter(F.col("topic_id").isNotNull() & F.col("frame_label").isNotNull()))
    keys = ["model_group", "topic_id"] if "model_group" in raw.columns else ["topic_id"]
    return rows.groupBy(*keys).agg(F.max_by("frame_label", "_line").alias("frame_label"))


def write_annotation_template(template: DataFrame, path: str) -> None:
    """Hand-labelling sheet with a blank ``frame_label`` column."""
    template.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_topic_model(path: str, assignments: DataFrame, weights: DataFrame,
                     summary: DataFrame) -> None:
    """Persist the fitted topic model as three Parquet tables."""
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    weights.write.mode("overwrite").parquet(f"{path}/term_weights")
    summary.write.mode("overwrite").parquet(f"{path}/topic_info")


def load_topic_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}")
            for name in ("assignments", "term_weights", "topic_info")}
