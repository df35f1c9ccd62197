"""Explicit schemas (field order of the original records)."""

from pyspark.sql.types import (BooleanType, DateType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType)


def _strings(*names):
    return StructType([StructField(n, StringType(), True) for n in names])


EXPORT = _strings("id", "indexed_date", "language", "media_name", "media_url", "publish_date",
                  "title", "url")
RAW = _strings("id", "title", "url", "date", "source", "domain", "lang", "body", "retrieved_via")
RAW_WITH_CORRUPT = StructType(RAW.fields + [StructField("_corrupt_record", StringType(), True)])
MISSING = _strings("source", "domain", "date", "lang", "title", "url")
ARTICLE = StructType([
    StructField("id", StringType()), StructField("title", StringType()),
    StructField("body", StringType()), StructField("text", StringType()),
    StructField("date", DateType()), StructField("year", IntegerType()),
    StructField("source", StringType()), StructField("domain", StringType()),
    StructField("lang", StringType()), StructField("url", StringType()),
])
ANNOTATION = StructType([StructField("topic_id", IntegerType()),
                         StructField("frame_label", StringType())])
CHI2 = StructType([
    StructField("chi2", DoubleType()), StructField("p_value", DoubleType()),
    StructField("dof", IntegerType()), StructField("n", LongType()),
    StructField("cramers_v", DoubleType()), StructField("significant", BooleanType()),
    StructField("alpha", DoubleType()), StructField("note", StringType()),
])
