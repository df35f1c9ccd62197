"""End-to-end run on sf0.001: durable tables, partition-pruned sub-corpora."""

from pyspark.sql import functions as F

from framelens.plans.pipeline import run_analysis

SF_SMALL = "/root/testdata/sf0.001"


def test_end_to_end(spark, tmpdir_path):
    out = run_analysis(spark, SF_SMALL, tmpdir_path + "/run", fit=False)
    assert out["articles"] > 0
    r = out["result"]
    assert r["dof"] >= 0 and 0.0 <= r["cramers_v"] <= 1.0
    arts = spark.read.parquet(tmpdir_path + "/run/articles")
    en = arts.filter(F.col("lang") == "en")
    plan = en._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") + len("PartitionFilters: ["):]
    assert "lang" in filters[:filters.index("]")] and "= en" in filters[:filters.index("]")]
    assert en.count() + arts.filter(F.col("lang") != "en").count() == out["articles"]
    shares = spark.read.option("header", True).csv(tmpdir_path + "/run/temporal_analysis")
    sums = shares.groupBy("year").agg(F.sum(F.col("share").cast("double")).alias("s")).collect()
    assert all(abs(x["s"] - 1) < 1e-9 for x in sums)
    tmpl = spark.read.option("header", True).csv(tmpdir_path + "/run/annotation_template")
    assert "frame_label" in tmpl.columns


def test_run_fits_its_own_topics(spark, tmpdir_path):
    out = run_analysis(spark, SF_SMALL, tmpdir_path + "/run")
    found = spark.read.parquet(tmpdir_path + "/run/assignments")
    assert found.count() == out["articles"] == found.select("doc_id").distinct().count()
    info = spark.read.parquet(tmpdir_path + "/run/model/topic_info")
    assert info.agg(F.sum("count")).first()[0] == out["articles"]
