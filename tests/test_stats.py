"""Contingency and chi-square: tables with known answers and the published result."""

import math

import pytest
from pyspark.sql import functions as F

from framelens.operators import frames, stats


def chi_row(spark, table):
    """Chi-square row of a ``{(lang, frame): count}`` table."""
    rows = [(lang, frame, n) for (lang, frame), n in table.items()]
    cont = spark.createDataFrame(rows, "lang string, frame string, n long")
    return stats.chi_square(frames.expected_counts(cont)).first()


def assigned(spark, rows):
    """Documents ``(lang, topic)`` joined to frames named after their topic."""
    docs = spark.createDataFrame([(i, "all", lang, t) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, model_group string, lang string, topic int")
    info = spark.createDataFrame([("all", t, f"frame{t}") for t in (0, 1)],
                                 "model_group string, topic int, name string")
    none = spark.createDataFrame([], "topic_id int, frame_label string")
    return frames.framed(docs, frames.frame_names(info, none))


# (table, expected fields); the pairs are the published unit inputs
CASES = {
    "two_by_two_perfect": ({("en", "A"): 20, ("en", "B"): 0, ("fr", "A"): 0, ("fr", "B"): 20},
                           {"chi2": 36.1, "dof": 1, "n": 40, "cramers_v": 0.948649, "significant": True}),
    "two_by_two_flat": ({(x, y): 15 for x in ("en", "fr") for y in "AB"},
                        {"chi2": 0.0, "dof": 1, "n": 60, "cramers_v": 0.0, "significant": False}),
    "two_by_two_tiny": ({(x, y): 1 for x in ("en", "fr") for y in "AB"},
                        {"chi2": 0.0, "dof": 1, "n": 4, "cramers_v": 0.0, "significant": False}),
}


@pytest.mark.parametrize("name", CASES)
def test_known_tables(spark, name):
    table, want = CASES[name]
    got = chi_row(spark, table)
    for field, value in want.items():
        assert got[field] == (pytest.approx(value, abs=1e-5) if isinstance(value, float) else value), field
    assert (got["note"] != "") == (name == "two_by_two_tiny")


def test_one_frame_has_no_test(spark):
    got = chi_row(spark, {("en", "A"): 1, ("fr", "A"): 1})
    assert math.isnan(got["chi2"]) and math.isnan(got["p_value"])
    assert (got["dof"], got["cramers_v"], got["significant"]) == (0, 0.0, False)
    assert "not applicable" in got["note"]


def test_outliers_are_not_counted(spark):
    f = assigned(spark, [("en", 0), ("fr", 1), ("en", -1), ("fr", -1)])
    assert frames.frame_contingency(f).agg(F.sum("n")).first()[0] == 2


def test_published_golden(spark):
    """Contingency of the study (2 languages x 7 frames) -> its published result."""
    counts = {"en": [20, 45, 27, 21, 16, 20, 37], "fr": [5, 6, 2, 16, 7, 3, 6]}
    frames_ = ["conspiracy_qanon", "far_right_extremism", "incel_misogyny",
               "meme_internet_culture", "platform_tech", "politics_elections", "violence_crime"]
    rows = [(lang, fr, n) for lang, ns in counts.items() for fr, n in zip(frames_, ns)]
    cont = spark.createDataFrame(rows, "lang string, frame string, n long")
    r = stats.chi_square(frames.expected_counts(cont)).first()
    assert r["chi2"] == pytest.approx(21.39187645391718, rel=1e-12)
    assert r["dof"] == 6 and r["n"] == 231
    assert r["p_value"] == pytest.approx(0.0015596114730755512, rel=1e-9)
    assert r["cramers_v"] == pytest.approx(0.25847445396853963, rel=1e-12)
    assert r["significant"] is True and r["note"].startswith("Warning")


def test_odd_dof_pvalue(spark):
    """Closed form for dof 3: Q = erfc(sqrt(x/2)) + sqrt(2x/pi) exp(-x/2)."""
    df = spark.createDataFrame([(7.5, 3)], "x double, k int")
    p = df.select(stats.chi2_sf_expr("x", "k")).first()[0]
    x = 7.5
    exact = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    assert p == pytest.approx(exact, rel=1e-10)


def exact_tail(x, dof):
    """Closed forms: dof 1 and 3 by erfc, even dof by the Poisson sum."""
    h = x / 2
    if dof % 2 == 0:
        return sum(math.exp(j * math.log(h) - h - math.lgamma(j + 1)) for j in range(dof // 2))
    return math.erfc(math.sqrt(h)) + (math.sqrt(2 * x / math.pi) * math.exp(-h) if dof == 3 else 0.0)


def test_tail_keeps_relative_accuracy(spark):
    grid = [(x, k) for x in (0.01, 0.7, 2.0, 3.5, 60.0, 200.0, 1000.0) for k in (1, 2, 3, 6, 20)]
    df = spark.createDataFrame(grid, "x double, k int")
    for r in df.select("x", "k", stats.chi2_sf_expr("x", "k").alias("p")).collect():
        assert r["p"] == pytest.approx(exact_tail(r["x"], r["k"]), rel=1e-9), (r["x"], r["k"])
    huge = spark.createDataFrame([(5e9, 1), (5e9, 6)], "x double, k int")
    assert [r[0] for r in huge.select(stats.chi2_sf_expr("x", "k")).collect()] == [0.0, 0.0]


def test_shares_sum_to_one(spark):
    f = assigned(spark, [("en", 0), ("fr", 1), ("en", 1)] * 3)
    f = f.withColumn("year", F.lit(2020) + (F.col("doc_id") % 2).cast("int"))
    by_year = frames.frames_over_time(f).groupBy("year").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in by_year)
    by_lang = frames.compare_lang(f).groupBy("lang").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in by_lang)
