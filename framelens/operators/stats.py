"""Chi-square test of frame x language with a bias-corrected Cramer's V.

Everything is a native expression over the (small, aggregated) contingency
table; the p-value is the regularised upper incomplete gamma function
Q(dof/2, chi2/2), a finite sum for whole dof plus an erfc for odd dof, written
with ``aggregate(sequence(...))`` higher-order functions (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import EFFECT_BANDS, NOTE_NOT_APPLICABLE, NOTE_SMALL_EXPECTED, DEFAULT, Params


def _tail_sum(x: str, terms: str, first: str, shift: str) -> str:
    """Sum of ``terms`` positive terms with logs ``first + ln(x / (j + shift))`` (SQL text)."""
    step = f"acc.l + ln({x}) - ln(j + {shift})"
    return (f"CASE WHEN {terms} < 1 THEN 0D ELSE aggregate(sequence(1, greatest({terms} - 1, 1)), "
            f"named_struct('s', exp({first}), 'l', {first}), (acc, j) -> "
            f"CASE WHEN {terms} < 2 THEN acc ELSE named_struct('s', acc.s + exp({step}), 'l', {step}) END).s END")


def _erfc_sqrt(x: str) -> str:
    """erfc(sqrt(x)): a series below 1, a backward continued fraction from 1 on."""
    z = f"sqrt({x})"
    series = (f"1D - 2D / sqrt(pi()) * exp(-({x})) * aggregate(sequence(1, 60), "
              f"named_struct('s', {z}, 't', {z}), (acc, j) -> named_struct("
              f"'s', acc.s + acc.t * 2D * ({x}) / (2D * j + 1D), 't', acc.t * 2D * ({x}) / (2D * j + 1D))).s")
    fraction = f"aggregate(sequence(300, 1), {z}, (acc, j) -> {z} + (j / 2D) / acc)"
    return f"CASE WHEN {x} < 1 THEN {series} ELSE exp(-({x})) / sqrt(pi()) / {fraction} END"


def chi2_sf_expr(chi2: str, dof: str) -> Column:
    """Upper tail of the chi-square distribution, Q(dof/2, chi2/2).

    Summed from the tail itself (all terms positive), so tiny p-values keep
    their relative accuracy; the work depends on ``dof`` only.
    """
    x = f"({chi2} / 2.0D)"
    even = _tail_sum(x, f"cast({dof} / 2 as int)", f"(-{x})", "0D")
    odd = _tail_sum(x, f"cast(({dof} - 1) / 2 as int)", f"(0.5D * ln({x}) - ln(sqrt(pi()) / 2D) - {x})", "0.5D")
    return F.expr(f"CASE WHEN {x} <= 0 THEN 1.0D WHEN {dof} % 2 = 0 THEN least(1D, {even}) "
                  f"ELSE least(1D, {_erfc_sqrt(x)} + {odd}) END")


def cramers_v_expr(chi2: Column, n: Column, r: Column, k: Column) -> Column:
    """Bias-corrected V; 0 when n <= 1 or the corrected denominator is <= 0."""
    n1 = n - 1
    phi2c = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / n1)
    rc = r - (r - 1) * (r - 1) / n1
    kc = k - (k - 1) * (k - 1) / n1
    denom = F.least(kc - 1, rc - 1)
    return (F.when((n <= 1) | (denom <= 0), F.lit(0.0))
             .otherwise(F.sqrt(phi2c / denom)))


def effect_band(v: Column) -> Column:
    out = None
    for threshold, label in EFFECT_BANDS:
        out = (F.when(v >= threshold, label) if out is None
               else out.when(v >= threshold, label))
    return out.otherwise("negligible")


def chi_square(expected: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row: chi2, p_value, dof, n, cramers_v, significant, alpha, note, effect.

    Yates' continuity correction when dof = 1. With fewer than two languages
    or frames the test is not applicable: chi2 and p are NaN, dof 0, V 0.
    """
    o, e = F.col("n"), F.col("expected")
    agg = expected.agg(
        F.countDistinct("lang").cast("int").alias("r"),
        F.countDistinct("frame").cast("int").alias("k"),
        F.sum("n").cast("bigint").alias("n"),
        F.sum(((o - e) ** 2) / e).alias("_chi2_plain"),
        F.sum(((F.abs(o - e) - F.least(F.lit(0.5), F.abs(o - e))) ** 2) / e).alias("_chi2_yates"),
        F.avg((e < 5).cast("double")).alias("_small"),
    )
    dof = ((F.col("r") - 1) * (F.col("k") - 1)).cast("int")
    applicable = (F.col("r") >= 2) & (F.col("k") >= 2)
    res = agg.select(
        "r", "k", "n", "_small",
        F.when(applicable, dof).otherwise(F.lit(0)).alias("dof"),
        F.when(~applicable, F.lit(float("nan")))
         .when(dof == 1, F.col("_chi2_yates")).otherwise(F.col("_chi2_plain")).alias("chi2"),
        applicable.alias("_ok"))
    res = res.withColumn(
        "p_value", F.when(F.col("_ok"), chi2_sf_expr("chi2", "dof")).otherwise(F.lit(float("nan"))))
    v = F.when(F.col("_ok"), cramers_v_expr(F.col("chi2"), F.col("n").cast("double"),
                                            F.col("r").cast("double"), F.col("k").cast("double"))
               ).otherwise(F.lit(0.0))
    note = (F.when(~F.col("_ok"), F.lit(NOTE_NOT_APPLICABLE))
             .when(F.col("_small") > params.small_cell_share, F.lit(NOTE_SMALL_EXPECTED))
             .otherwise(F.lit("")))
    return (res.withColumn("cramers_v", v)
               .select("chi2", "p_value", "dof", "n", "cramers_v",
                       (F.col("_ok") & (F.col("p_value") < params.alpha)).alias("significant"),
                       F.lit(params.alpha).alias("alpha"), note.alias("note"),
                       effect_band(F.col("cramers_v")).alias("effect")))
