"""Language identification: multinomial naive Bayes over character trigrams.

Trained on labelled rows (``lang`` given), applied to whole texts. The model
is a ``(lang, trigram, n)`` profile table. Scoring is a join of each
document's trigram counts with the profile (one row per trigram, a map from
language to weight) on the trigram, then one sum per document and language:

    score(d, L) = ln P(L) + sum_t c(d,t) * ln(n(t,L) + 1) - C(d) * ln(N_L + V)

(Laplace smoothing: trigrams unseen for L contribute only the last term, so
only matched trigrams need a join row.) Ties go to the smaller language code
after rounding to 6 places; a text with no trigram has no features and gets
the fallback. Trigrams are counted inside the row, so one row per document
and distinct trigram leaves the scan; a trigram that most documents hold is
left to the adaptive skew join where the profile is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import DEFAULT, Params
from ..session import cut_lineage

# A profile of up to so many (language, trigram) rows goes to every task.
BROADCAST_ROWS = 1_000_000
NON_LETTERS = r"[^\p{L}]+"


def normalized_letters(text) -> Column:
    """Lower-cased letters with every non-letter run as one space, padded."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), NON_LETTERS, " ")),
                    F.lit(" "))


def trigram_counts(docs: DataFrame, keys: list, text: str = "text") -> DataFrame:
    """``(keys..., tri, c)``: trigram counts of each row, counted inside the row.

    A trigram is three code points, held as one integer while a text's are
    sorted and counted. A text without trigrams gives one row with null ``tri``
    and ``c``.
    """
    listed = docs.select(*keys, normalized_letters(text).alias("_norm"))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in listed.schema.fields[:-1]],
                           T.StructField("tri", T.StringType()), T.StructField("c", T.LongType())])
    names, step = schema.names, 256     # rows whose counts leave in one batch

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                found = [_counted(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(n) for _, n in found]))
                codes, n = (np.concatenate(x) for x in zip(*found))
                points = np.stack([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF], 1).astype("<u4")
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(rows) for i in range(batch.num_columns - 1)],
                     pa.array(points.view("<U3").ravel(), pa.string(), mask=none), pa.array(n, pa.int64(), mask=none)],
                    names)

    return listed.mapInArrow(counted, schema)


def _counted(norm: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of one text as integers, and their counts; one count 0 for a text without."""
    p = np.frombuffer(norm.encode("utf-32-le"), "<u4").astype(np.int64)
    if len(p) < 3:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    return np.unique((p[:-2] << 42) | (p[1:-1] << 21) | p[2:], return_counts=True)


def train_profiles(labelled: DataFrame, key: str = "doc_id", text: str = "text",
                   label: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(profile ``(lang, tri, logn)``, per-language constants ``(lang, prior, denom)``)."""
    lab = labelled.filter(F.col(label).isNotNull()).select(F.col(label).alias("lang"), text)
    # written once: profile and constants, read more than once, follow from this small table
    counts = cut_lineage(trigram_counts(lab, ["lang"], text).filter(F.col("tri").isNotNull())
                         .groupBy("tri", "lang").agg(F.sum("c").alias("n")).select("lang", "tri", "n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("N"))
    docs = lab.groupBy("lang").agg(F.count(F.lit(1)).alias("d"))
    # Vocabulary size V, split by the first language of each trigram so that
    # it sums over the (few) language rows with a window instead of a join.
    vparts = (counts.groupBy("tri").agg(F.min("lang").alias("lang"))
                    .groupBy("lang").agg(F.count(F.lit(1)).alias("v")))
    everyone = Window.partitionBy()
    consts = (totals.join(docs, "lang").join(vparts, "lang", "left")
                    .withColumn("V", F.sum(F.coalesce("v", F.lit(0))).over(everyone))
                    .withColumn("D", F.sum("d").over(everyone))
                    .select("lang", F.log(F.col("d") / F.col("D")).alias("prior"),
                            F.log(F.col("N") + F.col("V")).alias("denom")))
    profile = counts.select("lang", "tri", F.log(F.col("n") + 1).alias("logn"))
    return profile, consts


def detect_language(docs: DataFrame, profile: DataFrame, consts: DataFrame, key: str = "doc_id",
                    text: str = "text", hint: str = "lang", params: Params = DEFAULT) -> DataFrame:
    """``(key, lang_detected, lang)``: the best language, and the accepted result.

    ``lang`` is the detected code if it is accepted (en/fr by default), else
    the row's hint; a text without trigrams gives the hint. Only the constants
    (one row per language) are read by the driver. Without any labelled row
    nothing is detected.
    """
    langs = consts.orderBy("lang").collect()
    weights = profile.groupBy("tri").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "logn"))).alias("_w"))
    if profile.count() <= BROADCAST_ROWS:
        weights = F.broadcast(weights)
    tc = trigram_counts(docs.select(key, F.col(hint).alias("_hint"), text), [key, "_hint"], text)
    sums = (tc.join(weights, "tri", "left").groupBy(key, "_hint")
              .agg(F.coalesce(F.sum("c"), F.lit(0)).alias("_C"),
                   *[F.sum(F.col("c") * F.coalesce(F.col("_w")[r["lang"]], F.lit(0.0))).alias(f"_p{i}")
                     for i, r in enumerate(langs)]))
    scored = [F.struct((-F.round(F.coalesce(F.col(f"_p{i}"), F.lit(0.0)) + F.lit(r["prior"])
                                 - F.col("_C") * F.lit(r["denom"]), 6)).alias("neg"),
                       F.lit(r["lang"]).alias("lang")) for i, r in enumerate(langs)]
    best = F.array_min(F.array(*scored))["lang"] if scored else F.lit(None).cast("string")
    detected = F.when(F.col("_C") > 0, best)
    accepted = detected.isin(*params.accepted_languages)
    return sums.select(key, detected.alias("lang_detected"),
                       F.when(accepted, detected).otherwise(F.col("_hint")).alias("lang"))
