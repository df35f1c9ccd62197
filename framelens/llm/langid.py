"""Operator 7: hierarchical language identification.

First the language family, then the language within it. Both steps are
one-versus-one linear support vector machines over hashed letter trigrams:
the family machines tell families apart, the machines of a family separate
its closely related languages. A machine's margin is linear in the trigram
shares of a text, so scoring is a table lookup and a running sum over the
text's bytes; whole texts are read.

Training uses a bounded, documented sample (``TRAIN_ROWS`` labelled rows in
all, drawn per language by a hash of the id); everything else runs over all
rows on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_buffer

BINS = 2048
TRAIN_ROWS = 4000
UNKNOWN = "und"

# Language families of common ISO 639-1 codes; others stand alone.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "am"),
    "sinitic": ("zh", "yue"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

# byte -> symbol: 0 for anything but letters, 1..26 for a-z (either case), then the non-ASCII bytes
SYMBOL = np.zeros(256, dtype=np.uint64)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)


def family(language: str) -> str:
    return FAMILY_OF.get(language, language)


def trigram_bins(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the trigram at every byte (-1: none there) and each text's first entry."""
    symbol = SYMBOL[raw]
    code = np.zeros(len(raw), dtype=np.uint64)
    if len(raw) > 2:
        code[:-2] = (symbol[:-2] * np.uint64(155) + symbol[1:-1]) * np.uint64(155) + symbol[2:]
    bins = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int32)
    bins[code == 0] = -1
    ends = offsets[1:]
    for back in (1, 2):  # a trigram does not run on into the next text
        at = ends - back
        bins[at[at >= offsets[:-1]]] = -1
    return bins, offsets


def histograms() -> F.arrow_udf:
    """Column function text -> binary: trigram shares (float32) of a whole text."""
    @F.arrow_udf("binary")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            raw, offsets = text_buffer(texts)
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                bins, _ = trigram_bins(raw[a:b], np.array([0, b - a]))
                found = np.bincount(bins[bins >= 0], minlength=BINS)
                rows.append((found / max(found.sum(), 1)).astype(np.float32).tobytes())
            yield pa.array(rows, type=pa.binary())

    return count


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Linear SVM (hinge loss, balanced classes) by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    limit = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
    limit = limit / cost
    alpha, w, square = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(axis=1)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), limit[i] * cost)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Family and language machines from rows (doc_id, text, lang).

    Rows with a null text, id or language, or without a letter, teach nothing.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                           & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return {"languages": [], "machines": [], "weights": np.zeros((0, BINS + 1))}
    share = train_rows // len(languages)
    keep = F.lit(False)
    for lang in languages:
        keep = F.when(F.col("lang") == lang,
                      F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000))
                      < int(1_000_000 * min(1.0, share / counts[lang])) + 1).otherwise(keep)
    sample = rows.filter(keep).select("doc_id", "lang", histograms()("text").alias("x")).toArrow()
    sample = sample.sort_by([("doc_id", "ascending")])
    lang = np.array(sample.column("lang").to_pylist())
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32).reshape(-1, BINS).astype(np.float64)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-4)  # rare trigrams count as much as common ones
    x = x * scale
    families = np.array([family(c) for c in lang])
    weights, machines = [], []
    for kind, names, of in (("family", sorted(set(families)), families),
                            *[("language", [c for c in languages if family(c) == f and c in lang], lang)
                              for f in sorted(set(families))]):
        for a, b in combinations(names, 2):
            use = (of == a) | (of == b)
            w = train_svm(x[use], np.where(of[use] == a, 1.0, -1.0))
            weights.append(np.append(w[:-1] * scale, w[-1]))
            machines.append((kind, a, b))
    return {"languages": sorted(set(lang.tolist())), "machines": machines,
            "weights": np.array(weights).reshape(-1, BINS + 1)}


def margins(weights: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Margin of every machine for every text (texts x machines)."""
    bins, _ = trigram_bins(raw, offsets)
    at = np.where(bins < 0, BINS, bins)
    n = np.diff(np.concatenate([[0], np.cumsum(bins >= 0)])[offsets])
    out = np.empty((len(offsets) - 1, len(weights)))
    for m, w in enumerate(weights):
        table = np.append(w[:BINS], 0.0)
        total = np.concatenate([[0.0], np.cumsum(table[at])])
        out[:, m] = np.diff(total[offsets]) / np.maximum(n, 1) + w[BINS]
    return out


def decide(model: dict, margin: np.ndarray, steep: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Family by votes of its machines, then language; score: the least sure of the winner's duels."""
    n = len(margin)
    if not model["languages"]:
        return np.full(n, UNKNOWN, object), np.zeros(n)

    def duel(kind: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        votes, least = np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
        strength = np.zeros((n, len(names)))
        for m, (k, a, b) in enumerate(model["machines"]):
            if k == kind and a in names and b in names:
                i, j, d = names.index(a), names.index(b), margin[:, m]
                for at, s in ((i, d), (j, -d)):
                    votes[:, at] += s > 0
                    strength[:, at] += np.clip(s, -1, 1)
                    least[:, at] = np.minimum(least[:, at], s)
        best = (votes + strength / (4 * max(len(names), 1))).argmax(axis=1)
        return best, 1 / (1 + np.exp(-steep * np.minimum(least[np.arange(n), best], 50.0)))

    names = sorted({family(c) for c in model["languages"]})
    first, score = duel("family", names)
    out = np.empty(n, object)
    for i, f in enumerate(names):
        languages = [c for c in model["languages"] if family(c) == f]
        mine = first == i
        best, sure = duel("language", languages)
        out[mine] = np.array(languages, object)[best[mine]]
        score[mine] = np.minimum(score[mine], sure[mine])
    return out, score


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1).

    A null or empty text, or one without a letter, is ``und`` with score 0; so
    is every text if no row taught anything. With one language learned, that
    is the answer with score 1. Other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # machines x BINS weights

    @F.arrow_udf("struct<lang:string,score:double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            raw, offsets = text_buffer(texts)
            margin = [margins(model["weights"], raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                      for a, b in pieces(offsets, 1 << 20)]
            lang, score = decide(model, np.concatenate(margin or [np.zeros((0, len(model["weights"])))]))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["lang", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn("_judged", judge("text")).withColumn("_lettered", lettered)
    return (out.withColumn("lang_pred", F.when(F.col("_lettered"), F.col("_judged.lang")).otherwise(UNKNOWN))
            .withColumn("score", F.when(F.col("_lettered"), F.col("_judged.score")).otherwise(0.0))
            .drop("_judged", "_lettered"))


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Rows never learned from: crc32 of the id as text falls into ``fold``. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def keep_identified(docs: DataFrame, labelled: DataFrame, least: float = 0.05) -> DataFrame:
    """Rows whose language is identified: not ``und``, score of ``least`` or more; columns unchanged."""
    model = fit(labelled.filter(~held_out()))
    judged = predict(docs.select(F.struct("*").alias("_doc"), F.col("text")), model)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_doc.*")
