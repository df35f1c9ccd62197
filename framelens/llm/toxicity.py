"""Operator 10: toxicity by a counterfactually regularised classifier.

A logistic model over hashed words and word beginnings. Beside the usual loss
it pays for score changes under counterfactuals: identity terms in a labelled
text are swapped for other terms of their group, and a text without any gets a
neutral mention of one; the squared change of the score is penalised, so that
naming a group moves the score as little as possible and neutral mentions do
not become false positives.

The model is fitted on a bounded, documented sample of labelled rows
(``TRAIN_ROWS``, half of them toxic where there are as many); the intercept is
set back to the class shares of all labelled rows. Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, polynomial_words, text_buffer

BITS = 17
TRAIN_ROWS = 6000
PREFIXES = (4, 5, 6)

# Identity terms by group, in the four languages of the corpus.
IDENTITY = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "atheists", "muslime", "christen", "juden",
     "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "latino", "schwarze", "weiße", "noirs", "blancs", "negros", "blancos"),
    ("gay", "straight", "lesbian", "transgender", "schwule", "homosexuels", "homosexuales"),
    ("immigrants", "refugees", "natives", "einwanderer", "immigrés", "inmigrantes"),
    ("old", "young", "disabled", "elderly", "alte", "junge", "vieux", "jeunes", "viejos", "jóvenes"),
)
TERMS = tuple((g, t) for g, group in enumerate(IDENTITY) for t in group)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature numbers per word (whole word, then its beginnings; -1 where the word is no longer),
    the words' bounds per text, and the word hashes."""
    whole, bounds = polynomial_words(raw, offsets)
    out = [(whole >> np.uint64(64 - BITS)).astype(np.int64)]
    for k in PREFIXES:
        part, longer = polynomial_words(raw, offsets, prefix=k)
        number = (mix(part + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        out.append(np.where(longer, number, -1))
    return out, bounds, whole


def term_features() -> tuple[np.ndarray, list[np.ndarray]]:
    """Word hash and feature numbers of every identity term."""
    raw, offsets = text_buffer(pa.array([t for _, t in TERMS]))
    columns, _, whole = features(raw, offsets)
    return whole, [np.array([c[i] for c in columns if c[i] >= 0]) for i in range(len(TERMS))]


def row_features():
    """Column function text -> features (with counts), number of words, identity terms found."""
    kind = "struct<at:array<int>,count:array<int>,n:bigint,terms:array<int>>"
    arrow = pa.struct([("at", pa.list_(pa.int32())), ("count", pa.list_(pa.int32())), ("n", pa.int64()),
                       ("terms", pa.list_(pa.int32()))])

    @F.arrow_udf(kind)
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, _ = term_features()
        order = np.argsort(known)
        for texts in batches:
            raw, offsets = text_buffer(texts)
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                columns, _, whole = features(raw[a:b], np.array([0, b - a]))
                at, count = np.unique(np.concatenate([c[c >= 0] for c in columns]), return_counts=True)
                place = np.minimum(np.searchsorted(known[order], whole), len(known) - 1)
                terms = order[place][known[order][place] == whole]
                rows.append({"at": at.astype(np.int32), "count": count.astype(np.int32), "n": len(whole),
                             "terms": terms.astype(np.int32)})
            yield pa.array(rows, type=arrow)

    return extract


class Sparse:
    """Rows of (feature, value) with products against weights."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        size = np.array([len(at) for at, _ in rows], dtype=np.int64)
        self.row = np.repeat(np.arange(len(rows)), size)
        self.at = np.concatenate([np.asarray(at, np.int64) for at, _ in rows] or [np.zeros(0, np.int64)])
        self.value = np.concatenate([np.asarray(v, np.float64) for _, v in rows] or [np.zeros(0)])
        self.n = len(rows)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], minlength=self.n)

    def texts(self, weight: np.ndarray, size: int) -> np.ndarray:
        """Weighted number of rows that have each feature."""
        return np.bincount(self.at, weight[self.row], minlength=size)

    def scale(self, by: np.ndarray) -> None:
        self.value = self.value * by[self.at]

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], minlength=size)


def counterfactual(terms: np.ndarray, n: int, seed: int, of_term: list[np.ndarray]):
    """Feature change of one swap per identity term found, or of one neutral mention."""
    pick = np.random.default_rng(seed)
    at, value = [], []
    unit = 1 / np.sqrt(max(n, 1))
    for t in terms:
        group = [i for i, (g, _) in enumerate(TERMS) if g == TERMS[t][0] and i != t]
        other = group[int(pick.integers(len(group)))]
        at += [of_term[t], of_term[other]]
        value += [np.full(len(of_term[t]), -unit), np.full(len(of_term[other]), unit)]
    if not len(terms):
        mention = of_term[int(pick.integers(len(TERMS)))]
        at, value = [mention], [np.full(len(mention), unit)]
    return np.concatenate(at), np.concatenate(value)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, fairness: float = 1.0, ridge: float = 0.1,
        smooth: float = 10.0, rounds: int = 60) -> dict:
    """Weights from texts (doc_id, text) and labels (doc_id, toxic).

    The sample is drawn from the narrow label table, so it is its about
    ``train_rows`` rows that are sent to the texts. Null labels, ids and texts
    teach nothing. With labels of one kind only, every score is that share (0.01 to 0.99).
    """
    rows = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = 1 << BITS
    if len(counts) < 2:
        share = 0.99 if counts.get(1) else 0.01
        return {"weights": np.zeros(size), "bias": float(np.log(share / (1 - share)))}
    share = {k: min(1.0, train_rows / 2 / n) for k, n in counts.items()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = rows.filter(part < F.when(F.col("toxic") == 1, int(1_000_000 * share[1]) + 1)
                         .otherwise(int(1_000_000 * share[0]) + 1))
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id")
    found = texts.select("doc_id", "toxic", row_features()("text").alias("f")).select(
        "doc_id", "toxic", "f.*").toArrow().sort_by([("doc_id", "ascending")])
    y = found.column("toxic").to_numpy().astype(np.float64)
    n = np.maximum(found.column("n").to_numpy(), 1)
    _, of_term = term_features()
    lists = {c: found.column(c).combine_chunks() for c in ("at", "count", "terms")}

    def cells(name: str) -> list[np.ndarray]:
        array = lists[name]
        flat, cut = array.values.to_numpy(), array.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]

    x = Sparse([(at, c / np.sqrt(m)) for at, c, m in zip(cells("at"), cells("count"), n)])
    swap = Sparse([counterfactual(t, m, i, of_term) for i, (t, m) in enumerate(zip(cells("terms"), n))])
    # features weighted by their smoothed log odds, so that what few texts share teaches little
    toxic, all_ = x.texts(y, size), x.texts(np.ones(len(y)), size)
    prior = y.mean()
    odds = (np.log((toxic + smooth * prior) / (y.sum() + smooth))
            - np.log((all_ - toxic + smooth * (1 - prior)) / ((1 - y).sum() + smooth)))
    odds[all_ < 2] = 0
    x.scale(odds)
    swap.scale(odds)

    def slope(w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        margin = x.times(w) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) / len(y)
        change = swap.times(w)
        loss = (np.logaddexp(0, margin) - y * margin).sum() + fairness * change @ change + ridge / 2 * w @ w
        grad = x.back(error, size) + (2 * fairness * swap.back(change, size) + ridge * w) / len(y)
        return float(loss), grad, error.sum()

    w, bias, rate = np.zeros(size), float(np.log(prior / (1 - prior))), 0.1
    loss, grad, grad_bias = slope(w, bias)
    best = (loss, w, bias)
    for _ in range(rounds):  # gradient steps of Barzilai-Borwein length
        step, step_bias = -rate * grad, -rate * grad_bias
        w, bias = w + step, bias + step_bias
        loss, new, new_bias = slope(w, bias)
        if loss < best[0]:
            best = (loss, w, bias)
        bend = float(step @ (new - grad) + step_bias * (new_bias - grad_bias))
        rate = float(step @ step + step_bias ** 2) / bend if bend > 1e-15 else rate
        grad, grad_bias = new, new_bias
    w, bias = best[1] * odds, best[2]
    # the sample's class shares are not those of all labelled rows
    bias += float(np.log(share[0] / share[1]))
    return {"weights": w, "bias": bias}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts, and texts without words, get the score of no
    evidence (the intercept). Other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        {"weights": np.append(model["weights"], 0.0), "bias": model["bias"]})  # 2**BITS weights

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, bias = shared.value["weights"], shared.value["bias"]
        for texts in batches:
            raw, offsets = text_buffer(texts)
            out = []
            for a, b in pieces(offsets, 1 << 20):
                columns, bounds, whole = features(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                total = np.concatenate([[0.0], np.cumsum(sum(w[c] for c in columns))])
                out.append(np.diff(total[bounds]) / np.sqrt(np.maximum(np.diff(bounds), 1)))
            margin = np.concatenate(out or [np.zeros(0)]) + bias
            yield pa.array(1 / (1 + np.exp(-np.clip(margin, -50, 50))), pa.float64())

    return (docs.withColumn("score", judge("text"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
