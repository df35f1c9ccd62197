"""Text -> topics: vectors of the texts, reduction, density clusters, assignment.

The vectors are hashed TF-IDF terms (``HASH_SIZE`` columns, unit rows) on the
leading right singular vectors of the fitted texts (``projection_dims``), so
no step ever holds a row wider than its own terms, and document frequencies
and singular vectors are of a fixed size. The vectors are reduced by PCA and
clustered per model group by the condensed density tree, which sets no
distance by hand. A fitted model assigns other texts to the nearest topic
centroid if its cosine reaches ``eps_reduced`` or, for a wider topic, that of
its farthest fitted text; it can be saved and loaded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, Normalizer, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..session import cut_lineage, scratch_tables, shuffles_released
from . import clustering
from .density_tree import hierarchical_clusters
from .svd import filled, pieces, truncated_svd
from .topics import tokenize, with_model_group

HASH_SIZE = 1 << 16


def hashed_terms(docs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Add ``_h``: the hash of every term of the text, in order."""
    toks = tokenize(docs, params=params)
    return toks.withColumn("_h", F.transform("terms", lambda t: (F.crc32(t.cast("binary")) % HASH_SIZE).cast("int"))
                           ).drop("terms")


def term_numbers(docs: DataFrame, params: Params = DEFAULT, key: str = "doc_id") -> DataFrame:
    """``(key, at, w)``: per text its distinct hashed terms, ascending, and how often each occurs."""
    terms = hashed_terms(docs.select(key, "text"), params).select(key, "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, owner, flat, _ in pieces(pa.RecordBatch.from_arrays([*batch.columns, batch.column(1)], [key, "at", "w"])):
                code, n = np.unique(owner * HASH_SIZE + flat, return_counts=True)
                row, term = np.divmod(code, HASH_SIZE)
                ends = pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, n)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *lists], [key, "at", "w"])

    return terms.mapInArrow(run, f"`{key}` {terms.schema[key].dataType.simpleString()}, at array<int>, w array<int>")


def inverse_frequencies(terms: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the hashed term)) + 1, over all rows of ``term_numbers``; 0 where none has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(HASH_SIZE, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=HASH_SIZE)
        h = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int32()), pa.array(counts[h])], ["h", "n"])

    total = terms.count()
    with shuffles_released(terms.sparkSession):
        found = (terms.select("at").mapInArrow(run, "h int, n long").groupBy("h").agg(F.sum("n").alias("n"))
                 .collect())                                            # HASH_SIZE rows at most
    counts = np.zeros(HASH_SIZE)
    for r in found:
        counts[r["h"]] = r["n"]
    return np.where(counts > 0, np.log((1 + total) / (1 + counts)) + 1, 0.0)


def _weigh(idf: np.ndarray):
    """TF-IDF weights of unit length of the known terms; columns number the hashed terms with a frequency."""
    column = np.cumsum(idf > 0) - 1

    def run(rows: int, owner: np.ndarray, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = idf[terms] > 0
        owner, terms = owner[known], terms[known]
        w = n[known] * idf[terms]
        return owner, column[terms], w / np.sqrt(np.bincount(owner, w * w, rows))[owner]
    return run


def weighted_terms(docs: DataFrame, idf: np.ndarray, params: Params = DEFAULT, key: str = "doc_id") -> DataFrame:
    """``(key, at, w)``: per text its known hashed terms as columns and their TF-IDF weights, of unit length.

    Columns number the hashed terms with a frequency. Both arrays are empty
    for a text without such a term.
    """
    weigh = _weigh(idf)                                                 # HASH_SIZE doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, owner, terms, n in pieces(batch):
                row, at, w = weigh(rows.num_rows, owner, terms, n)
                ends = pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), w)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *lists], [key, "at", "w"])

    terms = term_numbers(docs, params, key)
    return terms.mapInArrow(run, f"`{key}` {terms.schema[key].dataType.simpleString()}, at array<int>, w array<double>")


@dataclass(frozen=True)
class TextSpace:
    """Frequencies and right singular vectors of fitted texts; a column per hashed term with a frequency."""
    idf: np.ndarray                 # HASH_SIZE
    values: np.ndarray              # singular values, descending
    basis: np.ndarray               # columns x projection_dims


def _space(terms: DataFrame, params: Params) -> TextSpace:
    idf = inverse_frequencies(terms)
    size = int((idf > 0).sum())
    if not size:
        return TextSpace(idf, np.zeros(params.projection_dims), np.zeros((0, params.projection_dims)))
    return TextSpace(idf, *truncated_svd(terms, size, params.projection_dims, seed=params.seed, weigh=_weigh(idf)))


def fit_space(docs: DataFrame, params: Params = DEFAULT, key: str = "doc_id") -> TextSpace:
    """Truncated singular value decomposition of the texts' weighted terms."""
    with scratch_tables(docs.sparkSession) as keep:
        return _space(keep(term_numbers(docs, params, key)), params)


def _projected(terms: DataFrame, space: TextSpace, key: str) -> DataFrame:
    shared = terms.sparkSession.sparkContext.broadcast(space.basis)     # HASH_SIZE x projection_dims at most
    weigh = _weigh(space.idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        for batch in batches:
            for rows, owner, numbers, n in pieces(batch):
                row, at, w = weigh(rows.num_rows, owner, numbers, n)
                out: list = [None] * rows.num_rows
                for i, a, b in filled(rows.num_rows, row):
                    image = w[a:b] @ basis[at[a:b]]
                    length = np.linalg.norm(image)
                    if length > 1e-12:
                        out[i] = image / length
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "embedding"])

    return terms.mapInArrow(run, f"`{key}` {terms.schema[key].dataType.simpleString()}, embedding array<double>")


def project(docs: DataFrame, space: TextSpace, params: Params = DEFAULT, key: str = "doc_id") -> DataFrame:
    """``(key, embedding)``: unit vector in the space; null for a text that shares no direction with it."""
    return _projected(term_numbers(docs, params, key), space, key)


@dataclass(frozen=True)
class TopicModel:
    """Fitted state of one model group; ``pca`` is None without any vector."""
    group: str
    space: TextSpace
    pca: PCAModel | None
    assignments: DataFrame          # (key, topic, probability)
    centroids: DataFrame            # (topic, centroid, reach): reach is the least cosine of its fitted texts


def save_model(model: TopicModel, path: str) -> None:
    """Write a model under ``path``, replacing what is there; ``done`` is written last."""
    spark = model.assignments.sparkSession
    columns = np.flatnonzero(model.space.idf > 0)
    basis = pd.DataFrame({"h": columns, "idf": model.space.idf[columns], "v": list(model.space.basis)})
    schema = "h long, idf double, v array<double>"                  # HASH_SIZE rows at most
    spark.createDataFrame(basis if len(basis) else [], schema).write.mode("overwrite").parquet(f"{path}/space")
    model.assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    model.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    if model.pca is not None:
        model.pca.write().overwrite().save(f"{path}/pca")
    facts = json.dumps({"group": model.group, "values": model.space.values.tolist(), "pca": model.pca is not None})
    spark.createDataFrame([(facts,)], "value string").write.mode("overwrite").text(f"{path}/done")


def load_model(spark: SparkSession, path: str) -> TopicModel:
    """A model as saved; places texts as the saved one does."""
    facts = json.loads(spark.read.text(f"{path}/done").first()["value"])
    rows = spark.read.parquet(f"{path}/space").orderBy("h").toPandas()
    idf = np.zeros(HASH_SIZE)
    idf[rows["h"].to_numpy(dtype=np.int64)] = rows["idf"].to_numpy(dtype=np.float64)
    values = np.array(facts["values"])
    basis = np.stack(rows["v"].to_numpy()) if len(rows) else np.zeros((0, len(values)))
    return TopicModel(facts["group"], TextSpace(idf, values, basis),
                      PCAModel.load(f"{path}/pca") if facts["pca"] else None,
                      spark.read.parquet(f"{path}/assignments"), spark.read.parquet(f"{path}/centroids"))


def _reduced(vectors: DataFrame, pca: PCAModel, key: str) -> DataFrame:
    unit = Normalizer(inputCol="_v", outputCol="_n", p=2.0).transform(
        vectors.select(key, array_to_vector("embedding").alias("_v")))
    return pca.transform(unit).select(key, vector_to_array("_p", "float32").alias("embedding"))


def fit_group(docs: DataFrame, group: str, params: Params = DEFAULT, key: str = "doc_id") -> TopicModel:
    """Topics of one group of texts; a text without terms is an outlier (-1)."""
    with scratch_tables(docs.sparkSession) as keep:       # the texts' terms are counted once
        terms = keep(term_numbers(docs, params, key))
        space = _space(terms, params)
        vectors = cut_lineage(_projected(terms, space, key))
    usable = vectors.filter("embedding is not null")
    nothing = docs.sparkSession.createDataFrame([], "topic int, centroid array<double>, reach double")
    outliers = vectors.select(key, F.lit(-1).alias("topic"), F.lit(0.0).alias("probability"))
    if usable.isEmpty():
        return TopicModel(group, space, None, outliers, nothing)
    unit = Normalizer(inputCol="_v", outputCol="_n", p=2.0).transform(
        usable.select(key, array_to_vector("embedding").alias("_v")))
    pca = PCA(k=min(params.n_components, params.projection_dims), inputCol="_n", outputCol="_p").fit(unit)
    reduced = cut_lineage(_reduced(usable, pca, key))
    found = hierarchical_clusters(reduced, key, "embedding", params)
    rest = outliers.join(found.select(key), key, "left_anti")
    centroids = cut_lineage(clustering.topic_centroids(reduced, found.select(key, "topic"), key))
    own = clustering.nearest_centroid(reduced, centroids, key, "embedding").join(
        found.select(key, F.col("topic").alias("_own")), key).filter(F.col("topic") == F.col("_own"))
    reach = own.groupBy("topic").agg(F.min(F.round("cosine", 6)).alias("reach"))
    return TopicModel(group, space, pca, found.select(key, "topic", "probability").unionByName(rest),
                      cut_lineage(centroids.select("topic", "centroid").join(reach, "topic", "left")))


def fit_topics(docs: DataFrame, params: Params = DEFAULT, key: str = "doc_id") -> list[TopicModel]:
    """One model per model group (one in all, or one per accepted language)."""
    grouped = with_model_group(docs, params)
    groups = ["all"] if params.strategy == "unified" else sorted(params.accepted_languages)
    return [fit_group(grouped.filter(F.col("model_group") == g), g, params, key) for g in groups]


def assigned(models: list[TopicModel]) -> DataFrame:
    """``(model_group, key, topic, probability)`` of the fitted texts."""
    out = None
    for m in models:
        rows = m.assignments.select(F.lit(m.group).alias("model_group"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def transform(docs: DataFrame, model: TopicModel, params: Params = DEFAULT, key: str = "doc_id") -> DataFrame:
    """``(model_group, key, topic)`` of other texts: nearest centroid, or -1 beyond its topic."""
    vectors = project(docs, model.space, params, key)
    none = vectors.select(F.lit(model.group).alias("model_group"), key, F.lit(-1).alias("topic"))
    if model.pca is None:
        return none
    reduced = cut_lineage(_reduced(vectors.filter("embedding is not null"), model.pca, key))
    near = clustering.nearest_centroid(reduced, model.centroids.select("topic", "centroid"), key, "embedding")
    found = vectors.select(key).join(near, key, "left").join(model.centroids.select("topic", "reach"), "topic", "left")
    ok = F.round("cosine", 6) >= F.least(F.lit(params.eps_reduced), "reach")
    return found.select(F.lit(model.group).alias("model_group"), key,
                        F.when(ok, F.col("topic")).otherwise(-1).alias("topic"))
