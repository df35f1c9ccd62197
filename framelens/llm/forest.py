"""Operator 8: embedding near duplicates by a random-projection tree forest.

Each tree splits the vectors again and again by a random direction at the
median of a node, with spill: a vector within ``SPILL`` of the threshold goes
to both sides. Vectors are compared within leaves only, by exact cosine in
double precision; links of all trees are united. Medians come from a bounded,
documented sample (``FIT_ROWS`` vectors); nodes below the sample use the
median of their level. Every vector is routed and compared.

Equal vectors of a label are one class with a multiplicity. A leaf of more
than ``BLOCK`` vectors is cut into chunks and compared chunk by chunk, each
pair of chunks a group of its own, so a dense leaf spreads over many tasks. A
pair that meets in several leaves counts in the first one only, which each
group can tell from the leaves its rows carry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clustering import connected_components
from ..session import cut_lineage

LEAST = 0.98
TREES = 4
LEAF = 256
SPILL = 0.0125
BLOCK = 512
FIT_ROWS = 4096


class Forest:
    """Directions per tree and level; thresholds per node, or per level below the sample."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11):
        draw = np.random.default_rng(seed)
        width = sample.shape[1] if sample.ndim == 2 and len(sample) else 1
        unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300) if len(sample) else sample
        self.depth, self.directions, self.levels, self.nodes = depth, [], [], []
        for _ in range(trees):
            way = draw.normal(size=(depth, width))
            way /= np.linalg.norm(way, axis=1, keepdims=True)
            shadow = unit @ way.T if len(sample) else np.zeros((0, depth))
            code, nodes = np.ones(len(shadow), np.int64), {}
            for level in range(depth):
                for node in np.unique(code):
                    inside = shadow[code == node, level]
                    if len(inside) >= 8:
                        nodes[int(node)] = float(np.median(inside))
                cut = np.array([nodes.get(int(c), 0.0) for c in code])
                code = 2 * code + (shadow[:, level] >= cut)
            self.directions.append(way)
            self.levels.append(np.median(shadow, axis=0) if len(shadow) else np.zeros(depth))
            known = np.array(sorted(nodes), dtype=np.int64)
            self.nodes.append((known, np.array([nodes[int(k)] for k in known])))

    def leaves(self, unit: np.ndarray, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` of unit vectors; a leaf's number holds its tree."""
        rows, codes = [], []
        for tree, (way, level_cut, (known, cuts)) in enumerate(zip(self.directions, self.levels, self.nodes)):
            row, code = np.arange(len(unit)), np.ones(len(unit), np.int64)
            shadow = unit @ way.T if way.shape[1] == unit.shape[1] else np.zeros((len(unit), self.depth))
            for level in range(self.depth):
                cut = np.full(len(code), level_cut[level])
                if len(known):
                    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    cut = np.where(known[at] == code, cuts[at], cut)
                gap = shadow[row, level] - cut
                left, right = gap < spill, gap >= -spill
                row, code = (np.concatenate([row[left], row[right]]),
                             np.concatenate([2 * code[left], 2 * code[right] + 1]))
            rows.append(row)
            codes.append(code | np.int64(tree) << np.int64(56))
        return np.concatenate(rows), np.concatenate(codes)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Float64 rows of a list array whose lists have one length."""
    flat = vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def content():
    """Column function vector -> hash, null if the vector can't be compared."""
    @F.arrow_udf("string")
    def name(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            out = []
            for v in vectors:
                row = None if not v.is_valid else v.values
                if row is None or not len(row) or row.null_count:
                    out.append(None)
                    continue
                x = row.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
                good = np.isfinite(x).all() and x.any()
                out.append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if good else None)
            yield pa.array(out, pa.string())

    return name


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _group(least: float):
    """Compare the two chunks of a group; per vector the weight of its new links and its local root."""
    def compare(batches: pa.Table) -> pa.Table:
        t = batches.combine_chunks()
        node, weight, side = (t.column(c).to_numpy() for c in ("node", "weight", "side"))
        leaf = t.column("leaf")[0].as_py()
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        x = _matrix(t.column("vec").combine_chunks())
        # equal nodes may meet twice through repeated rows; ids differ otherwise
        smaller = [np.array([c for c in codes if c < leaf], np.int64) for codes in t.column("leaves").to_pylist()]
        names = np.unique(np.concatenate(smaller)) if len(smaller) else np.zeros(0, np.int64)
        seen = np.zeros((len(x), len(names)), np.float32)
        for k, codes in enumerate(smaller):
            seen[k, np.searchsorted(names, codes)] = 1
        a = np.arange(len(x)) if same else np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        cosine = (x[a] @ x[b].T) / np.outer(_lengths(x[a]), _lengths(x[b]))
        linked = (cosine >= least) & (node[a][:, None] != node[b][None, :])
        new = linked & ((seen[a] @ seen[b].T) == 0)
        links = np.zeros(len(x), np.int64)
        links[a] += new @ weight[b]
        if not same:
            links[b] += new.T @ weight[a]
        root = node.copy()
        while True:  # smallest id reachable inside the group
            low = np.where(linked, root[b][None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            step = root.copy()
            step[a] = np.minimum(root[a], low)
            low = np.where(linked, step[a][:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
            step[b] = np.minimum(step[b], low)
            if (step == root).all():
                break
            root = step
        keep = (links > 0) | (root != node)
        return pa.table({"node": node[keep], "links": links[keep], "root": root[keep]})

    return compare


def near_duplicates(vectors: DataFrame, least: float = LEAST, trees: int = TREES, leaf: int = LEAF,
                    spill: float = SPILL, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row of (vec_id, embedding, label).

    Only vectors of one non-null label and one length are compared. Null,
    empty and zero vectors, vectors with null or non-finite components, and
    rows with a null label link with nothing and are their own component; so
    are rows with a null vec_id, whose component is null. Rows that share a
    vec_id and a vector are counted as copies. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label",
                           F.col("embedding").cast("array<double>").alias("vec"))
    ids = cut_lineage(named.select("vec_id", F.col("label").cast("string").alias("label"),
                                   F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), content()("vec"))
                                   .alias("content")))
    heads = ids.filter("content is not null").groupBy("label", "content").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    nodes = (named.select("vec_id", F.col("label").cast("string").alias("label"), "vec")
             .join(heads.withColumnRenamed("node", "vec_id"), ["vec_id", "label"]).dropDuplicates(["label", "content"])
             .select(F.col("vec_id").alias("node"), "label", F.size("vec").alias("width"), "weight",
                     F.col("vec").cast("array<float>").alias("vec") if dict(vectors.dtypes)["embedding"] ==
                     "array<float>" else "vec"))
    largest = heads.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    most, total = (largest[0] or 0, largest[1] or 0)
    depth = max(0, int(np.ceil(np.log2(max(most, 1) / leaf))))
    share = int(1_000_000 * min(1.0, FIT_ROWS / max(total, 1))) + 1
    sample = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < share).select("vec", "width").toArrow()
    widths = sample.column("width").to_numpy()
    width = int(np.bincount(widths).argmax()) if len(widths) else 1
    fit = [v.as_py() for v, w in zip(sample.column("vec"), widths) if w == width]
    shared = spark.sparkContext.broadcast(Forest(np.array(fit, dtype=np.float64).reshape(-1, width), depth, trees))

    @F.arrow_udf("array<bigint>")
    def route(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forest = shared.value
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(len(batch))]
            wide = np.array([len(v) for v in batch])
            for w in np.unique(wide):
                at = np.flatnonzero(wide == w)
                x = _matrix(batch.take(pa.array(at)))
                row, code = forest.leaves(x / _lengths(x)[:, None], spill)
                for r, c in zip(at[row].tolist(), code.tolist()):
                    out[r].append(c)
            yield pa.array(out, pa.list_(pa.int64()))

    routed = cut_lineage(nodes.withColumn("leaves", route("vec")))
    in_leaf = routed.withColumn("leaf", F.explode("leaves"))
    key = ["label", "width", "leaf"]
    large = in_leaf.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select(
        *key, F.ceil(F.col("_n") / block).cast("int").alias("_chunks"))
    chunked = (in_leaf.join(large, key, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
               .withColumn("_mine", F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int")))
    paired = chunked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    grouped = paired.select(
        *key, F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"),
        (F.col("_mine") > F.col("_other")).cast("int").alias("side"), "node", "weight", "vec", "leaves")
    found = cut_lineage(grouped.groupBy(*key, "i", "j").applyInArrow(
        _group(least), "node bigint, links bigint, root bigint"))
    label = connected_components(routed.select("node"), found.filter("node <> root").select(
        F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    found_of = heads.withColumnRenamed("label", "_label").join(label, "node").join(links, "node", "left").select(
        F.col("_label"), "content", "weight", F.col("label").alias("component"), "links")
    out = ids.join(found_of, (ids["label"] == found_of["_label"]) & (ids["content"] == found_of["content"]), "left")
    return out.select(
        "vec_id",
        F.when(F.col("weight").isNotNull(), F.col("weight") - 1 + F.coalesce("links", F.lit(0))).otherwise(
            F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
