"""Non-linear reduction: eigenvectors of the neighbour graph, by block iteration on packed parts.

The graph is the fuzzy neighbour graph of the UMAP paper: each distinct
vector asks its k nearest others, weights fall from 1 at the nearest with a
scale that makes them sum to log2(k), and two one-way weights a and b join to
``a + b - ab``. The coordinates are the leading eigenvectors of the
normalised adjacency ``D^-1/2 W D^-1/2`` other than the trivial one, divided
by the root of the degree (the paper's first layout; its force-directed
refinement, a sequence of random single-edge moves, is not run).

A round applies the matrix a few times (each one pass of array products over
the edges, packed by part, ``dims + extra`` columns wide), then takes the best
vectors in the span of everything applied so far. That choice needs inner products alone: a
square of at most ``(hops + 2) * (dims + extra)`` numbers, added up from one
partial per task. Nothing in proportion to the nodes reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..session import cut_lineage, scratch_tables, shuffles_released
from .neighbours import build_index, node_lists, nodes_of

BLOCK = "part int, x binary"
SMALL_PART, PART_NODES = 1 << 10, 1 << 16       # nodes of a part: so many at least while cores are left, and at most
RANK_CUT = 1e-10        # directions of the span below this share of its largest are dropped


@dataclass(frozen=True)
class Spectral:
    """``coords`` is ``(key, reduced)``; residuals are ``|Nu - value u|`` of the unit eigenvectors."""
    coords: DataFrame
    values: np.ndarray
    residuals: np.ndarray


def _fuzzy(k: int):
    """mapInPandas body: the nodes' distances to one-way weights (scale by bisection, all nodes of a batch at once)."""
    target = math.log2(max(k, 2))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sizes = np.array([len(d) for d in pdf["dist"]])
            held = np.arange(sizes.max()) < sizes[:, None]
            d = np.full(held.shape, np.inf)                                 # weight 0 beyond a short list
            d[held] = np.concatenate(pdf["dist"].to_numpy())
            d -= d.min(axis=1, keepdims=True)
            low = np.zeros((len(d), 1))
            high = np.maximum(np.where(held, d, 0.0).max(axis=1, keepdims=True), 1e-12) * 64
            for _ in range(64):
                mid = (low + high) / 2
                less = np.exp(-d / mid).sum(axis=1, keepdims=True) < target
                low, high = np.where(less, mid, low), np.where(less, high, mid)
            yield pd.DataFrame({"src": np.repeat(pdf["node"].to_numpy(), sizes),
                                "dst": np.concatenate(pdf["others"].to_numpy()).astype(np.int64), "w": np.exp(-d / high)[held]})
    return run


def fuzzy_graph(nodes: DataFrame, k: int, cosine: bool, n_pivots: int = 64, block: int = 256) -> DataFrame:
    """``(src, dst, w)``, both ways, of distinct vectors ``(node, vec)``; no self links."""
    own = nodes.select("node", "vec", F.array("node").alias("extra"))
    lists = node_lists(build_index(own, n_pivots, block), k + 1, cosine).filter("node <> other")
    per_node = (lists.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("dist", "other"))).alias("_l"))
                .select("node", F.slice("_l", 1, k).alias("_l")))           # k entries at most
    one_way = (per_node.select("node", F.col("_l.other").alias("others"), F.col("_l.dist").alias("dist"))
               .mapInPandas(_fuzzy(k), "src long, dst long, w double"))
    both = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    # one or two one-way weights per ordered pair
    return both.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count("w") > 1, F.min("w") * F.max("w"))
                                           .otherwise(0.0)).alias("w"))


class Parts:
    """A graph and vectors over its nodes, both cut by part: a hop is a product of arrays, not a join of edges.

    Nodes are dealt to parts by hash and numbered inside them. A vector block
    is one row ``(part, x)`` per part; the edges are one row per part and part
    of the other ends. In a hop the blocks of all parts pass by each part one
    at a time, each after its edges, so a task holds its own sums, one block
    and its edges to it.
    """

    def __init__(self, keep, edges: DataFrame, degree: DataFrame, count: int, total: float, cols: int, seed: int):
        self.keep = keep
        cores = edges.sparkSession.sparkContext.defaultParallelism
        self.n = max(min(cores, -(-count // SMALL_PART)), -(-count // PART_NODES))
        part = F.pmod(F.xxhash64("node"), F.lit(self.n)).cast("int")
        order = F.row_number().over(Window.partitionBy("part").orderBy("node"))        # PART_NODES rows, about
        index = keep(degree.select("node", F.sqrt("degree").alias("root"), part.alias("part")).withColumn(
            "pos", (order - 1).cast("int")))
        start = [(F.xxhash64("node", F.lit(seed), F.lit(c)) / F.lit(2.0 ** 63)) for c in range(cols)]
        rows = F.sort_array(F.collect_list(F.struct("pos", "node", "root", F.array(*start).alias("s"))))
        self.base = keep(index.groupBy("part").agg(rows.alias("_r")).select(
            "part", F.col("_r.node").alias("node"), F.col("_r.root").alias("root"), F.flatten("_r.s").alias("s")))
        self.q = self._bytes("root", 1 / math.sqrt(total))
        self.start = self._bytes("s", 1.0)
        src, dst = index.toDF("src", "_a", "part", "_i"), index.toDF("dst", "_b", "other", "_j")
        cell = F.sort_array(F.collect_list(F.struct("_i", "_j", (F.col("w") / (F.col("_a") * F.col("_b"))).alias("w"))))
        sizes = index.groupBy("part").agg(F.count(F.lit(1)).alias("size"))                # n rows
        self.edges = keep(edges.join(src, "src").join(dst, "dst").groupBy("part", "other").agg(cell.alias("_e"))
                          .join(F.broadcast(sizes), "part")
                          .select("part", "other", "size", F.col("_e._i").alias("i"), F.col("_e._j").alias("j"),
                                  F.col("_e.w").alias("w")))

    def _bytes(self, col: str, factor: float) -> DataFrame:
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    x = batch.column(1)[i].values.to_numpy(zero_copy_only=False) * factor
                    yield _block(batch.column(0)[i].as_py(), x)
        return self.keep(self.base.select("part", col).mapInArrow(run, BLOCK))

    def hop(self, x: DataFrame, cols: int) -> DataFrame:
        """The product of the normalised adjacency with a block of ``cols`` vectors."""
        none = [F.lit(None).cast(t).alias(c) for c, t in (("i", "array<int>"), ("j", "array<int>"), ("w", "array<double>"))]
        blocks = x.select(F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))).alias("part"), F.col("part").alias("other"),
                          F.lit(1).alias("kind"), F.lit(0).cast("long").alias("size"), *none, "x")
        edges = self.edges.select("part", "other", F.lit(0).alias("kind"), "size", "i", "j", "w",
                                  F.lit(None).cast("binary").alias("x"))
        rows = edges.unionByName(blocks).repartitionById(self.n, F.col("part")).sortWithinPartitions("part", "other", "kind")

        def run(batches):
            part, total, held = None, None, None
            for batch in batches:
                for r in range(batch.num_rows):
                    own, other, kind, size = (batch.column(c)[r].as_py() for c in range(4))
                    if own != part:
                        if total is not None:
                            yield _block(part, total)
                        part, total, held = own, None, None
                    if kind == 0:
                        if total is None:
                            total = np.zeros((size, cols))
                        held = other, *(batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (4, 5, 6))
                    elif held is not None and held[0] == other:
                        _, i, j, w = held
                        x = np.frombuffer(batch.column(7)[r].as_buffer()).reshape(-1, cols)
                        first = np.flatnonzero(np.diff(i, prepend=-1))                  # entries are ordered by i
                        total[i[first]] += np.add.reduceat(w[:, None] * x[j], first, axis=0)
            if total is not None:
                yield _block(part, total)
        return self.keep(rows.mapInArrow(run, BLOCK))

    def _together(self, blocks: list[DataFrame], body, schema: str) -> DataFrame:
        """``body`` over ``(part, all vectors of the blocks side by side, trivial vector)``, part by part."""
        rows = self.q.select("part", F.lit(-1).alias("i"), "x")
        for i, x in enumerate(blocks):
            rows = rows.unionByName(x.select("part", F.lit(i).alias("i"), "x"))
        last = len(blocks) - 1

        def run(batches):
            held = []
            for batch in batches:
                for r in range(batch.num_rows):
                    held.append(np.frombuffer(batch.column(2)[r].as_py()))
                    if batch.column(1)[r].as_py() == last:
                        q = held[0]
                        yield from body(batch.column(0)[r].as_py(), np.hstack([x.reshape(len(q), -1) for x in held[1:]]), q)
                        held = []
        return rows.repartitionById(self.n, F.col("part")).sortWithinPartitions("part", "i").mapInArrow(run, schema)

    def gram(self, blocks: list[DataFrame]) -> np.ndarray:
        """Inner products of all vectors of the blocks, with the trivial vector as the last."""
        def body(_, s, q):
            x = np.column_stack([s, q])
            yield pa.RecordBatch.from_arrays([pa.array([(x.T @ x).ravel().tolist()], pa.list_(pa.float64()))], ["g"])

        with shuffles_released(self.q.sparkSession):
            cells = (self._together(blocks, body, "g array<double>").select(F.posexplode("g").alias("i", "v"))
                     .groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect())     # (all vectors + 1)^2 numbers
        width = math.isqrt(len(cells))
        return np.array([r["v"] for r in cells]).reshape(width, width)

    def combined(self, blocks: list[DataFrame], y: np.ndarray, share: np.ndarray) -> DataFrame:
        def body(part, s, q):
            yield _block(part, s[:, :len(y)] @ y - np.outer(q, share))
        return self.keep(self._together(blocks, body, BLOCK))

    def rows(self, x: DataFrame, cols: int) -> DataFrame:
        """``(node, s, root)`` of a block of vectors."""
        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    node, root = (batch.column(c)[r].values for c in (0, 1))
                    s = pa.array(np.frombuffer(batch.column(2)[r].as_buffer()))
                    ends = pa.array(np.arange(len(node) + 1, dtype=np.int32) * cols)
                    yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(ends, s), root], ["node", "s", "root"])
        return self.keep(self.base.join(x, "part").select("node", "root", "x").mapInArrow(
            run, "node long, s array<double>, root double"))


def _block(part: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "x"])


def _best_vectors(g: np.ndarray, cols: int):
    """Leading Ritz vectors of the span: coefficients, values, residuals, share of the trivial vector."""
    lead = g[:-1, -1]
    clean = g[:-1, :-1] - np.outer(lead, lead)          # the trivial vector projected out
    m = len(clean) - cols
    inner, image = clean[:m, :m], clean[:m, cols:]
    size, axes = np.linalg.eigh(inner)
    axes = axes[:, size > RANK_CUT * size[-1]] / np.sqrt(size[size > RANK_CUT * size[-1]])
    small = axes.T @ image @ axes
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, y = values[::-1][:cols], (axes @ turn)[:, ::-1][:, :cols]
    sq = (np.einsum("ij,ik,kj->j", y, clean[cols:, cols:], y) - 2 * values * np.einsum("ij,ik,kj->j", y, image, y)
          + values ** 2 * np.einsum("ij,ik,kj->j", y, inner, y))
    return y, values, np.sqrt(np.maximum(sq, 0.0)), lead[:m] @ y


def eigenvectors(keep, edges: DataFrame, dims: int, extra: int = 4, hops: int = 4, tolerance: float = 1e-3,
                 max_rounds: int = 60, seed: int = 42) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``(node, s, root)`` with the leading eigenvectors in ``s`` and the root of the degree; values; residuals.

    ``edges`` is a symmetric ``(src, dst, w)`` without self links. Rounds end
    when every residual is at most ``tolerance``, or after ``max_rounds``
    (the residuals then say how far the vectors are).
    """
    degree = keep(edges.groupBy("src").agg(F.sum("w").alias("degree")).withColumnRenamed("src", "node"))
    count, total = degree.agg(F.count(F.lit(1)), F.sum("degree")).first()
    cols = min(dims + extra, max(count - 1, 1))
    parts = Parts(keep, edges, degree, count, total, cols, seed)
    x = parts.start
    for _ in range(max_rounds):
        blocks = [x]
        for _ in range(hops + 1):
            blocks.append(parts.hop(blocks[-1], cols))
        y, values, residuals, share = _best_vectors(parts.gram(blocks), cols)
        x = parts.combined(blocks, y, share)
        cols = len(values)
        if (residuals[:dims] <= tolerance).all():
            break
    return parts.rows(x, cols), values[:dims], residuals[:dims]


def spectral_dims(vectors: DataFrame, key: str = "vec_id", col: str = "embedding", params: Params = DEFAULT,
                  k: int = 15, cosine: bool = True, tolerance: float = 1e-3, max_rounds: int = 60) -> Spectral:
    """Reduction to ``params.n_components`` coordinates on the graph of k nearest neighbours.

    Copies share one node and so their coordinates. Rows with a null key, or
    whose vector is null, empty, not finite or (``cosine``) zero, are left
    out. With fewer distinct vectors than coordinates the rest are 0. Keys
    are distinct whole numbers; other columns are ignored. Coordinates are
    unique up to sign, and up to a rotation where eigenvalues are equal.
    """
    dims = params.n_components
    rows = vectors.select(F.col(key), F.col(col))
    if cosine:
        norm = F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        rows = (rows.withColumn("_n", norm).filter("_n > 0")
                .select(key, F.expr(f"transform({col}, x -> double(x) / nullif(_n, 0))").alias(col)))
    nodes, members = nodes_of(rows, key, col, 1)
    flat = F.array(*[F.lit(0.0)] * dims)
    if nodes.limit(3).count() < 3:                        # no direction beside the trivial one
        return Spectral(members.select(key, flat.alias("reduced")), np.zeros(0), np.zeros(0))
    with scratch_tables(vectors.sparkSession) as keep:
        edges = keep(fuzzy_graph(nodes.select("node", "vec"), k, cosine))
        state, values, residuals = eigenvectors(keep, edges, dims, tolerance=tolerance, max_rounds=max_rounds,
                                                seed=params.seed)
        found = F.slice(F.transform("s", lambda x: x / F.col("root")), 1, dims)
        padded = F.slice(F.concat(found, flat), 1, dims)
        coords = cut_lineage(members.join(state.select("node", padded.alias("reduced")), "node")
                             .select(key, "reduced"))
    return Spectral(coords, values, residuals)
