"""Exact nearest neighbours and lightest links, block by block behind a distance index.

Distinct vectors (nodes) have a home cell, that of the nearest of P pivots,
and inside a cell they are ordered by their distance to its pivot and cut
into shells of ``block`` nodes. A query block asks a shell only if the
triangle inequality lets one of its nodes have something within reach there:
``|d(x, pivot) - d(y, pivot)| <= d(x, y)`` and, between two cells, the
distance of x to the plane halfway between their pivots. Reach is what the
node already holds (its k-th neighbour so far), so nothing is missed and no
radius is set. Asking blocks are dealt to parts; all blocks pass by each part
one at a time, so a fixed number of copies of the nodes is shuffled, a task
holds the nodes of its part and one block, and the driver sees P pivots and P
cell radii alone.

Where vectors fill many dimensions evenly the inequalities prune little and
the products approach all pairs; the reduced vectors that the topics are found
on (five dimensions) are what the index is for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .topk import top_k_per_group

SLACK = 1e-9
SPARSE = 1 / 32             # share of pairs past the screen up to which they are decided one by one


@dataclass(frozen=True)
class Index:
    """Blocks of nodes with the pivots and each cell's largest distance to its own."""
    blocks: DataFrame           # (blk, cell, lo, hi, ids, vecs, extra)
    pivots: np.ndarray
    radii: np.ndarray


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances from coordinate differences: symmetric to the last bit, zero only for equal vectors."""
    sq = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        sq += np.square(x[:, d][:, None] - y[:, d][None, :])
    return np.sqrt(sq)


def build_index(nodes: DataFrame, n_pivots: int = 64, block: int = 256) -> Index:
    """Index of ``(node, vec, extra)``; ``extra`` is an array of longs that travels with the node."""
    rows = nodes.select("vec", F.xxhash64("node").alias("_h")).orderBy("_h").limit(n_pivots).collect()
    pivots = np.array([r["vec"] for r in rows], dtype=np.float64)

    def homes(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["vec"].to_numpy()).astype(np.float64), pivots)
                yield pdf.assign(cell=d.argmin(axis=1).astype(np.int32), dp=d.min(axis=1))

    placed = cut_lineage(nodes.select("node", F.col("vec").cast("array<double>").alias("vec"), "extra").mapInPandas(
        homes, "node long, vec array<double>, extra array<long>, cell int, dp double"))
    found = {r["cell"]: r["r"] for r in placed.groupBy("cell").agg(F.max("dp").alias("r")).collect()}   # P rows
    radii = np.array([found.get(c, -np.inf) for c in range(len(pivots))])
    # position in the cell by a range partition: no task sorts a whole cell
    part = cut_lineage(placed.select("node", "cell", "dp").repartitionByRange("cell", "dp", "node")
                       .withColumn("_p", F.spark_partition_id()))
    before = (part.groupBy("cell", "_p").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("cell").orderBy("_p")) - F.col("_n")))
    local = F.row_number().over(Window.partitionBy("cell", "_p").orderBy("dp", "node"))
    shells = (part.withColumn("_r", local).join(before, ["cell", "_p"])
              .select("node", F.floor((F.col("_r") + F.col("_before") - 1) / block).alias("shell")))
    rowset = F.sort_array(F.collect_list(F.struct("node", "vec", "extra")))
    blocks = (placed.join(shells, "node").groupBy("cell", "shell")
              .agg(F.min("dp").alias("lo"), F.max("dp").alias("hi"), rowset.alias("_b"))
              .select((F.col("cell") + F.col("shell") * len(pivots)).alias("blk"), "cell", "lo", "hi",
                      F.col("_b.node").alias("ids"), F.col("_b.vec").alias("vecs"), F.col("_b.extra").alias("extra")))
    return Index(cut_lineage(blocks), pivots, radii)


PARTS, PART_NODES = 16, 1 << 16


def part_count(index: Index) -> int:
    """Tasks that ask: ``PARTS``, more where one would hold over ``PART_NODES`` nodes; whole rounds of the cores up to four times that."""
    n = index.blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    least, cores = max(PARTS, -(-n // PART_NODES)), index.blocks.sparkSession.sparkContext.defaultParallelism
    whole = -(-least // cores) * cores
    return whole if whole <= 4 * PARTS else least


def streamed(asks: DataFrame, others: DataFrame, n_parts: int) -> DataFrame:
    """Asking blocks dealt to parts, each followed by all answering blocks.

    Both are rows with ``blk`` and the same columns. A task holds the asking
    blocks of its part and sees the others one at a time, so what is
    shuffled is ``n_parts`` copies of the blocks, not one per pair of them.
    """
    part = F.pmod(F.xxhash64("blk"), F.lit(n_parts)).cast("int")
    first = asks.select(part.alias("part"), F.lit(0).alias("kind"), "*")
    rest = others.select(F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.lit(1).alias("kind"), "*")
    # only parts that ask get the others
    rest = rest.join(F.broadcast(first.select("part").distinct()), "part", "left_semi")         # n_parts rows
    return first.unionByName(rest.select(*first.columns)).repartition(n_parts, "part").sortWithinPartitions("part", "kind", "blk")


class Asking:
    """The asking nodes of a part; ``reach`` is NaN where a node asks nothing."""

    def __init__(self, vecs: np.ndarray, reach: np.ndarray, pivots: np.ndarray, radii: np.ndarray):
        self.x, self.reach = vecs, reach
        self.sq = (vecs * vecs).sum(axis=1)
        self.to = _distances(vecs, pivots)
        self.home = self.to.argmin(axis=1)
        self.between, self.radii = _distances(pivots, pivots), radii

    def open(self, cell: int, lo: float, hi: float) -> np.ndarray:
        """Nodes that may have something within reach between ``lo`` and ``hi`` of the cell's pivot."""
        d, gap = self.to[:, cell], self.between[self.home, cell]
        plane = np.where(gap > 0, (d ** 2 - self.to[np.arange(len(d)), self.home] ** 2) / np.where(gap > 0, 2 * gap, 1.0), 0.0)
        least = np.maximum(np.maximum(d - hi, lo - d), plane)
        return np.flatnonzero(least <= self.reach + 2 * SLACK)

    def near(self, rows: np.ndarray, y: np.ndarray, limit: np.ndarray):
        """``(row, place, distance)`` of all pairs within the rows' limits, distances as ``_exact`` gives them."""
        top = (y * y).sum(axis=1)
        for at in np.array_split(rows, max(1, -(-len(rows) // 4096))):
            # products screen, with room for their rounding; coordinate differences decide
            sq = self.sq[at][:, None] + top[None, :]
            screen = sq - 2.0 * (self.x[at] @ y.T) <= np.square(limit[at])[:, None] + 1e-9 * (sq + 1e-9)
            i, j = np.nonzero(screen)
            total = np.zeros(len(i))
            for c in range(y.shape[1]):
                total += np.square(self.x[at[i], c] - y[j, c])
            dist = np.sqrt(total)
            ok = dist <= limit[at[i]]
            yield at[i[ok]], j[ok], dist[ok]


def _parts(batches):
    """``(rows of a part's asking blocks, iterator over its other blocks)``, part by part, as streamed."""
    rows = (row for pdf in batches for row in pdf.itertuples(index=False))
    row = next(rows, None)
    while row is not None:
        part, mine = row.part, []
        while row is not None and row.part == part and row.kind == 0:
            mine.append(row)
            row = next(rows, None)

        def rest():
            nonlocal row
            while row is not None and row.part == part:
                yield row
                row = next(rows, None)

        others = rest()
        yield mine, others
        for _ in others:
            pass


class _Lists:
    """The k nearest rows found so far of every asking node, by (distance, row)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.dist, self.row = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, node: np.ndarray, row: np.ndarray, dist: np.ndarray) -> None:
        at = np.unique(node)
        who = np.concatenate([np.repeat(at, self.k), node])
        d = np.concatenate([self.dist[at].ravel(), dist])
        r = np.concatenate([self.row[at].ravel(), row])
        order = np.lexsort((r, d, who))
        who, d, r = who[order], d[order], r[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        self.dist[who[keep], place[keep]], self.row[who[keep], place[keep]] = d[keep], r[keep]


def _listed(index: Index, k: int, cosine: bool):
    """mapInPandas body: per asking node its k nearest rows among all blocks."""
    pivots, radii = index.pivots, index.radii

    def compare(asking: Asking, lists: _Lists, rows: np.ndarray, y: np.ndarray, members) -> None:
        sizes = np.array([len(m) for m in members])
        flat, start = np.concatenate([np.asarray(m, dtype=np.int64) for m in members]), np.cumsum(sizes) - sizes
        worst = lists.dist[:, -1]
        if cosine:
            found, slight = [], y.astype(np.float32).T
            # single precision screens, with room for its rounding on unit vectors; double precision decides
            room = 1e-6 + (y.shape[1] + 4) * 2.0 ** -23
            for at in np.array_split(rows, max(1, -(-len(rows) // 4096))):
                least = (1.0 - worst[at] - room).astype(np.float32)
                i, j = np.nonzero(asking.slight[at] @ slight >= least[:, None])
                if len(i) <= SPARSE * len(at) * len(y):
                    dot = np.einsum("ij,ij->i", asking.x[at[i]], y[j])
                    ok = 1.0 - dot <= worst[at[i]] + 1e-6
                    found.append((at[i[ok]], j[ok], 1.0 - np.round(dot[ok], 6)))
                    continue
                dot = asking.x[at] @ y.T
                i, j = np.nonzero(1.0 - dot <= worst[at][:, None] + 1e-6)
                found.append((at[i], j, 1.0 - np.round(dot[i, j], 6)))
        else:
            found = asking.near(rows, y, worst)
        for node, place, dist in found:
            ok = dist <= lists.dist[node, -1]
            node, place, dist = node[ok], place[ok], dist[ok]
            if len(node):
                n = sizes[place]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lists.add(np.repeat(node, n), flat[np.repeat(start[place], n) + inner], np.repeat(dist, n))

    def run(batches):
        for mine, others in _parts(batches):
            if not mine:
                continue
            ids = np.concatenate([np.asarray(m.ids) for m in mine])
            asking = Asking(np.concatenate([np.stack(m.vecs) for m in mine]), np.full(len(ids), np.inf), pivots, radii)
            if cosine:
                asking.slight = asking.x.astype(np.float32)
            lists, done, at = _Lists(len(ids), k), {m.blk for m in mine}, 0

            def reach():
                held = lists.dist[:, -1]
                asking.reach = np.sqrt(2.0 * (held + 2e-6)) if cosine else held

            for m in mine:                                    # a node's own block gives the first reach
                compare(asking, lists, np.arange(at, at + len(m.ids)), np.stack(m.vecs), m.extra)
                at += len(m.ids)
            at = 0
            for m in mine:
                reach()
                rest = asking.open(m.cell, m.lo, m.hi)
                rest = rest[(rest < at) | (rest >= at + len(m.ids))]
                if len(rest):
                    compare(asking, lists, rest, np.stack(m.vecs), m.extra)
                at += len(m.ids)
            for other in others:
                if other.blk in done:
                    continue
                reach()
                rows = asking.open(other.cell, other.lo, other.hi)
                if len(rows):
                    compare(asking, lists, rows, np.stack(other.vecs), other.extra)
            i, place = np.nonzero(np.isfinite(lists.dist))
            yield pd.DataFrame({"node": ids[i], "other": lists.row[i, place], "dist": lists.dist[i, place],
                                "rank": (place + 1).astype(np.int32)})
    return run


def node_lists(index: Index, k: int, cosine: bool = False) -> DataFrame:
    """``(node, other, dist, rank)``: the k nearest rows of every node, its own rows among them.

    ``extra`` of the index holds each node's smallest row ids, up to k of
    them. Ordered by distance, then row id; ``cosine`` takes unit vectors and
    orders by ``1 - round(cosine, 6)``. A task keeps the lists of its part's
    nodes while all blocks pass, so lists are never shuffled.
    """
    rows = index.blocks.select("blk", "cell", "lo", "hi", "ids", "vecs", "extra")
    return streamed(rows, rows, part_count(index)).mapInPandas(
        _listed(index, k, cosine), "node long, other long, dist double, rank int")


def nodes_of(vectors: DataFrame, key: str, col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, vec, weight, extra)`` of distinct vectors with their k smallest keys, and ``(key, node)``."""
    usable = vectors.select(F.col(key).alias("key"), F.col(col).alias("vec")).filter(
        "key is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and "
        "not isnan(x) and abs(x) < double('infinity'))")
    groups = usable.groupBy("vec").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("weight"))
    members = cut_lineage(usable.join(groups, "vec").select("key", "node"))
    few = top_k_per_group(members, ["node"], [F.col("key").asc()], k, "key")
    extra = few.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("extra"))
    nodes = groups.join(extra, "node").select("node", "vec", "weight", "extra")
    return cut_lineage(nodes), members.withColumnRenamed("key", key)


def nearest_neighbours(vectors: DataFrame, k: int = 15, key: str = "vec_id", col: str = "embedding",
                       n_pivots: int = 64, block: int = 256) -> DataFrame:
    """``(key, neighbour, cosine, rank)``: the k most similar other rows of every row, exactly.

    Similarity is the cosine rounded to 6 places, ties go to the smaller key;
    copies are neighbours of each other. Rows with a null key, or whose vector
    is null, empty, zero or not finite, neither ask nor answer. Keys are
    distinct whole numbers. Fewer than k other rows: all of them. Other
    columns are ignored.
    """
    norm = F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = (vectors.select(F.col(key), F.col(col), norm.alias("_n")).filter("_n > 0")
            .select(key, F.expr(f"transform({col}, x -> double(x) / nullif(_n, 0))").alias(col)))
    nodes, members = nodes_of(unit, key, col, k + 1)
    if nodes.isEmpty():
        return vectors.select(F.col(key), F.col(key).alias("neighbour"), F.lit(0.0).alias("cosine"),
                              F.lit(0).alias("rank")).limit(0)
    lists = node_lists(build_index(nodes, n_pivots, block), k + 1, cosine=True)
    # a row's list is its node's without the row itself
    own = F.struct((F.col("x.dist")).alias("dist"), F.col("x.other").alias("neighbour"))
    per_node = lists.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("dist", "other"))).alias("_l"))
    rows = (members.join(per_node, "node")
            .withColumn("_l", F.slice(F.filter("_l", lambda s: s["other"] != F.col(key)), 1, k))
            .select(key, F.posexplode("_l").alias("_i", "x")).select(key, "_i", own.alias("s")))
    return rows.select(key, F.col("s.neighbour").alias("neighbour"), F.round(1.0 - F.col("s.dist"), 6).alias("cosine"),
                       (F.col("_i") + 1).alias("rank"))
