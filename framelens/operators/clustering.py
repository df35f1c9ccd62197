"""Document vectors, reduction, the epsilon graph and density clusters.

The study reduces sentence embeddings with UMAP and clusters them with
HDBSCAN (min cluster size 5, min samples 1). With min samples 1 a point's
core distance is its nearest-neighbour distance, never above any of its
edges, so mutual reachability equals plain distance and a flat cut of the
hierarchy at a similarity ``eps`` is the connected components of the
epsilon graph. That cut is built here, as Spark jobs:

1. exact duplicate vectors collapse into one node with a multiplicity, so a
   group of copies never produces quadratic edges;
2. the epsilon graph is found exactly: nodes are dealt to hash groups, and
   one task compares two groups, block by block (numpy products). Inside a
   group nodes are ordered by pivot and distance, and by the triangle
   inequality two blocks are left out where a pivot keeps them apart. What
   is shuffled is a fixed number of copies of the nodes. Clustering needs
   only the components, so a task returns links between roots, not edges;
3. connected components by min-label propagation with pointer jumping,
   checkpointed each round into the shared checkpoint folder;
4. components smaller than ``min_cluster_size`` (counting copies) become
   outliers (-1); topics are numbered 0.. by size, then smallest id.

Documented deviations: PCA instead of UMAP (linear, not a manifold), and a
flat epsilon cut instead of HDBSCAN's stability-selected tree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..session import cut_lineage, scratch_tables


def cosine(a: str, b: str) -> Column:
    """Cosine of two array<float> columns, in double precision, native."""
    dot = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, v: acc + v)
    na = F.aggregate(F.transform(F.col(a), lambda x: x.cast("double") * x.cast("double")),
                     F.lit(0.0), lambda acc, v: acc + v)
    nb = F.aggregate(F.transform(F.col(b), lambda x: x.cast("double") * x.cast("double")),
                     F.lit(0.0), lambda acc, v: acc + v)
    return dot / (F.sqrt(na) * F.sqrt(nb))


def embed_docs(docs: DataFrame, num_features: int = 1 << 18, text_col: str = "text",
               params: Params = DEFAULT) -> DataFrame:
    """Default document vectors when no embedding is supplied: hashed TF-IDF, L2-normalised."""
    from .topics import tokenize

    toks = tokenize(docs, text_col, params)
    tf = HashingTF(inputCol="terms", outputCol="_tf", numFeatures=num_features).transform(toks)
    model = IDF(inputCol="_tf", outputCol="_tfidf").fit(tf)
    out = Normalizer(inputCol="_tfidf", outputCol="features", p=2.0).transform(model.transform(tf))
    return out.drop("_tf", "_tfidf", "terms")


def reduce_dims(vectors: DataFrame, key: str = "vec_id", col: str = "embedding",
                params: Params = DEFAULT) -> DataFrame:
    """L2-normalise, then PCA to ``n_components`` (distributed covariance)."""
    v = vectors.select(key, array_to_vector(F.col(col)).alias("_v"))
    v = Normalizer(inputCol="_v", outputCol="_n", p=2.0).transform(v)
    model = PCA(k=params.n_components, inputCol="_n", outputCol="_p").fit(v)
    return model.transform(v).select(key, vector_to_array("_p").alias("reduced"))


def collapse_copies(vectors: DataFrame, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """One node per distinct vector: ``(node, vec, weight)``; node = smallest key."""
    return (vectors.groupBy(col).agg(F.min(key).alias("node"), F.count(F.lit(1)).alias("weight"))
                   .select("node", F.col(col).alias("vec"), "weight"))


def node_members(vectors: DataFrame, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """``(key, node)``: every original row with the node of its vector."""
    nodes = vectors.groupBy(col).agg(F.min(key).alias("node"))
    return vectors.join(nodes, col).select(key, "node")


def _pick_pivots(nodes: DataFrame, n_pivots: int) -> np.ndarray:
    """A deterministic sample of ``n_pivots`` unit vectors (smallest hash of node id)."""
    rows = (nodes.filter("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
                         "and exists(vec, x -> x <> 0)")
                 .select("vec", F.xxhash64("node").alias("_h")).orderBy("_h").limit(n_pivots).collect())
    if not rows:
        return np.zeros((1, 1))
    piv = np.array([r["vec"] for r in rows], dtype=np.float64)
    return piv / np.linalg.norm(piv, axis=1, keepdims=True)


def _sorted_blocks(vecs: np.ndarray, dims: int, pivots: np.ndarray, block: int):
    """Vectors in order of (nearest pivot, distance to it): order, vectors, norms, unit vectors, and
    per block of that order the least and largest distance to every pivot."""
    x = vecs.reshape(-1, dims).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    usable = np.flatnonzero((norm > 0) & np.isfinite(norm))     # the others link with nothing
    unit = x[usable] / norm[usable][:, None]
    if not len(usable):
        return usable, x, norm, unit.astype(np.float32), np.zeros((0, 1)), np.zeros((0, 1))
    dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ pivots.T)))
    order = np.lexsort((dist.min(axis=1), dist.argmin(axis=1)))
    at, unit, dist = usable[order], unit[order], dist[order]
    cuts = np.arange(0, len(at), block)
    return (at, x, norm, unit.astype(np.float32), np.minimum.reduceat(dist, cuts, axis=0),
            np.maximum.reduceat(dist, cuts, axis=0))


def _matches(a, b, eps: float, radius: float, block: int, same: bool):
    """Yield ``(i, j, cosine)`` arrays with ``round(cosine, 6) >= eps``, one block against one block.

    Blocks are left out where the triangle inequality over a pivot keeps them
    more than the radius apart. Single precision only screens: what it lets
    through is computed again in double precision.
    """
    at, x, nx, ux, low_a, high_a = a
    bt, y, ny, uy, low_b, high_b = b
    margin = 2e-6 + 3e-7 * x.shape[1]
    for s, i0 in enumerate(range(0, len(at), block)):
        if not len(bt):
            return
        apart = np.maximum(low_b - high_a[s], low_a[s] - high_b).max(axis=1)
        for t in np.flatnonzero(apart <= radius + 1e-6):
            if same and t < s:
                continue
            j0 = t * block
            i, j = np.nonzero(ux[i0:i0 + block] @ uy[j0:j0 + block].T >= np.float32(eps - margin))
            i, j = at[i0 + i], bt[j0 + j]
            cos = np.round(np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]), 6)
            ok = cos >= eps
            if same and t == s:
                ok &= i < j
            yield i[ok], j[ok], cos[ok]


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest label reachable from every label over the links ``u - v`` (labels are positions)."""
    while True:
        step = label.copy()
        np.minimum.at(step, label[u], label[v])
        np.minimum.at(step, label[v], label[u])
        while (step[step] != step).any():
            step = step[step]
        step = step[label]
        if (step == label).all():
            return label
        label = step


def _forest(label: np.ndarray, matches, pending: int = 1 << 18) -> np.ndarray:
    """``label`` joined over all matches; links between joined ends are dropped as they come."""
    us, vs, n = [], [], 0
    for u, v in matches:
        differ = label[u] != label[v]
        us.append(u[differ])
        vs.append(v[differ])
        n += len(us[-1])
        if n >= pending:
            label, us, vs, n = _joined(label, np.concatenate(us), np.concatenate(vs)), [], [], 0
    return _joined(label, np.concatenate(us), np.concatenate(vs)) if n else label


def _strongest(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray):
    """The links of a maximum spanning forest of ``n`` positions (Boruvka rounds; ties by place)."""
    order = np.argsort(-w, kind="stable")
    u, v, w = u[order], v[order], w[order]
    label, alive, taken = np.arange(n), np.arange(len(u)), []
    while len(alive):
        best = np.full(n, len(u))
        np.minimum.at(best, label[u[alive]], alive)
        np.minimum.at(best, label[v[alive]], alive)
        chosen = np.unique(best[best < len(u)])
        taken.append(chosen)
        label = _joined(label, u[chosen], v[chosen])
        alive = alive[label[u[alive]] != label[v[alive]]]
    keep = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    return u[keep], v[keep], w[keep]


class _Pair:
    """Two groups of nodes (or one with itself) as blocks, for :func:`_matches`."""

    def __init__(self, ids, vecs, oids, ovecs, pivots: np.ndarray, block: int, same: bool):
        self.n, self.block, self.same = len(ids), block, same
        self.ids = ids if same else np.concatenate([ids, oids])
        self.a = _sorted_blocks(vecs, len(vecs) // len(ids), pivots, block)
        self.b = self.a if same else _sorted_blocks(ovecs, len(ovecs) // len(oids), pivots, block)

    def matches(self, eps: float, radius: float):
        """``(i, j, cosine)`` with places in ``ids``."""
        for i, j, cos in _matches(self.a, self.b, eps, radius, self.block, self.same):
            yield i, j if self.same else j + self.n, cos

    def edges(self, i, j, cos) -> pd.DataFrame:
        a, b = self.ids[i], self.ids[j]
        return pd.DataFrame({"src": np.minimum(a, b), "dst": np.maximum(a, b), "cosine": cos})[a != b]


def _pairs(batches, pivots: np.ndarray, block: int):
    for pdf in batches:
        for row in pdf.itertuples():
            yield row, _Pair(row.ids, row.vecs, row.oids, row.ovecs, pivots, block, row.g == row.h)


def _radius(eps: float) -> float:
    # slack so that the rounding in the test can never drop a true edge
    return math.sqrt(max(0.0, 2.0 - 2.0 * (eps - 1e-6)))


def eps_edges(nodes: DataFrame, params: Params = DEFAULT, n_pivots: int = 32,
              block: int = 1024) -> DataFrame:
    """Undirected edges ``(src, dst, cosine)`` with src < dst and
    ``round(cosine, 6) >= eps_cosine``; exact (no candidate cap)."""
    eps = params.eps_cosine
    groups, pivots = _groups(nodes, n_pivots, block)

    def run(batches):
        for _, pair in _pairs(batches, pivots, block):
            for found in pair.matches(eps, _radius(eps)):
                yield pair.edges(*found)

    return _group_pairs(groups).mapInPandas(run, "src long, dst long, cosine double")


def eps_forest(nodes: DataFrame, params: Params = DEFAULT, n_pivots: int = 32, block: int = 1024,
               pending: int = 1 << 20) -> DataFrame:
    """Those edges of :func:`eps_edges` that a maximum spanning forest of two groups needs.

    At every threshold from ``eps_cosine`` up they have the components of all
    edges; there are fewer of them than nodes in two groups, for every pair
    of groups.
    """
    eps = params.eps_cosine
    groups, pivots = _groups(nodes, n_pivots, block)

    def run(batches):
        for _, pair in _pairs(batches, pivots, block):
            held, n = [np.zeros((3, 0))], 0
            for i, j, cos in pair.matches(eps, _radius(eps)):
                held.append(np.stack([i, j, cos]))
                n += len(i)
                if n >= pending:
                    held, n = [_reduced_links(len(pair.ids), held)], 0
            i, j, cos = _reduced_links(len(pair.ids), held)
            yield pair.edges(i.astype(np.int64), j.astype(np.int64), cos)

    return _group_pairs(groups).mapInPandas(run, "src long, dst long, cosine double")


def _reduced_links(n: int, held: list) -> np.ndarray:
    i, j, cos = np.concatenate(held, axis=1)
    return np.stack(_strongest(n, i.astype(np.int64), j.astype(np.int64), cos))


def eps_links(nodes: DataFrame, params: Params = DEFAULT, n_pivots: int = 32, block: int = 1024) -> DataFrame:
    """Links ``(src, dst)`` with the components of the epsilon graph, without its edges.

    Every group is joined in itself first; a pair of groups then links roots
    of those, so there are as many links as two groups have components.
    """
    eps = params.eps_cosine
    groups, pivots = _groups(nodes, n_pivots, block)

    def inside(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                pair = _Pair(row.ids, row.vecs, row.ids, row.vecs, pivots, block, True)
                yield pd.DataFrame({"g": [row.g], "root": [_forest(
                    np.arange(len(row.ids)), ((i, j) for i, j, _ in pair.matches(eps, _radius(eps))))]})

    def across(batches):
        for row, pair in _pairs(batches, pivots, block):
            first = np.concatenate([row.root, row.oroot + len(row.ids)])
            label = _forest(first, ((i, j) for i, j, _ in pair.matches(eps, _radius(eps))))
            moved = np.flatnonzero((first == np.arange(len(first))) & (label != first))
            yield pd.DataFrame({"src": pair.ids[label[moved]], "dst": pair.ids[moved]})

    roots = cut_lineage(groups.mapInPandas(inside, "g int, root array<long>"))
    rooted = groups.join(roots, "g")
    own = (rooted.select("ids", F.explode(F.arrays_zip("ids", "root")).alias("z"))
           .select(F.get("ids", F.col("z.root").cast("int")).alias("src"), F.col("z.ids").alias("dst")))
    pairs = _group_pairs(rooted).filter("g < h").mapInPandas(across, "src long, dst long")
    return own.unionByName(pairs).filter("src <> dst")


GROUPS, GROUP_ROWS = 16, 1 << 16


def _groups(nodes: DataFrame, n_pivots: int, block: int) -> tuple[DataFrame, np.ndarray]:
    """``(g, ids, vecs)``: nodes in hash groups, vectors end to end; and the pivots.

    There are ``GROUPS`` groups, more where they would hold over
    ``GROUP_ROWS`` nodes and fewer where they would not fill a block.
    """
    usable = cut_lineage(nodes.select("node", "vec").filter("node is not null and vec is not null and size(vec) > 0"))
    n = usable.count()
    n_groups = max(1, min(GROUPS, -(-n // block)), -(-n // GROUP_ROWS))
    packed = (usable.groupBy(F.pmod(F.xxhash64("node"), F.lit(n_groups)).cast("int").alias("g"))
              .agg(F.collect_list(F.struct("node", "vec")).alias("_b"))
              .select("g", F.col("_b.node").alias("ids"), F.flatten("_b.vec").alias("vecs")))
    return cut_lineage(packed), _pick_pivots(usable, n_pivots)


def _group_pairs(groups: DataFrame) -> DataFrame:
    """``(g, h, ids, vecs, oids, ovecs, ...)``: every two groups once, and each with itself.

    A group goes to as many pairs as there are groups, so what is shuffled is
    ``GROUPS`` times the nodes, up to ``GROUPS * GROUP_ROWS`` of them. A task
    holds two groups, compares them block by block and yields as it goes.
    """
    n_groups = groups.agg(F.max("g")).first()[0]
    n_groups = 0 if n_groups is None else n_groups
    first = groups.withColumn("h", F.explode(F.sequence(F.col("g"), F.lit(n_groups))))
    other = groups.select(F.col("g").alias("h"), *[F.col(c).alias("o" + c) for c in groups.columns if c != "g"],
                          F.explode(F.sequence(F.lit(0), F.col("g"))).alias("g"))
    return first.join(other, ["g", "h"])


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(node, label)``: label = smallest node id of the node's component.

    Min-label propagation over both edge directions, then pointer jumping
    (label <- label of label); each round is written to the shared folder. Runs to
    convergence; ``max_rounds`` only turns a runaway loop into an error, it
    never returns unconverged labels.
    """
    # reread tables: a checkpoint hands the plan's constraints on, which multiply from round to round
    with scratch_tables(nodes.sparkSession) as keep:
        both = keep(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = keep(nodes.select("node", F.col("node").alias("label")))
        # labels only ever decrease, so "some label changed" == "the sum dropped"
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        for _ in range(max_rounds):
            offers = (both.join(labels.withColumnRenamed("node", "b"), "b")
                          .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer")))
            step = keep(labels.join(offers, "node", "left")
                        .select("node", F.least("label", F.coalesce("offer", "label")).alias("label")))
            jumped = (step.alias("s").join(step.alias("t"), F.col("s.label") == F.col("t.node"), "left")
                          .select(F.col("s.node").alias("node"),
                                  F.least(F.col("s.label"), F.coalesce(F.col("t.label"), F.col("s.label")))
                                  .alias("label")))
            labels = keep(jumped)
            new_total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
            if new_total == total:
                return cut_lineage(labels)
            total = new_total
    raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")


def density_clusters(vectors: DataFrame, key: str = "vec_id", col: str = "embedding",
                     params: Params = DEFAULT) -> DataFrame:
    """``(key, topic)``: epsilon-graph components of at least ``min_cluster_size``
    rows, numbered 0.. by size (desc) then smallest id; others are -1."""
    nodes = cut_lineage(collapse_copies(vectors, key, col))
    labels = connected_components(nodes.select("node"), eps_links(nodes, params))
    weighted = labels.join(nodes.select("node", "weight"), "node")
    sizes = weighted.groupBy("label").agg(F.sum("weight").alias("size"))
    big = sizes.filter(F.col("size") >= params.min_cluster_size)
    numbered = rank_by_size(big)
    node_topic = (labels.join(numbered.select("label", "topic"), "label", "left")
                        .select("node", F.coalesce("topic", F.lit(-1)).alias("topic")))
    return node_members(vectors, key, col).join(node_topic, "node").select(key, "topic")


def rank_by_size(components: DataFrame, bucket_width: int = 1 << 20) -> DataFrame:
    """``topic`` = 0-based position in (size desc, label asc) order, exactly.

    Ranked inside (size, label bucket) groups, then shifted by the number of
    components in earlier groups; only the small (size, bucket) count table
    is ordered globally, so no task receives all components.
    """
    df = components.withColumn("_b", F.floor(F.col("label") / bucket_width))
    local = F.row_number().over(Window.partitionBy("size", "_b").orderBy("label"))
    counts = df.groupBy("size", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy(F.col("size").desc(), F.col("_b"))
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return (df.withColumn("_local", local).join(before, ["size", "_b"])
              .select("label", "size", (F.col("_local") + F.col("_before") - 1).cast("int")
                      .alias("topic")))


def topic_centroids(vectors: DataFrame, assignment: DataFrame, key: str = "vec_id",
                    col: str = "embedding") -> DataFrame:
    """``(topic, centroid)``: mean unit vector of each non-outlier topic."""
    unit = F.transform(F.col(col), lambda x: x.cast("double") / F.sqrt(F.aggregate(
        F.transform(F.col(col), lambda y: y.cast("double") * y.cast("double")), F.lit(0.0),
        lambda a, v: a + v)))
    v = (vectors.join(assignment.filter(F.col("topic") != -1), key)
                .select("topic", F.posexplode(unit).alias("i", "x")))
    per_dim = v.groupBy("topic", "i").agg(F.avg("x").alias("x"))
    return (per_dim.groupBy("topic")
                   .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_c"))
                   .select("topic", F.transform("_c", lambda s: s["x"]).alias("centroid")))


def _against_centroids(vectors: DataFrame, cents: DataFrame, body, schema: str, key: str, col: str,
                       block: int = 256, topics_per_block: int = 1024, salts: int = 64) -> DataFrame:
    """``body`` over every (vector chunk, centroid block) pair, one numpy product each.

    Vectors come in hash chunks of about ``block`` rows, centroids in blocks
    of ``topics_per_block``; each block is copied to ``salts`` keys, so a
    block is never one reducer's key. Nothing is read by the driver but the
    row count and the largest topic number. ``vectors`` may carry ``topic``, any
    number that the body takes per row.
    """
    size = vectors.agg(F.count(F.lit(1))).first()[0]
    last = cents.agg(F.max("topic")).first()[0]
    n_blocks = 0 if last is None else last // topics_per_block + 1
    own = F.col("topic") if "topic" in vectors.columns else F.lit(-1)
    chunk = F.pmod(F.xxhash64(key), F.lit(max(1, -(-size // block))))
    chunks = (vectors.select(F.col(key).alias("_key"), own.alias("_own"), F.col(col).alias("_vec"), chunk.alias("_chunk"))
                     .groupBy("_chunk").agg(F.collect_list(F.struct("_key", "_own", "_vec")).alias("_v"))
                     .withColumn("_salt", F.col("_chunk") % salts)
                     .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)) if n_blocks
                                                   else F.array().cast("array<int>"))))
    blocks = (cents.groupBy(F.floor(F.col("topic") / topics_per_block).cast("int").alias("_blk"))
                   .agg(F.collect_list(F.struct("topic", "centroid")).alias("_c"))
                   .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))))
    pairs = chunks.join(blocks, ["_blk", "_salt"]).select(
        F.col("_v._key").alias("ids"), F.col("_v._own").alias("own"), F.col("_v._vec").alias("vecs"),
        F.col("_c.topic").alias("tids"), F.col("_c.centroid").alias("cents"))

    def unit(rows):
        x = np.stack(rows).astype(np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1.0, n)

    def run(batches):
        for pdf in batches:
            for ids, own_, vecs, tids, cs in zip(pdf["ids"], pdf["own"], pdf["vecs"], pdf["tids"], pdf["cents"]):
                # cosines lie in [-1, 1], so the softmax needs no shift
                yield body(np.asarray(ids), np.asarray(own_), np.asarray(tids), np.exp(unit(vecs) @ unit(cs).T))

    return pairs.mapInPandas(run, schema)


def topic_probability(vectors: DataFrame, assignment: DataFrame, key: str = "vec_id",
                      col: str = "embedding") -> DataFrame:
    """Long ``(key, topic, probability)``: softmax over topics of the cosine of
    each vector to each topic centroid (all topics, as the study requests).

    The full matrix has vectors x topics rows; :func:`assign_topics` gives the
    assigned topic's probability alone, without it. No topics: no rows.
    """
    def sums(ids, own, tids, e):
        return pd.DataFrame({key: ids, "total": e.sum(axis=1)})

    def all_topics(ids, own, tids, e):
        return pd.DataFrame({key: np.repeat(ids, len(tids)), "topic": np.tile(tids, len(ids)),
                             "probability": (e / own[:, None]).reshape(-1)})

    # the sums first, one row per vector and centroid block: the matrix itself is never shuffled
    cents = cut_lineage(topic_centroids(vectors, assignment, key, col))
    rows = vectors.select(key, col)
    totals = (_against_centroids(rows, cents, sums, f"{key} long, total double", key, col)
              .groupBy(key).agg(F.sum("total").alias("topic")))
    return _against_centroids(rows.join(cut_lineage(totals), key), cents, all_topics,
                              f"{key} long, topic int, probability double", key, col)


def assign_topics(vectors: DataFrame, key: str = "vec_id", col: str = "embedding",
                  params: Params = DEFAULT) -> DataFrame:
    """``(model_group, key, topic, probability)``: cluster and its membership strength
    (0 for outliers)."""
    topics = cut_lineage(density_clusters(vectors, key, col, params))
    cents = cut_lineage(topic_centroids(vectors, topics, key, col))

    def own_topic(ids, own, tids, e):
        hit = own[:, None] == tids[None, :]
        return pd.DataFrame({key: ids, "own": np.where(hit, e, 0.0).sum(axis=1), "total": e.sum(axis=1)})

    members = vectors.select(key, col).join(topics.filter(F.col("topic") != -1), key)
    prob = (_against_centroids(members, cents, own_topic, f"{key} long, own double, total double", key, col)
            .groupBy(key).agg((F.sum("own") / F.sum("total")).alias("probability")))
    return (topics.join(prob, key, "left")
                  .select(F.lit("all").alias("model_group"), key, "topic",
                          F.coalesce("probability", F.lit(0.0)).alias("probability")))


def nearest_centroid(vectors: DataFrame, cents: DataFrame, key: str = "vec_id",
                     col: str = "embedding") -> DataFrame:
    """``(key, topic, cosine)`` of the most similar centroid (ties: the smaller topic)."""
    def best(ids, own, tids, e):
        order = np.argsort(tids, kind="stable")
        at = e[:, order].argmax(axis=1)
        return pd.DataFrame({key: ids, "topic": np.asarray(tids)[order][at],
                             "cosine": np.log(e[np.arange(len(ids)), order[at]])})

    rows = _against_centroids(vectors.select(key, col), cents, best, f"{key} long, topic int, cosine double", key, col)
    return (rows.groupBy(key).agg(F.max(F.struct("cosine", (-F.col("topic")).alias("_t"))).alias("_b"))
                .select(key, (-F.col("_b._t")).alias("topic"), F.col("_b.cosine").alias("cosine")))


def stable_clusters(vectors: DataFrame, key: str = "vec_id", col: str = "embedding",
                    params: Params = DEFAULT, levels: int = 8) -> DataFrame:
    """``(key, topic)`` by stability selection over several epsilon levels.

    The second step of the density clustering: components of the epsilon
    graph are computed at ``levels`` similarity thresholds from ``eps_cosine``
    up to the largest edge similarity. Clusters (components of at least
    ``min_cluster_size``) form a tree by containment; a cluster with a single
    child cluster continues as the same cluster (points fall off), two or
    more children are a split. A cluster's stability is the sum over the
    levels it lives through of its size times the level step. Going up from
    the tightest level, a cluster is kept when its stability is at least the
    summed value of its descendants (excess of mass); the kept clusters
    nearest to the roots label all their points, others are -1.

    Every table in the loops has one row per cluster and level; the loops run
    over levels, not over rows.
    """
    spark = vectors.sparkSession
    eps = params.eps_cosine
    nodes = cut_lineage(collapse_copies(vectors, key, col))
    edges = cut_lineage(eps_forest(nodes, params))
    top = edges.agg(F.max("cosine")).first()[0]
    members = node_members(vectors, key, col)
    if top is None:
        return members.select(key, F.lit(-1).alias("topic"))
    lam = [eps + j * (top - eps) / levels for j in range(levels)] + [top]
    # all levels in one search: a node has a vertex per level, an edge joins those up to its own level
    held = F.array(*[F.when(F.col("cosine") >= lam[j], F.lit(j)) for j in range(levels)])
    vertex = lambda c: (F.col(c) * levels + F.col("level")).alias(c)                     # noqa: E731
    everywhere = nodes.select("node", F.explode(F.array(*[F.lit(j) for j in range(levels)])).alias("level"))
    found = connected_components(
        everywhere.select(vertex("node")),
        edges.select("src", "dst", F.explode(F.array_compact(held)).alias("level")).select(vertex("src"), vertex("dst")))
    level = F.pmod("node", F.lit(levels))
    labels = cut_lineage(found.select(F.floor((F.col("node") - level) / levels).cast("long").alias("node"),
                                      F.floor((F.col("label") - level) / levels).cast("long").alias("label"),
                                      level.cast("int").alias("level")))                 # (node, label, level)
    steps = spark.createDataFrame([(j, float(lam[j + 1] - lam[j])) for j in range(levels)],
                                  "level int, dlam double")
    clusters = cut_lineage(
        labels.join(nodes.select("node", "weight"), "node")
              .groupBy("level", "label").agg(F.sum("weight").alias("size"))
              .filter(F.col("size") >= params.min_cluster_size)
              .join(steps, "level")
              .withColumn("stab", F.col("size") * F.col("dlam")).drop("dlam"))
    up = labels.select(F.col("level").alias("plevel"), F.col("node").alias("label"),
                       F.col("label").alias("parent"))
    linked = (clusters.withColumn("plevel", F.col("level") - 1)
                      .join(up, ["plevel", "label"], "left"))        # parent label at level-1
    nchild = (linked.filter(F.col("parent").isNotNull())
                    .groupBy("plevel", "parent").agg(F.count(F.lit(1)).alias("nchild")))
    linked = cut_lineage(linked.join(
        nchild.select(F.col("plevel").alias("_pl"), F.col("parent").alias("_p"), "nchild"),
        (F.col("plevel") == F.col("_pl")) & (F.col("parent") == F.col("_p")), "left")
        .drop("_pl", "_p"))
    # chain ids: a lone child continues its parent's chain
    chain = linked.filter(F.col("level") == 0).select(
        "level", "label", F.struct(F.col("level"), F.col("label")).alias("chain"))
    for j in range(1, levels):
        prev = chain.filter(F.col("level") == j - 1).select(
            F.col("label").alias("parent"), F.col("chain").alias("pchain"))
        cur = (linked.filter(F.col("level") == j).join(prev, "parent", "left")
                     .select("level", "label",
                             F.when((F.col("nchild") == 1) & F.col("pchain").isNotNull(),
                                    F.col("pchain"))
                              .otherwise(F.struct(F.col("level"), F.col("label"))).alias("chain")))
        chain = cut_lineage(chain.unionByName(cur))
    nodes_c = linked.join(chain, ["level", "label"])
    chains = nodes_c.groupBy("chain").agg(F.sum("stab").alias("stab"))
    births = nodes_c.filter(F.struct("level", "label") == F.col("chain"))
    pchain_of = chain.select(F.col("level").alias("plevel"), F.col("label").alias("parent"),
                             F.col("chain").alias("pchain"))
    tree = cut_lineage(births.join(pchain_of, ["plevel", "parent"], "left")
                             .select("chain", F.col("size").alias("birth_size"), "pchain")
                             .join(chains, "chain"))
    # excess of mass, bottom-up by birth level
    value = None
    for j in range(levels - 1, -1, -1):
        here = tree.filter(F.col("chain.level") == j)
        if value is not None:
            kids = value.groupBy(F.col("pchain").alias("chain")).agg(F.sum("value").alias("kids"))
            here = here.join(kids, "chain", "left")
        else:
            here = here.withColumn("kids", F.lit(None).cast("double"))
        here = here.select("chain", "pchain", "birth_size", "stab",
                           (F.col("stab") >= F.coalesce("kids", F.lit(0.0))).alias("keep"),
                           F.greatest("stab", F.coalesce("kids", F.lit(0.0))).alias("value"))
        value = here if value is None else cut_lineage(value.unionByName(here))
    # top-down: a kept chain under a kept ancestor is absorbed by the ancestor
    chosen = None
    frontier_blocked = None
    for j in range(levels):
        here = value.filter(F.col("chain.level") == j)
        if frontier_blocked is not None:
            here = here.join(frontier_blocked, "pchain", "left")
        else:
            here = here.withColumn("pblocked", F.lit(False))
        here = here.withColumn("pblocked", F.coalesce("pblocked", F.lit(False)))
        sel = here.withColumn("final", F.col("keep") & ~F.col("pblocked"))
        blocked = sel.select(F.col("chain").alias("pchain"),
                             (F.col("pblocked") | F.col("final")).alias("pblocked"))
        frontier_blocked = blocked if frontier_blocked is None else cut_lineage(
            frontier_blocked.unionByName(blocked))
        picked = sel.filter("final").select("chain", "birth_size")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    cid = F.col("chain.label") * levels + F.col("chain.level")     # numeric chain id
    numbered = rank_by_size(chosen.select(cid.alias("label"), F.col("birth_size").alias("size")))
    point = (labels.withColumn("cid", F.col("label") * levels + F.col("level"))
                   .join(numbered.select(F.col("label").alias("cid"), "topic"), "cid")
                   .select("node", "topic"))
    return (members.join(point, "node", "left")
                   .select(key, F.coalesce("topic", F.lit(-1)).alias("topic")))
