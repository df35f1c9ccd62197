"""Hierarchical density clusters: spanning forest, condensed tree, stable clusters, strengths.

No distance is set by hand. The steps, all of them joins and aggregations:

1. every distinct vector (node) gets its core distance, that of its
   ``min_samples``-th other row; two nodes are as far apart as the largest of
   their distance and their core distances;
2. the minimum spanning tree by Boruvka rounds: each component takes its
   lightest link out. Neighbour lists answer where they can prove it; the
   other nodes search the blocks of the index within their component's best
   link so far. Ties are broken by the two node ids, so no round makes a
   cycle;
3. the merge tree by contraction: links that are the lightest of one of
   their ends are contracted, again and again, at most log2(n) times. Each
   link then belongs to the first contracted vertex whose lightest link is
   heavier; the links of one vertex, by weight, are one chain of the tree,
   which hangs on that lightest link. Sizes are running sums along chains;
4. a link splits its cluster if both sides hold ``min_cluster_size`` rows;
   smaller sides fall out of it. A cluster's stability sums, over its rows,
   1/distance where the row leaves less 1/distance where the cluster began.
   Clusters are chosen by excess of mass; the whole is never one;
5. a row's strength is its 1/distance of leaving over its cluster's largest.

Chains are cut into rank ranges of ``SPAN`` links for the running sums, so a
chain that holds most links is not one task's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..session import cut_lineage, scratch_tables
from .clustering import rank_by_size
from .neighbours import Asking, Index, _exact, _parts, build_index, node_lists, nodes_of, part_count, streamed

SPAN = 1 << 16
FLOOR = 1e-9                 # smallest distance a strength is taken at (copies have none)
EDGE = "src long, dst long, w double"


def _lightest(comp, w, src, dst) -> pd.DataFrame:
    """The lightest (w, smaller id, larger id) link of every component."""
    u, v = np.minimum(src, dst), np.maximum(src, dst)
    order = np.lexsort((v, u, w, comp))
    order = order[np.unique(comp[order], return_index=True)[1]]
    return pd.DataFrame({"src": src[order], "dst": dst[order], "w": w[order]})


def _cheapest(w: np.ndarray, ids, comp, oids):
    """Per row its lightest link (columns ascend by id), reduced per component."""
    at = w.argmin(axis=1)
    best = w[np.arange(len(w)), at]
    ok = np.isfinite(best)
    return _lightest(np.asarray(comp)[ok], best[ok], np.asarray(ids)[ok], np.asarray(oids)[at][ok])


def _search(pivots: np.ndarray, radii: np.ndarray, pending: int = 1 << 20):
    """mapInPandas body: per component of a part's asking nodes its lightest links within reach, block by block."""
    def run(batches):
        for mine, others in _parts(batches):
            if not mine:
                continue
            ids, core, comp, reach = (np.concatenate([np.asarray(getattr(m, c)) for m in mine])
                                      for c in ("ids", "core", "comp", "reach"))
            asking = Asking(np.concatenate([np.stack(m.vecs) for m in mine]), reach.astype(np.float64),
                            pivots, radii)
            comps, place = np.unique(comp, return_inverse=True)
            best, held, n = np.full(len(comps), np.inf), [], 0
            for other in others:
                rows = asking.open(other.cell, other.lo, other.hi)
                if not len(rows):
                    continue
                ocore, ocomp, oids = np.asarray(other.core), np.asarray(other.comp), np.asarray(other.ids)
                for i, j, dist in asking.near(rows, np.stack(other.vecs), asking.reach):
                    w = np.maximum(dist, np.maximum(core[i], ocore[j]))
                    ok = (comp[i] != ocomp[j]) & (w <= asking.reach[i])
                    i, j, w = i[ok], j[ok], w[ok]
                    np.minimum.at(best, place[i], w)
                    least = w <= best[place[i]]
                    i, j, w = i[least], j[least], w[least]
                    if len(i):
                        held.append(_lightest(comp[i], w, ids[i], oids[j]))
                        n += len(held[-1])
                        if n >= pending:
                            yield pd.concat(held)
                            held, n = [], 0
                asking.reach = np.fmin(asking.reach, np.where(np.isnan(asking.reach), np.nan, best[place]))
            if held:
                yield pd.concat(held)
    return run


def _to_pivots(pivots: pd.DataFrame):
    """Body: per component of a block its lightest link to a pivot outside it, a first bound."""
    pids, pcore, pcomp = (pivots[c].to_numpy() for c in ("node", "core", "comp"))
    pvecs = np.stack(pivots["vec"].to_numpy())

    def run(batches):
        for pdf in batches:
            out = []
            for ids, vecs, core, comp in zip(pdf["ids"], pdf["vecs"], pdf["core"], pdf["comp"]):
                w = np.maximum(_exact(np.stack(vecs), pvecs), np.maximum(np.asarray(core)[:, None], pcore[None, :]))
                w[np.asarray(comp)[:, None] == pcomp[None, :]] = np.inf
                out.append(_cheapest(w, ids, comp, pids))
            if out:
                yield pd.concat(out)
    return run


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def spanning_tree(keep, index: Index, lists: DataFrame, core: DataFrame, bound: DataFrame) -> DataFrame:
    """``(u, v, w)``: minimum spanning tree of the nodes under mutual reachability.

    ``lists`` holds known links ``(src, dst, w)``, ``core`` ``(node, core)``
    and ``bound`` ``(node, lb)``: no link of the node outside ``lists`` is
    lighter than ``lb``.
    """
    spark = index.blocks.sparkSession
    at = index.blocks.select("blk", F.posexplode("ids").alias("pos", "node"))
    state = keep(at.join(core, "node").join(bound, "node")
                        .select("node", "blk", "core", "lb", F.col("node").alias("comp")))
    pivots = (index.blocks.select(F.explode(F.arrays_zip("ids", "vecs")).alias("z")).select("z.ids", "z.vecs")
              .orderBy(F.xxhash64("ids")).limit(len(index.pivots)).toPandas())
    links = keep(_both_ways(lists).distinct())
    n_parts = part_count(index)
    tree = None
    while True:
        comps = state.select("comp").distinct()
        n = comps.count()
        if n <= 1:
            break
        packed = F.sort_array(F.collect_list(F.struct("node", "core", "comp", "lb")))
        sides = keep(state.groupBy("blk").agg(packed.alias("_s")).join(index.blocks, "blk")
                            .select("blk", "cell", "lo", "hi", "ids", "vecs", F.col("_s.core").alias("core"), F.col("_s.comp").alias("comp"),
                                    F.col("_s.lb").alias("lb")))
        ends = state.select("node", "comp")
        named = (links.join(ends.toDF("src", "comp"), "src").join(ends.toDF("dst", "mate"), "dst")
                 .filter("comp <> mate"))
        links = keep(named.select("src", "dst", "w"))
        known = named.select("comp").distinct().count()
        offers = links
        if known < n:
            ids = [int(i) for i in pivots["ids"]]                                  # P rows
            where = state.filter(F.col("node").isin(ids)).select("node", "core", "comp").toPandas()
            rows = where.merge(pivots.rename(columns={"ids": "node", "vecs": "vec"}), on="node")
            offers = offers.unionByName(_both_ways(sides.select("ids", "vecs", "core", "comp").mapInPandas(
                _to_pivots(rows), EDGE)))
        best = _best_links(offers, ends)
        reach = best.select(F.col("comp"), F.col("b.w").alias("best"))
        asks = (state.join(reach, "comp", "left").groupBy("blk")
                .agg(F.sort_array(F.collect_list(F.struct(
                    "node", F.when(F.col("best").isNull(), float("inf")).when(F.col("lb") <= F.col("best"), F.col("best"))
                    .otherwise(float("nan")).alias("reach")))).alias("_a"))
                .select("blk", F.col("_a.reach").alias("reach")))
        asking = keep(asks.filter(F.exists("reach", lambda r: ~F.isnan(r))).join(sides.drop("lb"), "blk"))
        columns = ["blk", "cell", "lo", "hi", "ids", "vecs", "core", "comp", "reach"]
        everyone = sides.withColumn("reach", F.lit(None).cast("array<double>")).select(*columns)
        found = streamed(asking.select(*columns), everyone, n_parts).mapInPandas(_search(index.pivots, index.radii), EDGE)
        best = keep(_best_links(offers.unionByName(found), ends))
        chosen = best.select("b.u", "b.v", "b.w").distinct()
        tree = chosen if tree is None else tree.unionByName(chosen)
        merged = _roots(keep, best.select(F.col("comp").alias("id"), F.col("b.mate").alias("ptr")))
        state = keep(
            state.join(best.select("comp", F.col("b.w").alias("w")), "comp")
            .join(merged.toDF("comp", "label"), "comp")
            .select("node", "blk", "core", F.greatest("lb", "w").alias("lb"), F.col("label").alias("comp")))
    if tree is None:
        return spark.createDataFrame([], "u long, v long, w double")
    return tree


def _best_links(links: DataFrame, ends: DataFrame) -> DataFrame:
    """``(comp, b)``: the lightest link out of every component."""
    return (links.join(ends.toDF("src", "comp"), "src").join(ends.toDF("dst", "mate"), "dst").filter("comp <> mate")
            .groupBy("comp").agg(F.min(F.struct("w", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"),
                                                "mate")).alias("b")))


def _ranked(keep, tree: DataFrame) -> DataFrame:
    """Links with ``r``: their place in (w, u, v) order, by a range partition."""
    part = keep(tree.repartitionByRange("w", "u", "v").withColumn("_p", F.spark_partition_id()))
    before = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))             # one row per partition
    local = F.row_number().over(Window.partitionBy("_p").orderBy("w", "u", "v"))
    return part.withColumn("_l", local).join(before, "_p").select(
        (F.col("_l") + F.col("_before") - 1).alias("r"), "u", "v", "w")


def _jump(keep, rows: DataFrame) -> DataFrame:
    """``(id, val)`` of ``(id, ptr, val)``: the first value along the pointers, null where there is none."""
    while not rows.filter("val is null and ptr is not null").isEmpty():
        to = rows.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("val").alias("_val"))
        rows = keep(rows.join(to, "ptr", "left").select(
            "id", F.when(F.col("val").isNull(), F.col("_ptr")).alias("ptr"), F.coalesce("val", "_val").alias("val")))
    return rows.select("id", "val")


def _roots(keep, steps: DataFrame) -> DataFrame:
    """``(id, root)`` of ``(id, ptr)``: where the pointers lead, the smaller id of each final pair.

    Every id points along its lightest link, so a path ends in two ids that
    point at each other; paths halve from round to round.
    """
    to = steps.select(F.col("id").alias("ptr"), F.col("ptr").alias("_next"))
    end = (F.col("_next") == F.col("id")) & (F.col("id") < F.col("ptr"))
    steps = keep(steps.join(to, "ptr").select("id", F.when(end, F.col("id")).otherwise(F.col("ptr")).alias("ptr"),
                                              F.lit(True).alias("moved")))
    while not steps.filter("moved").isEmpty():
        to = steps.select(F.col("id").alias("ptr"), F.col("ptr").alias("_next"))
        steps = keep(steps.join(to, "ptr").select("id", F.col("_next").alias("ptr"),
                                                  (F.col("_next") != F.col("ptr")).alias("moved")))
    return steps.select("id", F.col("ptr").alias("root"))


def merge_tree(keep, tree: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``(r, w, chain, size, below, hung)`` and chains ``(chain, anchor, total)``.

    A chain is named ``level:vertex``; level 0 are the nodes themselves.
    ``size`` is the rows under a link, ``below`` those of the chain's earlier
    links, ``hung`` the totals of what hangs on it.
    """
    links = keep(_ranked(keep, tree))
    now = links.select("r", F.col("u").alias("a"), F.col("v").alias("b"))
    name = lambda level, col: F.concat(F.lit(f"{level}:"), F.col(col).cast("string"))
    pending = links.select("r").limit(0).select("r", F.lit(0).cast("long").alias("s"))    # links waiting for a chain
    placed, anchors, level = None, None, 0
    vertices = keep(nodes.select(F.col("node").alias("s")))
    while True:
        ends = now.select("r", F.col("a").alias("s")).unionByName(now.select("r", F.col("b").alias("s")))
        least = keep(vertices.join(ends.groupBy("s").agg(F.min("r").alias("m")), "s", "left"))
        here = pending.join(least, "s").withColumn("in", F.col("m").isNull() | (F.col("r") < F.col("m")))
        done = here.filter("in").select("r", name(level, "s").alias("chain"))
        anchor = least.select(name(level, "s").alias("chain"), F.col("m").alias("anchor"), F.lit(level).alias("level"))
        placed = done if placed is None else placed.unionByName(done)
        anchors = anchor if anchors is None else anchors.unionByName(anchor)
        if now.isEmpty():
            break
        lows = least.select(F.col("m").alias("r")).distinct()
        cut = keep(now.join(lows, "r"))
        other = F.when(F.col("s") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        to = _roots(keep, least.join(cut, F.col("m") == F.col("r")).select(F.col("s").alias("id"), other.alias("ptr"))
                    ).toDF("s", "t")
        pending = keep(here.filter("not in").select("r", "s")
                              .unionByName(cut.select("r", F.col("a").alias("s")))
                              .join(to, "s").select("r", F.col("t").alias("s")))
        now = keep(now.join(lows, "r", "left_anti").join(to.toDF("a", "ta"), "a").join(to.toDF("b", "tb"), "b")
                          .select("r", F.col("ta").alias("a"), F.col("tb").alias("b")))
        vertices = keep(to.select(F.col("t").alias("s")).distinct())
        level += 1
    placed, anchors = keep(placed), keep(anchors)
    totals = keep(nodes.select(F.concat(F.lit("0:"), F.col("node").cast("string")).alias("chain"),
                                      F.col("weight").alias("total"))
                         .join(anchors, "chain").select("chain", "anchor", "total"))
    for at in range(1, level + 1):
        got = (anchors.filter(F.col("level") == at).join(placed, "chain")
               .join(totals.select(F.col("anchor").alias("r"), "total"), "r")
               .groupBy("chain", F.col("anchor")).agg(F.sum("total").alias("total")))
        totals = keep(totals.unionByName(got))
    hung = totals.filter("anchor is not null").groupBy(F.col("anchor").alias("r")).agg(F.sum("total").alias("hung"))
    rows = links.select("r", "w").join(placed, "r").join(hung, "r").withColumn("_b", F.floor(F.col("r") / SPAN))
    spans = (rows.groupBy("chain", "_b").agg(F.sum("hung").alias("_t"))
             .withColumn("_before", F.sum("_t").over(Window.partitionBy("chain").orderBy("_b")) - F.col("_t")).drop("_t"))
    run = F.sum("hung").over(Window.partitionBy("chain", "_b").orderBy("r")) + F.col("_before")
    out = (rows.join(spans, ["chain", "_b"]).withColumn("size", run)
           .select("r", "w", "chain", "size", (F.col("size") - F.col("hung")).alias("below"), "hung"))
    return keep(out), totals


def _following(rows: DataFrame, flag: str) -> DataFrame:
    """Add ``next``: the first later ``r`` of the same chain whose ``flag`` holds."""
    rows = rows.withColumn("_b", F.floor(F.col("r") / SPAN)).withColumn("_f", F.when(F.col(flag), F.col("r")))
    later = lambda w: w.rowsBetween(1, Window.unboundedFollowing)                        # noqa: E731
    spans = (rows.groupBy("chain", "_b").agg(F.min("_f").alias("_m"))
             .withColumn("_later", F.min("_m").over(later(Window.partitionBy("chain").orderBy("_b")))).drop("_m"))
    inside = F.min("_f").over(later(Window.partitionBy("chain", "_b").orderBy("r")))
    return (rows.join(spans, ["chain", "_b"]).withColumn("next", F.coalesce(inside, "_later")).drop("_b", "_f", "_later"))


def condensed(keep, tree: DataFrame, nodes: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, cluster, lam)`` where they leave and clusters ``(cluster, parent, birth, size)``.

    ``nodes`` is ``(node, weight, core)``. Names: ``root``; ``c:r`` what lies
    below splitting link r in its chain; ``h:chain`` the chain hung on one.
    A node of ``min_cluster_size`` copies is held together down to its core
    distance. No cluster reaches the size: ``cluster`` is null.
    """
    mcs = min_cluster_size
    links, chains = merge_tree(keep, tree, nodes)
    # the two sides: what hangs, and the earlier links (or the other thing that hangs)
    sides = chains.filter("anchor is not null").groupBy("anchor").agg(F.min("total").alias("_small"))
    links = (links.join(sides, F.col("r") == F.col("anchor")).drop("anchor")
             .withColumn("split", F.when(F.col("below") > 0, (F.col("below") >= mcs) & (F.col("hung") >= mcs))
                         .otherwise(F.col("_small") >= mcs)))
    links = keep(_following(links, "split"))
    owner = links.select(F.col("r").alias("anchor"), F.col("chain").alias("up"), "split", "next",
                         F.col("size").alias("_size"))
    up = keep(chains.join(owner, "anchor", "left"))
    # the cluster that a chain's top lies in
    tops = _jump(keep, keep(up.filter(F.col("total") >= mcs).select(
        F.col("chain").alias("id"), F.col("up").alias("ptr"),
        F.when(F.col("anchor").isNull(), F.lit("root")).when(F.col("split"), F.concat(F.lit("h:"), "chain"))
        .when(F.col("next").isNotNull(), F.concat(F.lit("c:"), F.col("next").cast("string"))).alias("val"))))
    top = tops.toDF("chain", "_top")
    links = keep(links.join(top, "chain", "left").withColumn(
        "cluster", F.when(F.col("size") >= mcs, F.when(F.col("next").isNotNull(), F.concat(
            F.lit("c:"), F.col("next").cast("string"))).otherwise(F.col("_top")))))
    # where a node leaves: the first link above it that holds the size
    first = links.filter(F.col("size") >= mcs).groupBy("chain").agg(F.min("r").alias("_first"))
    leave = _jump(keep, keep(up.join(first, "chain", "left").select(
        F.col("chain").alias("id"), F.col("up").alias("ptr"),
        F.coalesce("_first", F.when(F.col("_size") >= mcs, F.col("anchor"))).alias("val"))))
    lam = lambda c: 1.0 / F.greatest(c, F.lit(FLOOR))                                    # noqa: E731
    named = nodes.withColumn("chain", F.concat(F.lit("0:"), F.col("node").cast("string")))
    gone = links.select(F.col("r").alias("val"), "cluster", lam(F.col("w")).alias("lam"))
    small = (named.filter(F.col("weight") < mcs).join(leave.withColumnRenamed("id", "chain"), "chain")
             .join(gone, "val", "left").select("node", "weight", "cluster", "lam"))
    big = (named.filter(F.col("weight") >= mcs).join(top, "chain")
           .select("node", "weight", F.col("_top").alias("cluster"), lam(F.col("core")).alias("lam")))
    points = keep(small.unionByName(big))
    splits = links.filter("split").select(F.col("r").alias("anchor"), F.col("cluster").alias("parent"),
                                          lam(F.col("w")).alias("birth"), "below")
    clusters = (chains.join(splits, "anchor").select(F.concat(F.lit("h:"), "chain").alias("cluster"), "parent", "birth",
                                                     F.col("total").alias("size"))
                .unionByName(splits.filter("below > 0").select(
                    F.concat(F.lit("c:"), F.col("anchor").cast("string")).alias("cluster"), "parent", "birth",
                    F.col("below").alias("size"))))
    return points, keep(clusters)


def chosen_clusters(keep, points: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster, pick, peak)``: the chosen cluster that each lies in (null: none), with its largest 1/distance.

    Excess of mass: a cluster is worth its stability or what its children
    are worth, whichever is more; it is chosen where its own counts (a tie
    too) and no cluster above is. Values rise through chains of waiting
    clusters by doubling, so the rounds grow with the logarithm of the depth.
    """
    own = (points.join(clusters.select("cluster", "birth"), "cluster")
           .groupBy("cluster").agg(F.sum(F.col("weight") * (F.col("lam") - F.col("birth"))).alias("own"),
                                   F.max("lam").alias("_p")))
    kids = (clusters.select(F.col("parent").alias("cluster"), F.col("birth").alias("_b"), "size")
            .join(clusters.select("cluster", "birth"), "cluster").groupBy("cluster")
            .agg(F.sum(F.col("size") * (F.col("_b") - F.col("birth"))).alias("kids"), F.max("_b").alias("_k")))
    zero = F.lit(0.0)
    worth = keep(clusters.join(own, "cluster", "left").join(kids, "cluster", "left").select(
        "cluster", "parent", (F.coalesce("own", zero) + F.coalesce("kids", zero)).alias("stab"),
        F.greatest("_p", "_k").alias("peak"), F.col("kids").isNull().alias("leaf")))
    # value = greatest(floor, value of the awaited child + add); two children are awaited at first
    state = keep(worth.select("cluster", "parent", "stab", F.col("stab").alias("low"), F.lit(0.0).alias("add"),
                                     F.lit(None).cast("string").alias("ptr"),
                                     F.when(F.col("leaf"), F.col("stab")).alias("value")))
    while not state.filter("value is null").isEmpty():
        below = (state.groupBy(F.col("parent").alias("cluster")).agg(
            F.sum(F.col("value")).alias("_sum"), F.count("value").alias("_done"),
            F.max(F.when(F.col("value").isNull(), F.col("cluster"))).alias("_open")))
        to = state.select(F.col("cluster").alias("ptr"), F.col("value").alias("_v"), F.col("low").alias("_low"),
                          F.col("add").alias("_add"), F.col("ptr").alias("_ptr"))
        step = state.join(below, "cluster", "left").join(to, "ptr", "left")
        fresh = F.col("value").isNull() & F.col("ptr").isNull()
        state = keep(step.select(
            "cluster", "parent", "stab",
            F.when(F.col("_ptr").isNotNull(), F.greatest(F.col("low"), F.col("_low") + F.col("add"))).otherwise(F.col("low")).alias("low"),
            F.when(F.col("_ptr").isNotNull(), F.col("add") + F.col("_add"))
            .when(fresh & (F.col("_done") == 1), F.col("_sum")).otherwise(F.col("add")).alias("add"),
            F.when(fresh & (F.col("_done") == 1), F.col("_open")).otherwise(F.coalesce("_ptr", "ptr")).alias("ptr"),
            F.coalesce("value", F.when(F.col("_v").isNotNull(), F.greatest(F.col("low"), F.col("_v") + F.col("add"))),
                       F.when(fresh & (F.col("_done") == 2), F.greatest(F.col("stab"), F.col("_sum")))).alias("value")))
    below = state.groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("_sum"))
    wins = state.join(below, "cluster", "left").select(
        "cluster", "parent", (F.col("_sum").isNull() | (F.col("stab") >= F.col("_sum"))).alias("win"))
    up = keep(wins.select("cluster", F.col("parent").alias("ptr"),
                                 F.when(F.col("win"), F.col("cluster")).alias("pick")))
    while not up.filter("ptr <> 'root'").isEmpty():
        to = up.select(F.col("cluster").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("pick").alias("_pick"))
        up = keep(up.join(to, "ptr", "left").select("cluster", F.coalesce("_ptr", "ptr").alias("ptr"),
                                                           F.coalesce("_pick", "pick").alias("pick")))
    return up.select("cluster", "pick").join(worth.select(F.col("cluster").alias("pick"), "peak"), "pick", "left").select(
        "cluster", "pick", "peak")


def hierarchical_clusters(vectors: DataFrame, key: str = "vec_id", col: str = "embedding", params: Params = DEFAULT,
                          neighbours: int = 15, n_pivots: int = 64, block: int = 256) -> DataFrame:
    """``(key, topic, probability)``: density clusters of a condensed tree with membership strengths.

    Topics are numbered from 0 by size, then by smallest key; -1 and strength
    0 are outliers. Euclidean distance, ``min_cluster_size`` and
    ``min_samples`` of ``params``. Rows whose vector is null, empty or not
    finite are outliers; rows with a null key are left out; keys are distinct
    whole numbers. Other columns are ignored.
    """
    k = max(neighbours, params.min_samples) + 1
    nodes, members = nodes_of(vectors, key, col, k)
    everyone = vectors.filter(F.col(key).isNotNull()).select(key)
    alone = everyone.select(key, F.lit(-1).alias("topic"), F.lit(0.0).alias("probability"))
    if nodes.isEmpty():
        return alone
    with scratch_tables(vectors.sparkSession) as keep:
        return cut_lineage(_clustered(keep, nodes, members, everyone, params, k, n_pivots, block, key))


def _clustered(keep, nodes: DataFrame, members: DataFrame, everyone: DataFrame, params: Params, k: int, n_pivots: int,
               block: int, key: str) -> DataFrame:
    index = build_index(nodes, n_pivots, block)
    lists = keep(node_lists(index, k))
    core = keep(lists.filter(F.col("rank") <= params.min_samples + 1)
                       .groupBy("node").agg(F.max("dist").alias("core")))
    bound = lists.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(float("inf")).alias("lb"))
    member = members.withColumnRenamed(key, "other").withColumnRenamed("node", "dst")
    near = (lists.join(member, "other").filter("node <> dst").select(F.col("node").alias("src"), "dst", "dist").distinct()
            .join(core.toDF("src", "c1"), "src").join(core.toDF("dst", "c2"), "dst")
            .select("src", "dst", F.greatest("dist", "c1", "c2").alias("w")))
    tree = keep(spanning_tree(keep, index, near, core, bound))
    weighted = keep(nodes.select("node", "weight").join(core, "node"))
    points, clusters = condensed(keep, tree, weighted, params.min_cluster_size)
    picks = chosen_clusters(keep, points, clusters)
    placed = keep(points.join(picks.filter("pick is not null"), "cluster").select(
        "node", "weight", "pick", F.least(F.lit(1.0), F.col("lam") / F.col("peak")).alias("probability")))
    sizes = placed.groupBy("pick").agg(F.min("node").alias("label"), F.sum("weight").alias("size"))
    topics = rank_by_size(sizes.select("label", "size")).join(sizes.select("label", "pick"), "label").select("pick", "topic")
    per_row = members.join(placed.join(topics, "pick").select("node", "topic", "probability"), "node")
    return (everyone.join(per_row.select(key, "topic", "probability"), key, "left")
            .select(key, F.coalesce("topic", F.lit(-1)).alias("topic"), F.coalesce("probability", F.lit(0.0)).alias("probability")))
