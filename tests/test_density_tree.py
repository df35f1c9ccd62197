"""Hierarchical density clusters against a brute-force statement of the rule."""

from dataclasses import replace

import numpy as np
import pytest

from framelens.operators.density_tree import FLOOR, hierarchical_clusters
from framelens.params import DEFAULT


def brute(x, ids, mcs, min_samples):
    """(topic members, strengths): single linkage of mutual reachability, condensed, excess of mass."""
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    root = list(range(n))
    tree = {i: (None, None, 0.0, 1) for i in range(n)}
    top = {i: i for i in range(n)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for weight, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = find(i), find(j)
        if a != b:
            name = len(tree)
            tree[name] = (top[a], top[b], weight, tree[top[a]][3] + tree[top[b]][3])
            root[b] = a
            top[a] = name

    def rows(t):
        stack, out = [t], []
        while stack:
            t = stack.pop()
            if tree[t][0] is None:
                out.append(t)
            else:
                stack += tree[t][:2]
        return out

    stab, peak, kids, left = {}, {}, {}, {}

    def walk(t, cluster, birth):
        """Follow one cluster down; returns nothing, fills the tables."""
        stab.setdefault(cluster, 0.0), kids.setdefault(cluster, []), peak.setdefault(cluster, 0.0)
        while tree[t][0] is not None:
            a, b, weight, _ = tree[t]
            lam = 1.0 / max(weight, FLOOR)
            peak[cluster] = max(peak[cluster], lam)
            big = [c for c in (a, b) if tree[c][3] >= mcs]
            if len(big) == 2:
                for c in big:
                    stab[cluster] += tree[c][3] * (lam - birth)
                    kids[cluster].append(c)
                    walk(c, c, lam)
                return
            for c in (a, b):
                if c not in big:
                    for r in rows(c):
                        stab[cluster] += lam - birth
                        left[r] = (cluster, lam)
            if not big:
                return
            t = big[0]

    walk(max(tree), "root", 0.0)
    chosen, value = {}, {}

    def pick(c):
        below = [pick(k) for k in kids[c]]
        mine = [k for _, chosen_ in below for k in chosen_]
        total = sum(v for v, _ in below)
        if c != "root" and (not kids[c] or stab[c] >= total):
            return stab[c], [c]
        return total, mine

    out, parent = {int(i): (None, 0.0) for i in ids}, {k: c for c, ks in kids.items() for k in ks}
    selected = set(pick("root")[1])
    for r, (c, lam) in left.items():
        while c not in selected and c in parent:
            c = parent[c]
        if c in selected:
            out[int(ids[r])] = (c, min(1.0, lam / peak[c]))
    return out


def same(got, want):
    groups = lambda m: {frozenset(i for i in m if m[i][0] == c) for c in {m[i][0] for i in m}}
    outliers = lambda m, none: {i for i in m if m[i][0] == none}                                  # noqa: E731
    assert outliers(got, -1) == outliers(want, None)
    assert groups(got) == groups(want)
    for i in got:
        assert got[i][1] == pytest.approx(want[i][1], rel=1e-6, abs=1e-9)


def run(spark, x, params, **kw):
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {r["vec_id"]: (r["topic"], r["probability"])
            for r in hierarchical_clusters(df, params=params, **kw).collect()}


@pytest.mark.parametrize("case", ["blobs", "copies_far"])
def test_equals_brute_force(spark, case):
    rng = np.random.default_rng(11)
    if case == "blobs":                      # unequal density, noise; few neighbours force the search
        x = np.concatenate([rng.normal(0, 0.2, (60, 3)), rng.normal(2, 0.5, (70, 3)), rng.normal((4, 0, 0), 0.1, (40, 3)),
                            rng.uniform(-4, 6, (30, 3))])
        params, kw = replace(DEFAULT, min_cluster_size=5, min_samples=1), {"neighbours": 3, "n_pivots": 8, "block": 32}
    else:                                    # copies many and few; groups larger than their lists, far apart
        x = np.concatenate([rng.normal((0, 0), 0.1, (40, 2)), rng.normal((100, 0), 0.1, (40, 2)),
                            rng.normal((0, 300), 5.0, (30, 2))])
        x = np.concatenate([x, np.repeat(x[:1], 12, axis=0), np.repeat(x[50:51], 2, axis=0)])
        params, kw = replace(DEFAULT, min_cluster_size=6, min_samples=3), {"neighbours": 3, "n_pivots": 4, "block": 16}
    got = run(spark, x, params, **kw)
    same(got, brute(x, np.arange(len(x)), params.min_cluster_size, params.min_samples))
    assert len({t for t, _ in got.values()}) > 2


def test_small_and_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, topic int"
    assert hierarchical_clusters(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.0, 0.0], 9), (2, None, 9), (3, [], 9), (4, [float("nan"), 1.0], 9), (None, [1.0, 1.0], 9)]
    got = hierarchical_clusters(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r) for r in got) == [(i, -1, 0.0) for i in (1, 2, 3, 4)]
