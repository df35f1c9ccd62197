"""Exact nearest neighbours against brute force."""

import numpy as np
import pandas as pd

from framelens.operators.neighbours import nearest_neighbours


def brute(rows, k):
    ok = [(i, np.asarray(v, dtype=np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    ids = np.array([i for i, _ in ok])
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    cos = np.round(x @ x.T, 6)
    out = {}
    for a, i in enumerate(ids):
        ranked = sorted((-cos[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out[int(i)] = [(int(j), float(-c)) for c, j in ranked]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["vec_id"], r["rank"])):
        out.setdefault(r["vec_id"], []).append((r["neighbour"], round(r["cosine"], 6)))
    return out


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (90, 5)) for c in (-2, 0, 3)]).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]                      # copies, more than k
    rows += [(2000, None), (2001, []), (2002, [0.0] * 5), (2003, [1.0, None, 0.0, 0.0, 0.0]),
             (None, rows[3][1]), (2004, [float("nan")] * 5)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows],
                               "vec_id long, embedding array<float>, node string, dist int")
    got = listed(nearest_neighbours(df, 6, n_pivots=8, block=16))
    want = brute([r for r in rows if r[1] != []], 6)
    assert got == want


def test_few_rows_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest_neighbours(spark.createDataFrame([], schema), 15).count() == 0
    got = listed(nearest_neighbours(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], schema)))
    assert {i: [j for j, _ in v] for i, v in got.items()} == {1: [3, 2], 2: [3, 1], 3: [1, 2]}


def test_blocks_are_shuffled_a_fixed_number_of_times(spark):
    from pyspark.sql import functions as F
    from framelens.operators import neighbours as N
    rng = np.random.default_rng(5)
    for n in (200, 800):
        rows = [(i, [float(a) for a in v], [i]) for i, v in enumerate(rng.normal(size=(n, 8)))]
        index = N.build_index(spark.createDataFrame(rows, "node long, vec array<double>, extra array<long>"), 4, 8)
        sent = N.streamed(index.blocks, index.blocks, N.part_count(index)).agg(F.sum(F.size("ids"))).first()[0]
        assert sent <= n * (N.PARTS + 1)


def test_the_single_precision_screen_loses_no_neighbour(monkeypatch):
    """F2: pairs past the screen are decided in double precision, one by one or as a product."""
    from framelens.operators import neighbours as N

    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(6, 8)), 50, axis=0) + 1e-4 * rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [{"part": 0, "kind": kind, "blk": b, "cell": 0, "lo": 0.0, "hi": 2.0, "ids": np.arange(b * 25, b * 25 + 25),
             "vecs": list(x[b * 25:b * 25 + 25]), "extra": [[i] for i in range(b * 25, b * 25 + 25)]}
            for kind in (0, 1) for b in range(12)]
    index = N.Index(None, x[:1], np.array([2.0]))
    found = []
    for share in (1.0, -1.0):
        monkeypatch.setattr(N, "SPARSE", share)
        got = pd.concat(N._listed(index, 5, True)(iter([pd.DataFrame(rows)])))
        found.append(sorted(map(tuple, got[["node", "rank", "other", "dist"]].to_numpy().tolist())))
    cosine = np.round(x @ x.T, 6)
    want = sorted((i, r + 1, j, 1 - cosine[i, j]) for i in range(300)
                  for r, j in enumerate(sorted(range(300), key=lambda j: (-cosine[i, j], j))[:5]))
    assert found[0] == found[1] and np.allclose(found[0], want)
