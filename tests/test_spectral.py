"""Spectral reduction against a dense eigenvalue solver, and on rings."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import spectral
from framelens.operators.spectral import eigenvectors, spectral_dims
from framelens.params import DEFAULT
from framelens.session import scratch_tables

VECTORS = "vec_id long, embedding array<double>"


def rings(n=120, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for ring, radius in enumerate((1.0, 3.0)):
        at = rng.uniform(0, 2 * np.pi, n)
        out += [(ring, radius * np.cos(a), radius * np.sin(a)) for a in at]
    return out


def test_eigenvectors_equal_a_dense_solver(spark):
    rng = np.random.default_rng(8)
    n = 60
    pairs = {(int(min(a, b)), int(max(a, b))): float(w) for a, b, w in
             zip(rng.integers(0, n, 400), rng.integers(0, n, 400), rng.uniform(0.2, 1, 400)) if a != b}
    pairs |= {(i, i + 1): 0.5 for i in range(n - 1)}
    dense = np.zeros((n, n))
    for (a, b), w in pairs.items():
        dense[a, b] = dense[b, a] = w
    root = np.sqrt(dense.sum(axis=1))
    values, vectors = np.linalg.eigh(dense / np.outer(root, root))
    values, vectors = values[::-1][1:4], vectors[:, ::-1][:, 1:4]
    edges = spark.createDataFrame([(a, b, w) for (x, y), w in pairs.items() for a, b in ((x, y), (y, x))],
                                  "src long, dst long, w double")
    with scratch_tables(spark) as keep:
        state, got, residuals = eigenvectors(keep, edges, 3, tolerance=1e-4)
        rows = state.orderBy("node").collect()
    u = np.array([r["s"][:3] for r in rows])
    assert np.allclose([r["root"] for r in rows], root)
    assert np.allclose(got, values, atol=1e-6) and residuals.max() <= 1e-4
    assert np.allclose(np.abs((u * vectors).sum(axis=0)), 1.0, atol=1e-4)


def test_rings_are_separated_where_a_linear_reduction_cannot(spark):
    planted = rings()
    df = spark.createDataFrame([(i, [float(x), float(y)]) for i, (_, x, y) in enumerate(planted)], VECTORS)
    found = spectral_dims(df, params=replace(DEFAULT, n_components=2), k=8, cosine=False)
    assert found.residuals.max() <= 1e-3
    at = {r["vec_id"]: r["reduced"] for r in found.coords.collect()}
    ring = np.array([g for g, _, _ in planted])
    coords = np.array([at[i] for i in range(len(planted))])
    # the rings are components: the first eigenvalue is 1 and its vector one number on each
    assert found.values[0] == pytest.approx(1.0, abs=1e-5)
    inner, outer = coords[ring == 0, 0], coords[ring == 1, 0]
    assert max(inner.max(), outer.max()) > 0 > min(inner.min(), outer.min())
    assert inner.max() < outer.min() or outer.max() < inner.min()


def test_copies_share_coordinates_and_unusable_rows_are_left_out(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    rows += [(100 + i, rows[0][1]) for i in range(12)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (None, rows[1][1]),
             (204, [float("nan")] * 4)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS + ", node int, s string")
    at = {r["vec_id"]: r["reduced"] for r in spectral_dims(df, k=5).coords.collect()}
    assert set(at) == set(range(30)) | set(range(100, 112))
    assert all(at[100 + i] == at[0] for i in range(12)) and all(len(v) == DEFAULT.n_components for v in at.values())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [0.0, 1.0])],
                                  [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]])
def test_few_rows(spark, rows):
    got = spectral_dims(spark.createDataFrame(rows, VECTORS)).coords.collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in rows}
    assert all(len(r["reduced"]) == DEFAULT.n_components and None not in r["reduced"] for r in got)


def test_a_hop_is_a_product_of_packed_parts(spark, monkeypatch):
    """every hop joined and sorted a row per edge; now there is one per part and pair of parts."""
    monkeypatch.setattr(spectral, "PART_NODES", 8)
    rng = np.random.default_rng(8)
    n, cols = 30, 3
    dense = np.triu(rng.uniform(0.2, 1, (n, n)) * (rng.uniform(size=(n, n)) < 0.3), 1)
    dense += np.diag(np.full(n - 1, 0.5), 1)
    dense += dense.T
    root = np.sqrt(dense.sum(axis=1))
    edges = spark.createDataFrame([(int(a), int(b), float(dense[a, b])) for a, b in zip(*np.nonzero(dense))],
                                  "src long, dst long, w double")
    degree = edges.groupBy("src").agg(F.sum("w").alias("degree")).withColumnRenamed("src", "node")
    with scratch_tables(spark) as keep:
        parts = spectral.Parts(keep, edges, degree, n, float(dense.sum()), cols, 42)
        assert parts.n == 4 and parts.edges.count() <= 16 < edges.count()
        moved = parts.hop(parts.start, cols)
        assert "Join" not in moved._jdf.queryExecution().executedPlan().toString() and moved.count() == 4
        at, to = (np.array([r["s"] for r in parts.rows(x, cols).orderBy("node").collect()]) for x in (parts.start, moved))
        gram = parts.gram([parts.start, moved])
    assert np.allclose(to, dense / np.outer(root, root) @ at, atol=1e-12)
    all_of = np.column_stack([at, to, root / np.sqrt(dense.sum())])
    assert np.allclose(gram, all_of.T @ all_of, atol=1e-12)
