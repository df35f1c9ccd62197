"""Text -> topics on planted vocabularies: fit, strategy switch, transform."""

from dataclasses import replace

import numpy as np

from framelens.operators import modeling
from framelens.operators.frames import frame_names
from framelens.operators.svd import gram_product, orthonormal, truncated_svd
from framelens.params import DEFAULT
from framelens.plans.queries import ArticlePlan

from conftest import SF_CHECK

PARAMS = replace(DEFAULT, n_components=3)


def planted(spark, n=30, start=0, lang="en"):
    rng = np.random.default_rng(5 + start)
    rows = []
    for i in range(n):
        g = i % 3
        text = " ".join(f"theme{g}word{k}" for k in rng.integers(0, 8, 40))
        rows.append((start + i, text, lang, g))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, g int")


def one_to_one(rows):
    pairs = {(r["g"], r["topic"]) for r in rows}
    return len(pairs) == 3 and len({t for _, t in pairs}) == 3 and -1 not in {t for _, t in pairs}


def test_fit_finds_the_planted_groups_and_transform_agrees(spark):
    docs = planted(spark)
    with_empty = docs.unionByName(spark.createDataFrame([(900, "", "en", 0), (901, None, "en", 0)], docs.schema))
    model, = modeling.fit_topics(with_empty, PARAMS)
    got = modeling.assigned([model]).join(with_empty, "doc_id").collect()
    assert len(got) == 32
    assert one_to_one([r for r in got if r["doc_id"] < 900])
    assert {r["topic"] for r in got if r["doc_id"] >= 900} == {-1}
    assert all(0 <= r["probability"] <= 1 for r in got)
    topic_of = {r["g"]: r["topic"] for r in got if r["doc_id"] < 900}
    new = planted(spark, 9, 500)
    moved = modeling.transform(new, model, PARAMS).join(new, "doc_id").collect()
    assert len(moved) == 9 and all(r["topic"] == topic_of[r["g"]] for r in moved)
    strange = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert modeling.transform(strange, model, PARAMS).first()["topic"] == -1


def test_split_strategy_keeps_groups_apart(spark):
    docs = planted(spark).unionByName(planted(spark, 30, 100, "fr"))
    got = modeling.assigned(modeling.fit_topics(docs, replace(PARAMS, strategy="split")))
    assert {(r["model_group"], r["n"]) for r in got.groupBy("model_group").count()
            .withColumnRenamed("count", "n").collect()} == {("en", 30), ("fr", 30)}
    info = spark.createDataFrame([("en", 0, "0_a"), ("fr", 0, "0_b")], "model_group string, topic int, name string")
    ann = spark.createDataFrame([("fr", 0, " x ")], "model_group string, topic_id int, frame_label string")
    assert {tuple(r) for r in frame_names(info, ann).collect()} == {("en", 0, "0_a"), ("fr", 0, "x")}


def test_no_text_gives_outliers_only(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    model, = modeling.fit_topics(docs, PARAMS)
    assert [r["topic"] for r in model.assignments.collect()] == [-1, -1]
    assert modeling.fit_topics(docs.limit(0), PARAMS)[0].assignments.count() == 0


def test_singular_values_and_vectors_equal_a_dense_decomposition(spark):
    docs = ArticlePlan(spark, SF_CHECK).prep().select("doc_id", "text")
    space = modeling.fit_space(docs)
    rows = modeling.weighted_terms(docs, space.idf).collect()
    dense = np.zeros((len(rows), len(space.basis)))
    for i, r in enumerate(rows):
        dense[i, r["at"]] = r["w"]
    assert np.allclose(np.linalg.norm(dense, axis=1), 1.0)
    want = np.linalg.svd(dense, compute_uv=False)[:DEFAULT.projection_dims]
    assert np.allclose(space.values, want, rtol=0.01)
    assert np.allclose(space.basis.T @ space.basis, np.eye(DEFAULT.projection_dims), atol=1e-8)
    # the best approximation of this rank, to a hundredth
    lost = np.linalg.norm(dense) ** 2 - np.linalg.norm(dense @ space.basis) ** 2
    assert lost <= 1.01 * (np.linalg.norm(dense) ** 2 - (want ** 2).sum())


def test_svd_of_low_rank_one_column_and_no_rows(spark):
    rows = spark.createDataFrame([([0, 2], [1.0, 2.0]), ([0, 2], [2.0, 4.0]), ([], []), (None, None)],
                                 "at array<int>, w array<double>")
    values, basis = truncated_svd(rows, 4, 3)
    assert np.allclose(values, [5.0, 0, 0]) and np.allclose(np.abs(basis[:, 0]), np.array([1, 0, 2, 0]) / 5 ** 0.5)
    assert not basis[:, 1:].any()
    assert not truncated_svd(rows.limit(0), 4, 3)[0].any()
    assert truncated_svd(rows.selectExpr("array(0) at", "array(1.0D) w"), 1, 3)[0].tolist() == [2.0, 0.0, 0.0]


def test_saved_model_places_texts_as_before(spark, tmpdir_path):
    model, = modeling.fit_topics(planted(spark), PARAMS)
    modeling.save_model(model, tmpdir_path)
    loaded = modeling.load_model(spark.newSession(), tmpdir_path)
    new = planted(spark, 9, 500)

    def placed(m):
        return sorted(tuple(r) for r in modeling.transform(new, m, PARAMS).collect())
    assert placed(loaded) == placed(model) and {t for _, _, t in placed(loaded)} == {0, 1, 2}
    fitted = {r["doc_id"]: r["topic"] for r in model.assignments.collect()}
    again = {r["doc_id"]: r["topic"] for r in modeling.transform(planted(spark), loaded, PARAMS).collect()}
    assert again == fitted                      # a topic reaches as far as its own texts
    assert sorted(map(tuple, loaded.assignments.collect())) == sorted(map(tuple, model.assignments.collect()))
    nothing, = modeling.fit_topics(spark.createDataFrame([(1, None)], "doc_id long, text string"), PARAMS)
    modeling.save_model(nothing, tmpdir_path)
    assert modeling.load_model(spark, tmpdir_path).pca is None


def test_passes_of_the_decomposition_leave_no_partials_on_disk(spark):
    """A partial of every task and pass stayed on disk until the driver collected its garbage."""
    rng = np.random.default_rng(2)
    rows = [(sorted(rng.choice(1 << 14, 30, replace=False).tolist()), rng.uniform(size=30).tolist()) for _ in range(64)]
    table = spark.createDataFrame(rows, "at array<int>, w array<double>").repartition(16).localCheckpoint()
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.getAllFiles())
        return sum(f.length() for f in files if f.getName().startswith("shuffle_"))

    before = held()
    block = orthonormal(rng.normal(size=(1 << 14, 64)))
    got = gram_product(table, block)
    assert held() - before < 1 << 20                    # a partial is 8 MB
    dense = np.zeros((64, 1 << 14))
    for i, (at, w) in enumerate(rows):
        dense[i, at] = w
    assert np.allclose(got, dense.T @ (dense @ block), atol=1e-12)


def test_orthonormal_basis_in_pieces():
    rng = np.random.default_rng(4)
    for n, width in ((5, 3), (3, 3), (9000, 80), (4096 + 7, 20), (8192, 5)):
        x = rng.normal(size=(n, width))
        q = orthonormal(x.copy())
        assert np.allclose(q.T @ q, np.eye(width), atol=1e-12)
        assert np.allclose(q @ (q.T @ x), x, atol=1e-9)
