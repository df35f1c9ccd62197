"""Topic operators: c-TF-IDF invariants, split strategy, reduction, clusters, persistence."""

import numpy as np
from pyspark.sql import functions as F

from framelens.operators import clustering as K
from framelens.operators import topics
from framelens.params import Params
from framelens.plans.queries import ArticlePlan
from framelens.sources import files

SF_CHECK = "/root/testdata/sf0.01"


def small_docs(spark):
    rows = [
        (1, 0, "en", "cats purr and cats nap; cats purr"),
        (2, 0, "en", "cats nap in the sun, dogs bark"),
        (3, 1, "fr", "les chiens aboient, dogs bark loudly"),
        (4, 1, "fr", "dogs bark and dogs run; cats nap"),
        (5, -1, "en", "random words dogs cats"),
        (6, -1, "fr", "chiens dogs bark"),
    ]
    return spark.createDataFrame(rows, "doc_id long, topic int, lang string, text string")


def test_tokens_drop_stopwords_keep_protected(spark):
    df = spark.createDataFrame([("The memes and the 4chan anon. A b",)], "text string")
    terms = topics.tokenize(df).first()["terms"]
    assert terms == ["memes", "4chan", "anon", "memes 4chan", "4chan anon"]


def test_ctfidf_min_df_and_weights(spark):
    counts = topics.term_counts(small_docs(spark))
    per_term = {r["term"] for r in counts.collect()}
    assert "purr" not in per_term            # only in topic 0: below min_df
    assert {"cats", "dogs", "dogs bark", "nap"} <= per_term
    w = topics.ctfidf(counts)
    assert w.filter(F.col("weight") < 0).count() == 0
    summ = {r["topic_id"]: r for r in topics.topic_summary(small_docs(spark), w).collect()}
    assert summ[-1]["keywords"] == "" and summ[0]["name"].startswith("0_")
    assert summ[0]["count"] == 2 and summ[-1]["count"] == 2


def test_split_strategy_groups_by_language(spark):
    p = Params(strategy="split")
    docs = topics.with_model_group(small_docs(spark), p)
    groups = {r[0] for r in topics.term_counts(docs, p).select("model_group").distinct().collect()}
    assert groups == {"en", "fr"}


def test_reduce_topics_merges_most_similar(spark):
    rows = [(i, t, "en", txt) for i, (t, txt) in enumerate(
        [(0, "alpha beta gamma alpha")] * 3 + [(1, "alpha beta gamma beta")] * 2 +
        [(2, "delta epsilon zeta")] * 4 + [(-1, "alpha delta")])]
    docs = spark.createDataFrame(rows, "doc_id long, topic int, lang string, text string")
    counts = topics.term_counts(docs)
    got = {r["topic"]: r["new_topic"] for r in topics.reduce_topics(docs, counts, 2).collect()}
    assert got[-1] == -1
    assert got[0] == got[1] != got[2]          # 0 and 1 share every term
    assert sorted(set(got.values()) - {-1}) == [0, 1]
    assert got[0] == 0                          # the merged topic (5 docs) is the largest


def test_planted_clusters_and_outliers(spark):
    rng = np.random.default_rng(42)
    rows, vid = [], 0
    for c in range(3):
        centre = rng.normal(size=16)
        for _ in range(8 + 4 * c):
            rows.append((vid, (centre + 0.05 * rng.normal(size=16)).astype(float).tolist()))
            vid += 1
    for _ in range(6):                                   # far-off singletons
        rows.append((vid, rng.normal(size=16).tolist()))
        vid += 1
    rows.append((vid, rows[0][1]))                       # an exact copy of point 0
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    params = Params(eps_cosine=0.9)
    got = {r["vec_id"]: r["topic"] for r in K.density_clusters(df, params=params).collect()}
    sizes = {}
    for t in got.values():
        sizes[t] = sizes.get(t, 0) + 1
    assert sizes[0] == 16 and sizes[1] == 12 and sizes[2] == 9      # 8 + 1 copy in topic 2
    assert got[vid] == got[0]
    assert sizes[-1] == 6


def test_component_labels_invariant_to_partitioning(spark):
    from framelens.plans import views
    v = views.table(spark, SF_CHECK, "embeddings").select("vec_id", "embedding")
    a = {r[0]: r[1] for r in K.density_clusters(v).collect()}
    b = {r[0]: r[1] for r in K.density_clusters(v.repartition(3)).collect()}
    assert a == b and sum(1 for t in a.values() if t == -1) == 400
    assert len(set(a.values()) - {-1}) == 14


def test_topic_probability_rows_sum_to_one(spark):
    from framelens.plans import views
    v = views.table(spark, SF_CHECK, "embeddings").select("vec_id", "embedding")
    prob = K.topic_probability(v, K.density_clusters(v))
    sums = prob.groupBy("vec_id").agg(F.sum("probability").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    assert sums.count() == 500


def test_model_tables_round_trip(spark, tmpdir_path):
    p = ArticlePlan(spark, SF_CHECK)
    assign = p.prep().select("model_group", "doc_id", "topic")
    files.save_topic_model(tmpdir_path + "/model", assign, p.weights(), p.summary())
    back = files.load_topic_model(spark, tmpdir_path + "/model")
    assert back["topic_info"].count() == 22
    assert back["assignments"].count() == 761
    assert back["term_weights"].count() == p.weights().count()


def test_stable_clusters_refine_flat_cut(spark):
    rng = np.random.default_rng(3)
    rows, vid = [], 0
    base, off = rng.normal(size=16), rng.normal(size=16)
    for h in range(2):                       # one loose cluster of two tight halves
        for _ in range(10):
            rows.append((vid, (base + 0.25 * h * off + 0.01 * rng.normal(size=16)).tolist()))
            vid += 1
    for c in range(2):                       # two separate clusters
        centre = rng.normal(size=16)
        for _ in range(7):
            rows.append((vid, (centre + 0.05 * rng.normal(size=16)).tolist()))
            vid += 1
    for _ in range(5):                       # noise
        rows.append((vid, rng.normal(size=16).tolist()))
        vid += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    p = Params(eps_cosine=0.9)
    flat = {r[0]: r[1] for r in K.density_clusters(df, params=p).collect()}
    stable = {r[0]: r[1] for r in K.stable_clusters(df, params=p, levels=6).collect()}
    # every stable cluster lies inside one flat cluster; noise stays noise
    inside = {}
    for v, t in stable.items():
        if t != -1:
            inside.setdefault(t, set()).add(flat[v])
    assert all(len(s) == 1 and -1 not in s for s in inside.values())
    assert all(stable[v] == -1 for v in range(34, 39))
    assert len({stable[v] for v in range(20, 27)}) == 1 != stable[27]


def test_topics_over_time_tuned_matches_brute_force(spark):
    import datetime as dt
    import math
    import random
    from collections import Counter, defaultdict

    rnd = random.Random(5)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]
    rows = []
    for i in range(60):
        topic = [0, 1, 2, -1][i % 4]
        year = 2017 + rnd.randint(0, 3)
        day = dt.date(year, rnd.randint(1, 12), rnd.randint(1, 28))
        words = [vocab[(topic + 1 + rnd.randint(0, 4)) % len(vocab)] for _ in range(rnd.randint(3, 7))]
        rows.append((i, topic, "en", " ".join(words), day, year))
    docs = spark.createDataFrame(rows, "doc_id long, topic int, lang string, text string, "
                                       "date date, year int")
    counts = topics.term_counts(docs)
    weights = topics.ctfidf(counts)
    got = {(r["topic"], r["bin"]): (r["frequency"], r["words"])
           for r in topics.topics_over_time_tuned(docs, counts, weights).collect()}

    # brute force: the same rules in plain Python
    def terms(text):
        w = text.split()
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    per_topic = defaultdict(Counter)
    for _, t, _, text, _, _ in rows:
        per_topic[t].update(terms(text))
    df_t = Counter(term for c in per_topic.values() for term in c)
    vocab_ok = {t for t, k in df_t.items() if k >= 2}
    cnt = {t: {w: n for w, n in c.items() if w in vocab_ok} for t, c in per_topic.items()}
    A = math.floor(sum(sum(c.values()) for c in cnt.values()) / len(cnt))
    f = Counter()
    for c in cnt.values():
        f.update(c)
    idf = {w: math.log(A / f[w] + 1) for w in f}
    glob = {}
    for t, c in cnt.items():
        tot = sum(c.values())
        wt = {w: n / tot * idf[w] for w, n in c.items()}
        s = sum(wt.values())
        glob[t] = {w: v / s for w, v in wt.items()}
    days = [(r[4] - dt.date(1970, 1, 1)).days for r in rows]
    lo, hi = min(days), max(days)
    nb = min(20, max(len({r[5] for r in rows}), 1))
    def bin_of(day):
        return 0 if hi == lo else min(math.floor((day - lo) * nb / (hi - lo)), nb - 1)
    bins = {r[0]: bin_of((r[4] - dt.date(1970, 1, 1)).days) for r in rows}
    order = sorted(set(bins.values()))
    tpos = {b: k for k, b in enumerate(order)}
    want = {}
    for t in (0, 1, 2):
        prev_pos, prev_y = None, None
        for b in order:
            members = [r for r in rows if r[1] == t and bins[r[0]] == b]
            if not members:
                continue
            c = Counter()
            for r in members:
                c.update(w for w in terms(r[3]) if w in vocab_ok)
            raw = {w: n * idf[w] for w, n in c.items()}
            s = sum(raw.values())
            w1 = {w: v / s for w, v in raw.items()} if s else {}
            y = {}
            for w in glob[t]:
                e = w1.get(w, 0.0)
                if prev_pos is not None and prev_pos == tpos[b] - 1:
                    e = (e + prev_y[w]) / 2
                y[w] = (e + glob[t][w]) / 2
            prev_pos, prev_y = tpos[b], y
            best = sorted((w for w in y if round(y[w], 12) > 0), key=lambda w: (-round(y[w], 12), w))[:5]
            want[(t, b)] = (len(members), ", ".join(best))
    assert got == want


def test_eps_edges_blocked_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(4, 12))
    vecs = np.concatenate([c + 0.4 * rng.normal(size=(40, 12)) for c in centres])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vecs)]
    nodes = spark.createDataFrame(rows, "node long, vec array<float>").withColumn("weight", F.lit(1))
    p = Params(eps_cosine=0.8)
    got = {(r["src"], r["dst"]) for r in K.eps_edges(nodes, p, n_pivots=6, block=8).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float64)
    n = np.linalg.norm(x, axis=1)
    cos = np.round((x @ x.T) / np.outer(n, n), 6)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= 0.8}
    assert got == want and len(want) > 100


def test_rank_by_size_exact_with_ties(spark):
    rnd = np.random.default_rng(2)
    rows = [(int(label), int(size)) for label, size in
            zip(rnd.permutation(500), rnd.integers(5, 9, size=500))]
    df = spark.createDataFrame(rows, "label long, size long")
    got = {r["label"]: r["topic"] for r in K.rank_by_size(df, bucket_width=16).collect()}
    want = {lab: i for i, (lab, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def _planted(spark, n=300):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 12))
    vecs = np.concatenate([c + 0.3 * rng.normal(size=(n // 6, 12)) for c in centres])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vecs)]
    return rows, spark.createDataFrame(rows, "node long, vec array<float>").withColumn("weight", F.lit(1))


def test_graph_shuffles_a_fixed_number_of_copies_of_the_nodes(spark):
    """Every node goes to each of the groups once, where cells and chunks sent it n / block times."""
    _, nodes = _planted(spark)
    for n in (120, 300):
        groups, _ = K._groups(nodes.filter(F.col("node") < n), 8, 4)
        sides = K._group_pairs(groups).agg(F.sum(F.size("ids")), F.sum(F.size("oids"))).first()
        assert groups.count() == K.GROUPS and sum(sides) == n * (K.GROUPS + 1)


def test_links_and_forest_have_the_components_of_all_edges(spark):
    rows, nodes = _planted(spark)
    odd = nodes.unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12)],
                                                  "node long, vec array<float>").withColumn("weight", F.lit(1)))
    for eps in (0.6, 0.9):
        p = Params(eps_cosine=eps)
        want = {r[0]: r[1] for r in K.connected_components(nodes, K.eps_edges(odd, p, 6, 16)).collect()}
        links = K.eps_links(odd, p, 6, 16)
        assert {r[0]: r[1] for r in K.connected_components(nodes, links).collect()} == want
        forest = K.eps_forest(odd, Params(eps_cosine=0.6), 6, 16, pending=50).filter(F.col("cosine") >= eps)
        assert {r[0]: r[1] for r in K.connected_components(nodes, forest).collect()} == want
    assert len(set(want.values())) > 6


def test_probabilities_are_not_ranked_in_a_window(spark):
    _, nodes = _planted(spark)
    v = nodes.withColumnRenamed("node", "vec_id").withColumnRenamed("vec", "embedding")
    prob = K.topic_probability(v, K.density_clusters(v, params=Params(eps_cosine=0.7)))
    assert "Window" not in prob._jdf.queryExecution().optimizedPlan().toString()
    assert prob.groupBy("vec_id").agg(F.sum("probability").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_embedded_rows_are_never_dense(spark, monkeypatch):
    from framelens.plans import queries
    out = queries.q_embed_docs(spark, SF_CHECK)
    assert "vector_to_array" not in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("vectortoarray", "vector_to_array")
    assert out.filter("nnz > 0 and abs(norm - 1) < 1e-6").count() > 700


def test_reduce_topics_equals_merging_the_counts(spark):
    """Rounds over unmerged topics give what merging the counts in every round gives."""
    rng = np.random.default_rng(9)
    n = rng.integers(0, 5, size=(9, 40)) * (rng.random((9, 40)) < 0.5)
    n[0] += 1
    topic = np.arange(-1, 8)
    rows = [("all", int(t), f"w{j}", int(n[i, j])) for i, t in enumerate(topic) for j in range(40) if n[i, j]]
    counts = spark.createDataFrame(rows, "model_group string, topic int, term string, n long")
    docs = spark.createDataFrame([("all", int(t), "x") for t in topic for _ in range(int(t) + 3)],
                                 "model_group string, topic int, text string")
    size = {int(t): int(t) + 3 for t in topic}
    group = {int(t): int(t) for t in topic}
    while len(set(group.values()) - {-1}) > 3:
        m = {g: sum(n[i] for i, t in enumerate(topic) if group[int(t)] == g) for g in sorted(set(group.values()))}
        avg, f = int(np.mean([v.sum() for v in m.values()])), sum(m.values())
        w = {g: v / v.sum() * np.log(avg / f + 1) for g, v in m.items() if g != -1}
        sim = {(a, b): round(float(w[a] @ w[b] / np.linalg.norm(w[a]) / np.linalg.norm(w[b])), 12)
               for a in w for b in w if a < b}
        a, b = max(sim, key=lambda p: (sim[p], -p[0], -p[1]))
        total = {g: sum(size[t] for t in size if group[t] == g) for g in (a, b)}
        gone, kept = (a, b) if total[a] < total[b] else (b, a)
        group = {t: kept if g == gone else g for t, g in group.items()}
    total = {g: sum(size[t] for t in size if group[t] == g) for g in set(group.values()) - {-1}}
    order = {g: i for i, g in enumerate(sorted(total, key=lambda g: (-total[g], g)))}
    got = {r["topic"]: r["new_topic"] for r in topics.reduce_topics(docs, counts, 3).collect()}
    assert got == {t: order.get(g, -1) for t, g in group.items()}
