"""Preprocessing chain on the article view, dedup semantics, language, top-k."""

import random

from pyspark.sql import functions as F

from framelens.operators import corpus, langid
from framelens.operators.topk import top_k_per_group
from framelens.plans import queries as Q
from framelens.plans import views

SF_CHECK = "/root/testdata/sf0.01"


def test_chain_counts_on_fixture(spark):
    raw = views.articles(spark, SF_CHECK)
    assert raw.count() == 1000
    c = corpus.drop_stubs(corpus.clean_articles(raw))
    assert c.count() == 892
    by_url = corpus.first_per_key(c, "url")
    assert by_url.count() == 847
    assert corpus.dedup_articles(c).count() == 788
    assert corpus.preprocess(raw).count() == 761


def test_dedup_keeps_first_and_is_idempotent(spark):
    df = spark.createDataFrame([(3, "u", "x"), (1, "u", "y"), (2, "v", "x"), (4, None, "z"),
                                (5, None, "w")], "doc_id long, url string, text string")
    once = corpus.dedup_articles(df)
    assert sorted(r["doc_id"] for r in once.collect()) == [1, 2, 4]
    assert sorted(r["doc_id"] for r in corpus.dedup_articles(once).collect()) == [1, 2, 4]


def test_attrition_reconciles(spark):
    got = dict(Q.q_attrition(spark, SF_CHECK).collect())
    assert got == {"stub": 108, "duplicate_url": 45, "duplicate_text": 59, "undated": 27,
                   "kept": 761}


def test_empty_corpus_is_error(spark):
    import pytest

    with pytest.raises(ValueError):
        corpus.ensure_not_empty(spark.createDataFrame([], "doc_id long"))


def test_language_detection_accuracy(spark):
    docs = views.table(spark, SF_CHECK, "documents", "doc_id")
    profile, consts = langid.train_profiles(docs.filter(F.col("doc_id") % 2 == 0))
    test = docs.filter(F.col("doc_id") % 2 == 1)
    det = langid.detect_language(test, profile, consts)
    joined = det.join(test.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    acc = joined.filter(F.col("lang_detected") == F.col("truth")).count() / joined.count()
    assert acc >= 0.99


def test_language_fallback_for_empty_text(spark):
    docs = spark.createDataFrame([(1, "The cat and the dog are in the house.", "en"),
                                  (2, "Le chat et le chien sont dans la maison.", "fr")],
                                 "doc_id long, text string, lang string")
    profile, consts = langid.train_profiles(docs)
    probe = spark.createDataFrame([(10, "", "en"), (11, "the dog is in the house", "fr"),
                                   (12, "le chien est dans la maison", "en")],
                                  "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_detected"], r["lang"])
           for r in langid.detect_language(probe, profile, consts).collect()}
    assert got[10] == (None, "en")
    assert got[11][0] == "en" and got[12][0] == "fr"


def test_top_k_matches_brute_force_with_hot_group(spark):
    rnd = random.Random(7)
    rows = [(("hot" if i % 3 else f"g{i % 7}"), i, rnd.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, v int")
    got = {(r["g"], r["rank"]): r["id"] for r in
           top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, "id", 16).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        best = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:5]
        for k, r in enumerate(best, 1):
            want[(g, k)] = r[1]
    assert got == want


def test_trigrams_are_counted_by_whole_characters(spark):
    """A letter beyond the basic plane is one character; a short text has no trigram."""
    wide = "\U00010400"                       # a letter made of two code units
    df = spark.createDataFrame([(1, f"a{wide}b"), (2, "aaa aaa"), (3, None), (4, "12 3")],
                               "doc_id long, text string")
    got = {}
    for r in langid.trigram_counts(df, ["doc_id"]).collect():
        got.setdefault(r["doc_id"], {})[r["tri"]] = r["c"]
    low = wide.lower()
    assert got[1] == {f" a{low}": 1, f"a{low}b": 1, f"{low}b ": 1}
    assert got[2] == {" aa": 2, "aaa": 2, "aa ": 2, "a a": 1}
    assert got[3] == {None: None} and len(got[4]) == 1


def test_detection_matches_a_plain_scorer(spark):
    """Scores recomputed per text in Python from the profile."""
    import math

    docs = views.table(spark, SF_CHECK, "documents", "doc_id")
    profile, consts = langid.train_profiles(docs.filter(F.col("doc_id") % 2 == 0))
    weight = {(r["lang"], r["tri"]): r["logn"] for r in profile.collect()}
    langs = {r["lang"]: (r["prior"], r["denom"]) for r in consts.collect()}
    got = {r["doc_id"]: r["lang_detected"] for r in langid.detect_language(docs, profile, consts).collect()}
    assert len(got) == 1000
    counts = {}
    for r in langid.trigram_counts(docs, ["doc_id"]).filter("doc_id < 60").collect():
        counts.setdefault(r["doc_id"], []).append((r["tri"], r["c"]))
    for key, cs in counts.items():
        if cs == [(None, None)]:
            assert got[key] is None
            continue
        total = sum(c for _, c in cs)
        score = {lang: prior - total * denom + math.fsum(c * weight.get((lang, t), 0.0) for t, c in cs)
                 for lang, (prior, denom) in langs.items()}
        assert got[key] == max(score, key=score.get)


def test_attrition_reasons_on_planted_rows(spark):
    long = "word " * 60
    raw = spark.createDataFrame(
        [(1, "u1", "t", long, "2020-01-01"), (2, "u1", "t", long + "x", "2020-01-01"),   # duplicate url
         (3, "u2", "t", long, "2020-01-01"),                                              # duplicate text
         (4, "u3", "t", "short", "2020-01-01"), (5, "u1", "t", None, None),               # stubs
         (6, "u4", "t", long + "y", "bad"), (7, None, "t", long + "z", "2020-01-01")],
        "doc_id long, url string, title string, body string, date string")
    got = {r["reason"]: r["n"] for r in corpus.attrition(raw).collect()}
    assert got == {"stub": 2, "duplicate_url": 1, "duplicate_text": 1, "undated": 1, "kept": 2}
    assert corpus.attrition(raw.limit(0)).count() == 0
    kept = corpus.dedup_articles(corpus.drop_stubs(corpus.clean_articles(raw)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 6, 7]


def test_complete_counts_takes_any_label(spark):
    from framelens.operators.frames import complete_counts

    df = spark.createDataFrame([("en", "a`b"), ("fr", "lang"), ("en", "lang"), ("en", None)],
                               "lang string, frame string")
    got = {(r["lang"], r["frame"]): r["n"] for r in complete_counts(df, "lang", "frame").collect()}
    assert got == {("en", "a`b"): 1, ("en", "lang"): 1, ("fr", "a`b"): 0, ("fr", "lang"): 1}
    assert complete_counts(df.limit(0), "lang", "frame").count() == 0
