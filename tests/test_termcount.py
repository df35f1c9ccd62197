"""Term counts in pieces, candidates of the best terms, and no vocabulary dealt out by topic or group."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelens.functions import scalars as S
from framelens.operators import termcount, topics
from framelens.operators.topk import top_k_candidates, top_k_per_group
from framelens.params import Params

ODD_TEXTS = ["The memes and the 4chan anon. A b", "Élan élan été; x y_z éé", "", None, "!!", "mot", "the of and",
             "日本 語 日本 日本", "alpha the beta ALPHA", "İstanbul ΣΑΣ σας Kelvin", "a\u0000bc de"]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def odd_docs(spark):
    return topics.with_model_group(spark.createDataFrame(
        [(i, i % 3 if i % 7 else None, t) for i, t in enumerate(ODD_TEXTS * 5)], "doc_id long, topic int, text string"))


@pytest.mark.parametrize("ngrams", [1, 2])
def test_pieces_count_the_terms_of_tokenize(spark, ngrams):
    p, docs = Params(ngram_max=ngrams), odd_docs(spark)
    keys = ["model_group", "topic"]
    want = topics.tokenize(docs, params=p).select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").count()
    got = topics.partial_terms(docs, keys, p).groupBy(*keys, "term").agg(F.sum("n"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_a_batch_is_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(termcount, "PIECE_BYTES", 9)
    words = ["aa bb", "", "cc aa bb aa bb cc", "été"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, None, 1] * 3), pa.array(words)], ["k", "_words"])
    pieces = list(termcount._pieces(batch.slice(1)))
    assert len(pieces) > 3 and sum(p.num_rows for p in pieces) == 11
    got = Counter()
    for p in pieces:
        for k, term, n in termcount._counted(p, pa.array(["cc"]), True):
            for key in zip(k.to_pylist(), term.to_pylist(), n.to_pylist()):
                got[key[:2]] += key[2]
    assert got == {(0, "aa"): 2, (0, "bb"): 2, (0, "aa bb"): 2, (None, "aa"): 6, (None, "bb"): 6, (None, "aa bb"): 6,
                   (None, "bb aa"): 3, (1, "été"): 3}


def test_small_tables_go_to_the_vocabulary(spark):
    """a join by topic or group would bring the whole vocabulary to one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = topics.term_counts(odd_docs(spark))
        assert physical(counts).count("Exchange") == 1
        assert "SortMergeJoin" not in physical(topics.ctfidf(counts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_candidates_hold_the_best_and_their_ties(spark):
    rnd = random.Random(3)
    rows = [(g, f"t{i}", float(rnd.randint(0, 400))) for g in range(2) for i in range(3000)] + [(7, "only", 1.0)]
    df = spark.createDataFrame(rows, "g int, term string, w double").repartition(3).persist()
    order = [F.col("w").desc(), F.col("term")]
    few = top_k_candidates(df, ["g"], "w", 5)
    want = top_k_per_group(df, ["g"], order, 5, unique="term").collect()
    assert sorted(top_k_per_group(few, ["g"], order, 5, unique="term").collect()) == sorted(want)
    assert few.count() < 200


def test_one_search_finds_all_rare_whitespace(spark):
    chars = spark.createDataFrame([(c,) for c in S.RARE_WHITESPACE], "c string")
    assert chars.filter(F.col("c").rlike(S.MAYBE_WHITESPACE)).count() == len(S.RARE_WHITESPACE)


def dated_docs(spark, repeated=False):
    import datetime as dt

    rnd = random.Random(11)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(None if i == 3 else i, None if i == 9 else i % 4 - 1, "en", " ".join(rnd.choices(vocab, k=6)),
             dt.date(2017 + rnd.randint(0, 3), 1 + i % 12, 5)) for i in range(60)]
    rows += [(5, 1, "en", "alpha beta omega", dt.date(2018, 3, 1))] * repeated
    return spark.createDataFrame(rows, "doc_id long, topic int, lang string, text string, date date").withColumn(
        "year", F.year("date"))


def test_counts_in_bins_serve_topics_over_time(spark):
    """one pass of the texts gives what counts and bins tokenised apart give; no join of the vocabulary."""
    docs = dated_docs(spark)
    counts, found = topics.term_counts(docs), topics.term_counts_in_bins(docs)
    assert physical(found).count("Exchange hashpartitioning(term") == 1
    keys = ["model_group", "topic", "term", "f"]
    assert (Counter(map(tuple, found.groupBy(*keys).agg(F.sum("n")).collect()))
            == Counter(map(tuple, counts.select(*keys, "n").collect())))
    for a, b in ((topics.topics_over_time(docs, found), topics.topics_over_time(docs, counts)),
                 (topics.topics_over_time_tuned(docs, found),
                  topics.topics_over_time_tuned(docs, counts, topics.ctfidf(counts)))):
        columns = ["topic", "bin", "bin_start", "frequency", "words"]
        rows = sorted(map(tuple, a.select(*columns).collect()))
        assert rows == sorted(map(tuple, b.select(*columns).collect())) and any(r[-1] for r in rows)


def test_counts_in_bins_need_keys_that_do_not_repeat(spark):
    assert topics.term_counts_in_bins(dated_docs(spark, repeated=True)) is None


def test_packed_counts_equal_the_counted_terms(spark, monkeypatch):
    """Packed per piece and bucket, unpacked and added up, with null keys and several pieces and settlements."""
    docs, keys = odd_docs(spark), ["model_group", "topic", "doc_id"]
    listed = topics._listed(docs, keys)
    want = Counter()
    for *k, term, n in termcount.counted_terms(listed, ["the"], True).collect():
        want[(*k, term)] += n
    got = Counter()
    for bucket, payload in termcount.packed_terms(listed, ["the"], True, 3).collect():
        named, terms, sizes, g, n = termcount.unpacked(bytes(payload))
        named, at = list(zip(*[c.to_pylist() for c in named])), 0
        for term, size in zip(terms.to_pylist(), sizes):
            for i in range(at, at + size):
                got[(*named[g[i]], term)] += int(n[i])
            at += size
        shown = spark.createDataFrame([(t,) for t in terms.to_pylist()], "t string")
        assert {r[0] for r in shown.select(termcount.bucket_of(F.col("t"), 3)).collect()} == {bucket}
    assert got == want

    monkeypatch.setattr(termcount, "PENDING", 3)
    found = termcount.Summed()
    for bucket, payload in termcount.packed_terms(listed.drop("doc_id"), ["the"], True, 1).collect():
        found.add(bytes(payload))
        found.add(bytes(payload))
    found.settle()
    sums = Counter()
    for c, g, n in zip(found.code[0], found.group[0], found.n[0]):
        sums[(*list(found.groups.number)[g], found.vocabulary[0][int(c)].as_py())] += int(n)
    twice = Counter()
    for (group, topic, _, term), n in want.items():
        twice[(group, topic, term)] += 2 * n
    assert sums == twice


def test_representative_docs_shuffle_no_row_per_document_and_term(spark):
    """rows per document and term took several times the room of the texts, twice."""
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(6)
    rows = [(i, None if i % 17 == 0 else i % 4 - 1, " ".join(rng.choices(words, k=30)) if i % 11 else None, "s", None, "t",
             f"u{i}") for i in range(120)]
    shared = [(None if i % 9 == 0 else i, *r) for i, *r in rows] + [(5, 0, "w1 w2 w3", "s", None, "t", "u5")]
    for some in (rows, shared):
        docs = topics.with_model_group(spark.createDataFrame(
            some, "doc_id long, topic int, text string, source string, date date, title string, url string"))
        counts = topics.term_counts(docs).localCheckpoint()
        weights = topics.ctfidf(counts, with_idf=True)
        got = topics.representative_docs(docs, counts, weights)
        plan = physical(got)
        if some is rows:
            assert "hashpartitioning(term" not in plan and "Join [term" not in plan
        want = topics.representative_docs(docs, counts, weights, dterms=topics.doc_terms(docs))
        assert len(got.collect()) > 20 and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_counts_in_bins_are_packed_and_added_up_in_their_bucket(spark):
    """a row per piece, topic, bin and term was shuffled, aggregated and sorted for two windows in every executor."""
    plan = physical(topics.term_counts_in_bins(dated_docs(spark)))
    assert "hashpartitioning(term_bucket" in plan and "Window [row_number() windowspecdefinition(term" not in plan
    assert "keys=[term" not in plan and "Sort [term#" not in plan
