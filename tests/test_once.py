"""Costly expressions stand once in the plan, so a text or page is worked through once."""

from pyspark.sql import functions as F

from framelens.functions.htmltext import extract_body
from framelens.operators import langid, topics


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def articles(spark):
    return spark.createDataFrame([(1, 0, "Voters went to the polls"), (2, 1, "the polls opened early"), (3, 1, None)],
                                 "doc_id long, topic int, text string")


def test_texts_are_tokenised_once(spark):
    """Neither the bigrams nor the filter of the explode repeat the tokeniser."""
    assert plan(topics.term_counts(articles(spark))).count("regexp_extract_all") == 1
    assert plan(topics.doc_terms(articles(spark))).count("regexp_extract_all") == 1


def test_pages_are_extracted_once(spark):
    """Every step of the extraction reads the bound result of the one before."""
    page = spark.createDataFrame([("<p>" + "word " * 20 + "</p>",)], "html string")
    body = page.select(extract_body("html").alias("body"))
    assert plan(body).count("<!--") == 1
    assert body.first()["body"] == ("word " * 20).strip()


def test_profiles_are_written_once(spark):
    """profile and constants follow from a written table, not each from the texts."""
    docs = spark.createDataFrame([(1, "bonjour le monde", "fr"), (2, "hello world", "en")],
                                 "doc_id long, text string, lang string")
    profile, consts = langid.train_profiles(docs)
    assert "MapInArrow" not in plan(profile) + plan(consts)
    found = langid.detect_language(docs, profile, consts)
    assert {r["doc_id"]: r["lang"] for r in found.collect()} == {1: "fr", 2: "en"}
    assert profile.filter(F.col("tri") == "ell").count() == 1


def test_bin_counts_repeat_the_rows_of_a_document(spark):
    """Texts meet their bins before tokenising with the counts of the document x term table's join."""
    docs = topics.with_model_group(articles(spark).unionByName(articles(spark).limit(1)))
    binned = docs.select("model_group", "doc_id", (F.col("doc_id") % 2).cast("int").alias("bin"))
    keys = ["model_group", "topic", "bin", "term"]
    old = (topics.doc_terms(docs).join(binned, ["model_group", "doc_id"])
           .groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, "n"))
    new = topics.bin_terms(docs, binned).select(*keys, "n")
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, new.collect()))
