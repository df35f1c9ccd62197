"""End-to-end runs: preprocessing with language identification, topics,
frames and the test, written as durable tables (the study's runner)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, frames, langid, modeling, stats, topics
from ..params import DEFAULT, Params
from ..session import cut_lineage
from ..sources import files
from . import views


def preprocess_with_detection(spark: SparkSession, d: str, params: Params = DEFAULT) -> DataFrame:
    """#74 in order: clean -> stubs -> dedup -> detected language -> date.

    The language model is trained on the labelled rows of ``documents``
    (``label_train_mod``) and scores the surviving articles' whole texts.
    """
    raw = views.articles(spark, d)
    # written once: the scoring and the final join both read the survivors
    survivors = cut_lineage(
        corpus.dedup_articles(corpus.drop_stubs(corpus.clean_articles(raw, params), params)))
    docs = views.table(spark, d, "documents", "doc_id")
    profile, consts = langid.train_profiles(docs.filter(F.col("doc_id") % params.label_train_mod == 0))
    detected = langid.detect_language(survivors, profile, consts, "doc_id", "text", "lang", params)
    # detect_language already applies the rule: accepted code, else the hint
    tagged = survivors.drop("lang").join(detected.select("doc_id", "lang"), "doc_id")
    return corpus.date_year(tagged)


def run_analysis(spark: SparkSession, d: str, out: str, params: Params = DEFAULT,
                 fit: bool = True) -> dict:
    """Write the corpus (split by language), topic tables, frame tables and the test.

    Topics are fitted on the texts; with ``fit=False`` the articles' given
    ``topic`` column is used (assignments of an earlier run).
    """
    articles = topics.with_model_group(preprocess_with_detection(spark, d, params), params)
    articles = corpus.ensure_not_empty(articles)
    corpus.write_corpus(articles.drop("model_group"), f"{out}/articles")
    art = spark.read.parquet(f"{out}/articles")            # durable ARTICLE table
    art = topics.with_model_group(art, params)
    if fit:
        found = modeling.assigned(modeling.fit_topics(art, params))
        found.write.mode("overwrite").parquet(f"{out}/assignments")
        art = art.drop("topic").join(
            spark.read.parquet(f"{out}/assignments").drop("probability"), ["model_group", "doc_id"])
    counts = topics.term_counts(art, params)
    weights = topics.ctfidf(counts)
    summary = topics.topic_summary(art, weights, params)
    files.save_topic_model(f"{out}/model", art.select("model_group", "doc_id", "topic"),
                           weights, summary)
    model = files.load_topic_model(spark, f"{out}/model")
    names = frames.frame_names(topics.topic_names(model["topic_info"]),
                               views.frame_annotation(spark))
    fr = frames.framed(art, names)
    over_time = frames.frames_over_time(fr)
    by_lang = frames.compare_lang(fr)
    cont = frames.frame_contingency(fr)
    result = stats.chi_square(frames.expected_counts(cont), params)
    files.write_report(over_time, f"{out}/temporal_analysis", order_by=["year", "frame"])
    files.write_report(by_lang, f"{out}/comparative", order_by=["frame", "lang"])
    files.write_report(cont, f"{out}/chi2_contingency", order_by=["lang", "frame"])
    files.write_report(result, f"{out}/chi2_result")
    files.write_annotation_template(frames.annotation_template(model["topic_info"]),
                                    f"{out}/annotation_template")
    return {"articles": art.count(), "result": result.first().asDict()}
