"""The plain stopword lists equal the library defaults, and need no jar."""

import glob

from pyspark.ml.feature import StopWordsRemover

from framelens.functions.stopwords import spark_stopwords, topic_stopwords
from framelens.plans import oracle


def test_lists_equal_the_defaults(spark):
    for language in ("english", "french"):
        assert list(spark_stopwords(language)) == StopWordsRemover.loadDefaultStopWords(language)


def test_sql_needs_no_jar_folder(monkeypatch):
    monkeypatch.setattr(glob, "glob", lambda *a, **k: [])
    topic_stopwords.cache_clear()
    assert len(oracle.oracle_queries()) >= 52


def test_a_broken_group_leaves_the_others(monkeypatch):
    def broken():
        raise ValueError("broken")
    monkeypatch.setattr(oracle, "wordcloud_queries", broken)
    left = oracle.oracle_queries()
    assert "wordcloud_weights" not in left and "preprocess" in left
