"""The corpus pipeline on a small table with planted cases."""

import corpus_pipeline
import numpy as np
from framelens.llm import langid

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE = "the of and that with this for are was".split(), "der die und das ist nicht ein mit auf".split()


def test_stages_keep_clean_documents(spark, tmpdir_path):
    rng = np.random.default_rng(0)
    text = lambda words, n: " ".join(rng.choice(words, n)) + " " + " ".join(f"u{rng.integers(1e6)}" for _ in range(9))
    rows = [(i, text(EN if i % 2 else DE, 60), "en" if i % 2 else "de") for i in range(60)]
    bench = "one two three four five six seven eight nine ten eleven"
    rows += [(100, "123 456", "en"), (101, None, "en"), (102, rows[1][1], "en"), (103, text(EN, 60) + " " + bench, "en"),
             (104, text(EN, 60) + " password=abcdef123 end of text", "en"), (105, rows[7][1].upper() + "!", None)]
    df = spark.createDataFrame([(i, t, lang, "s", t and len(t)) for i, t, lang in rows], DOC)
    df.write.parquet(tmpdir_path + "/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(tmpdir_path + "/benchmark.parquet")
    cur, seen = spark.read.parquet(tmpdir_path + "/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, cur, tmpdir_path)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == df.columns
        out.write.parquet(f"{tmpdir_path}/{i}")
        cur = spark.read.parquet(f"{tmpdir_path}/{i}")
        seen[name] = {r["doc_id"]: r for r in cur.collect()}
    language, dedup, clean, masked, packed = seen.values()
    assert set(language) == {r[0] for r in rows} - {100, 101}
    assert set(dedup) == set(language) - {102, 105}
    assert set(clean) == set(dedup) - {103}
    assert "password" not in masked[104]["text"] and masked[104]["n_chars"] == len(masked[104]["text"])
    assert masked[0]["text"] == rows[0][1] and set(packed) == set(masked)
    assert corpus_pipeline.run(spark, tmpdir_path).count() == spark.read.parquet(f"{tmpdir_path}/4").count()


def test_stages_on_an_empty_table(spark, tmpdir_path):
    spark.createDataFrame([], DOC).write.parquet(tmpdir_path + "/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(tmpdir_path + "/benchmark.parquet")
    assert corpus_pipeline.run(spark, tmpdir_path).count() == 0
    assert langid.fit(spark.read.parquet(tmpdir_path + "/documents.parquet"))["languages"] == []
