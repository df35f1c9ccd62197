"""Cleaning, discovery helpers and URL scalars (the study's unit cases, on DataFrames)."""

from pyspark.sql import functions as F

from framelens.functions import scalars as S


def one(spark, value, fn, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(fn("x").alias("y")).first()["y"]


def test_clean_text_drops_lines_with_a_phrase(spark):
    raw = "Voters went to the polls.\nSUBSCRIBE NOW for more\nTurnout   was\thigh."
    assert one(spark, raw, S.clean_text) == "Voters went to the polls. Turnout was high."


def test_clean_text_null_is_empty(spark):
    assert one(spark, None, S.clean_text) == ""


def test_clean_text_python_line_breaks_and_unicode_space(spark):
    raw = "a\x1cnewsletter here\x1db c 　d"
    assert one(spark, raw, S.clean_text) == "a b c d"


def test_keyword_query_quotes_multiword(spark):
    df = spark.createDataFrame([("far right", "cbc.ca"), ("4chan", "cbc.ca")], "k string, d string")
    got = [r[0] for r in df.select(S.keyword_query("k", "d")).collect()]
    assert got == ['"far right" domainis:cbc.ca', "4chan domainis:cbc.ca"]


def test_normalize_seendate(spark):
    assert one(spark, "20230815T120000Z", S.normalize_seendate) == "2023-08-15"
    assert one(spark, "bad", S.normalize_seendate) == "bad"
    assert one(spark, "2017-10-04 12:00:00", S.normalize_publish_date) == "2017-10-04"


def test_lang_hint(spark):
    df = spark.createDataFrame([("English", "fr"), ("French", "en"), ("Spanish", "fr"),
                                ("Spanish", None)], "n string, d string")
    got = [r[0] for r in df.select(S.lang_hint("n", "d")).collect()]
    assert got == ["en", "fr", "fr", "unknown"]


def test_url_scalars(spark):
    df = spark.createDataFrame([("https://www.cbc.ca/news/a-b-1.23/",)], "u string")
    r = df.select(S.canon_domain("u").alias("c"), S.url_slug("u").alias("s"),
                  S.url_host("u").alias("h")).first()
    assert r["s"] == "a-b-1.23" and r["h"] == "www.cbc.ca"
    assert one(spark, "https://www.cbc.ca/", S.canon_domain) == "cbc.ca"
    assert one(spark, "https://x.org", S.url_slug) == "x.org"


def test_compose_and_parse_date(spark):
    df = spark.createDataFrame([("", "body", "2020-02-03"), ("T", "b", "bad")],
                               "t string, b string, d string")
    rows = df.select(S.compose_text("t", "b").alias("x"), S.parse_date("d").alias("dt")).collect()
    assert rows[0]["x"] == ". body" and str(rows[0]["dt"]) == "2020-02-03"
    assert rows[1]["dt"] is None


def test_clean_text_agrees_with_the_line_by_line_rule(spark):
    """Texts without a phrase skip the search of their lines; the outcome is the rule's."""
    texts = ["a\n\nb  c\t d", "  x　\r\ny\x85z ", "NEWSLETTER\nkept\n\n\n\n\n  end ", "one\x1ctwo CooKie",
             "© x\ny", "a     b", "\n", " cookie rest\x0bsub", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lines = F.filter(F.split("t", S.LINE_BREAK), lambda ln: ~ln.rlike(S.boilerplate_pattern()))
    rule = F.coalesce(F.trim(F.regexp_replace(F.array_join(lines, " "), S.WHITESPACE_RUN, " ")), F.lit(""))
    for row in df.select("t", S.clean_text("t").alias("got"), rule.alias("rule")).collect():
        assert row["got"] == row["rule"], repr(row["t"])


def test_every_whitespace_character_collapses(spark):
    """The plain-text test knows every character of the whitespace pattern."""
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0xD800)], "c string")
    matched = {r["c"] for r in chars.filter(F.col("c").rlike(f"^{S.WHITESPACE_RUN}$")).collect()}
    assert matched == {" ", "\n", *S.RARE_WHITESPACE}
