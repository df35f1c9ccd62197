"""HTML bodies, outlets, ledger, as-of snapshots, schedule, annotation, streaming."""

import os

from pyspark.sql import functions as F

from framelens.functions.htmltext import extract_body
from framelens.operators import collection as C
from framelens.plans import queries as Q
from framelens.sources import files
from framelens.streaming.ingest import incremental_ingest

SF_CHECK = "/root/testdata/sf0.01"

P = "x" * 45


def body_of(spark, html):
    return spark.createDataFrame([(html,)], "h string").select(extract_body("h")).first()[0]


def test_body_article_first_container_and_unclosed_paragraphs(spark):
    html = (f"<html><script>var t='</p>';</script><nav><p>{P} nav</p></nav>"
            f"<article><p>{P} one<p>{P} two &amp;lt; ok</p><p>short</p></article>"
            f"<article><p>{P} second article</p></article></html>")
    assert body_of(spark, html) == f"{P} one\n{P} two &lt; ok"


def test_body_main_then_whole_page(spark):
    assert body_of(spark, f"<main><p>{P} m</p></main><p>{P} outside</p>") == f"{P} m"
    assert body_of(spark, f"<div><p>{P} a</p><!-- <p>{P} hidden</p> --></div>") == f"{P} a"
    assert body_of(spark, "<p>tiny</p>") is None


def test_outlet_match_counts_on_fixture(spark):
    got = dict(Q.q_match_outlet(spark, SF_CHECK).groupBy(
        F.when(F.col("source").isin("Outlet A", "Outlet B", "Outlet C", "Outlet D", "Other net"),
               F.col("source")).otherwise("none")).count().collect())
    assert got == {"Outlet A": 29, "Outlet B": 13, "Outlet C": 12, "Outlet D": 11,
                   "Other net": 61, "none": 124}


def test_blank_media_name_matches_nothing(spark):
    df = spark.createDataFrame([("",), ("www.example.net",)], "m string")
    got = [r[0] for r in df.select(C.outlet_match("m", [(0, "A", "example.net", "en")])).collect()]
    assert got == ["", "A"]


def test_nearest_snapshot_tie_takes_earlier(spark):
    led = spark.createDataFrame([("u", "2020-01-10"), ("v", None)], "url string, date string")
    snaps = spark.createDataFrame(
        [("u", "20200105000000", True), ("u", "20200115000000", True),
         ("u", "20200110000000", False), ("v", "20191231000000", True)],
        "url string, stamp string, available boolean")
    got = {r["url"]: r["stamp"] for r in C.nearest_snapshot(led, snaps).collect()}
    assert got == {"u": "20200105000000", "v": "20191231000000"}


def test_nearest_snapshot_follows_each_rows_own_date(spark):
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(4), datetime(2015, 1, 1)
    day = lambda n: start + timedelta(days=n)
    rows = [("u", "2019-01-01"), ("u", "2022-01-01"), ("w", "2020-05-05"), ("u", "2019-01-01"), ("x", None)]
    rows += [("hot", day(rng.randint(0, 3000)).strftime("%Y-%m-%d")) for _ in range(300)]
    points = [("u", "20190101000000"), ("u", "20220101000000"), ("x", "20200601000000"), ("x", "20200601000000")]
    points += [("hot", day(rng.choice([rng.randint(0, 90), rng.randint(2000, 3000)])).strftime("%Y%m%d%H%M%S"))
               for _ in range(200)]
    led = spark.createDataFrame(rows, "url string, date string")
    snaps = spark.createDataFrame([(*p, True) for p in points], "url string, stamp string, available boolean")
    want = set()
    for url, date in rows:
        at = datetime.strptime(date or "2020-01-01", "%Y-%m-%d")
        mine = [(abs((datetime.strptime(s, "%Y%m%d%H%M%S") - at).total_seconds()), s) for u, s in points if u == url]
        if mine:
            want.add((url, date, min(mine)[1]))
    got = [tuple(r)[:3] for r in C.nearest_snapshot(led, snaps).collect()]
    assert set(got) == want and len(got) == len(want)


def test_fetch_schedule_hot_host_exact(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(300)]
    req = spark.createDataFrame(rows, "seq long, host string")
    got = C.fetch_schedule(req, bucket_width=16).collect()
    by_host = {}
    for seq, host in rows:
        by_host.setdefault(host, []).append(seq)
    want = {(s, h): i * 7.0 for h, seqs in by_host.items() for i, s in enumerate(sorted(seqs))}
    assert {(r["seq"], r["host"]): r["offset_s"] for r in got} == want


def test_ledger_and_recovery_reconcile(spark):
    ledger = Q.q_missing_ledger(spark, SF_CHECK).count()
    merged = Q.q_recover_merge(spark, SF_CHECK)
    still = Q.q_still_missing(spark, SF_CHECK).count()
    recovered = merged.filter(F.col("retrieved_via") == "wayback").count()
    assert ledger == 87
    assert merged.filter(F.col("retrieved_via").isNull()).count() == 166
    # urls with a short live body are in the ledger and are tried again
    assert recovered + still == ledger


def test_annotation_scan_last_duplicate_wins(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "annotation.csv")
    with open(path, "w") as fh:
        fh.write("topic_id,frame_label\n0, a \nx,b\n1,c\n0,d\n2,\n")
    got = {r[0]: r[1] for r in files.read_annotation(spark, path).collect()}
    assert got == {0: "d", 1: "c"}
    assert files.read_annotation(spark, os.path.join(tmpdir_path, "absent.csv")).count() == 0


def test_raw_scan_quarantines_malformed(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "raw.jsonl")
    with open(path, "w") as fh:
        fh.write('{"id": "1", "url": "u1", "body": "b"}\n\n{broken\n{"id": "2", "title": "t"}\n')
    good, bad = files.read_raw(spark, path)
    assert good.count() == 2 and bad.count() == 1
    assert [r[0] for r in files.read_known_urls(spark, path).collect()] == ["u1"]


def test_streaming_ingest_each_url_once(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "f1.json"), "w") as fh:
        fh.write('{"url": "u1", "id": "a"}\n{"url": "u1", "id": "b"}\nnot json\n{"id": "c"}\n')
    corpus = os.path.join(tmpdir_path, "corpus")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    out = incremental_ingest(spark, src, corpus, ckpt)
    assert sorted(r["url"] for r in out.collect()) == ["u1"]
    with open(os.path.join(src, "f2.json"), "w") as fh:
        fh.write('{"url": "u1", "id": "d"}\n{"url": "u2", "id": "e"}\n')
    out = incremental_ingest(spark, src, corpus, ckpt)
    assert sorted(r["url"] for r in out.collect()) == ["u1", "u2"]
    # a rerun with nothing new changes nothing
    assert incremental_ingest(spark, src, corpus, ckpt).count() == 2


def test_export_scan_multiline_quotes_and_normalize(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "export.csv")
    with open(path, "w") as fh:
        fh.write('id,indexed_date,language,media_name,media_url,publish_date,title,url\n'
                 '1,x,en,www.cbc.ca,,2017-10-04 12:00:00,"A ""quoted""\nline",http://www.cbc.ca/a/b/\n'
                 ',x,fr,lapresse.ca,,2018-01-02,T2,https://www.lapresse.ca/c/d-1\n'
                 '3,x,en,other.org,,2019-05-06,T3,   \n')
    exp = files.read_export(spark, path)
    assert exp.count() == 3
    outlets = [(0, "CBC News", "cbc.ca", "en"), (1, "La Presse", "lapresse.ca", "fr")]
    recs = {r["url"]: r for r in C.normalize_records(exp, outlets).collect()}
    assert set(recs) == {"http://www.cbc.ca/a/b/", "https://www.lapresse.ca/c/d-1"}
    a = recs["http://www.cbc.ca/a/b/"]
    assert a["title"] == 'A "quoted"\nline' and a["date"] == "2017-10-04"
    assert a["source"] == "CBC News" and a["domain"] == "cbc.ca" and a["id"] == "1"
    b = recs["https://www.lapresse.ca/c/d-1"]
    assert b["id"] == "d-1" and b["source"] == "La Presse"


def test_append_sink_keeps_existing(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "raw")
    df = spark.createDataFrame([("1", "u1")], "id string, url string")
    files.append_records(df, path)
    files.append_records(spark.createDataFrame([("2", "u2")], "id string, url string"), path)
    good, bad = files.read_raw(spark, path)
    assert sorted(r["url"] for r in good.collect()) == ["u1", "u2"] and bad.count() == 0


def test_collection_status_reconciles(spark):
    status = Q.q_collection_status(spark, SF_CHECK)
    by = dict(status.groupBy("status").agg(F.sum("n")).collect())
    records = Q.q_normalize_records(spark, SF_CHECK).count()
    # every record is exactly one of: live, recovered, still missing
    assert sum(by.values()) == records == 250
    assert by["missing"] == Q.q_still_missing(spark, SF_CHECK).count()


def test_short_bodies_are_retried_from_available_snapshots(spark):
    body = lambda n: "<article><p>" + "w" * n + "</p></article>"
    corpus = spark.createDataFrame(
        [("1", "t", "u", "2020-01-01", "s", "d", "en", "short"), ("2", "t", "v", "2020-01-01", "s", "d", "en", None)],
        ", ".join(f"{c} string" for c in C.RAW_COLUMNS))
    records = corpus.withColumn("body", F.lit(None).cast("string"))
    ledger = C.missing_ledger(records, corpus)
    snaps = spark.createDataFrame(
        [("u", "20200101000000", False, body(900)), ("u", "20200101000000", True, body(300)),
         ("u", "20200101000000", True, body(250)), ("v", "20200101000000", False, body(300))],
        "url string, stamp string, available boolean, html string")
    merged, still = C.recover_merge(ledger, corpus, snaps)
    got = [(r["url"], len(r["body"])) for r in merged.filter("retrieved_via is not null").collect()]
    assert got == [("u", 300)]
    assert [r["url"] for r in still.collect()] == ["v"]


def test_bad_ledger_date_does_not_end_the_job(spark):
    from framelens.operators.collection import nearest_snapshot

    ledger = spark.createDataFrame([("u", "bad"), ("v", "2020-01-02")], "url string, date string")
    snaps = spark.createDataFrame([("u", "20200101000000", True), ("v", "20200101000000", True),
                                   ("v", "junk", True)], "url string, stamp string, available boolean")
    got = {r["url"]: r["stamp"] for r in nearest_snapshot(ledger, snaps).collect()}
    assert got == {"u": "20200101000000", "v": "20200101000000"}


def test_export_columns_are_taken_by_name(spark, tmpdir_path):
    from framelens.sources.files import read_export, read_raw

    with open(tmpdir_path + "/e.csv", "w") as fh:
        fh.write("url,id\nhttp://x,7\n")
    row = read_export(spark, tmpdir_path + "/e.csv").first()
    assert row["id"] == "7" and row["url"] == "http://x"
    with open(tmpdir_path + "/r.json", "w") as fh:
        fh.write('{"url": "u"}\n[1,2]\n3\n')
    good, bad = read_raw(spark, tmpdir_path + "/r.json")
    assert good.count() == 1 and bad.count() == 2
