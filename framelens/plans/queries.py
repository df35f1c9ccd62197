"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through the views in ``views.py`` and
runs over whole tables and whole texts. Doubles are rounded to 6 places and
dates rendered as text only at this edge, for the comparison with SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import scalars as S
from ..functions.htmltext import extract_body
from ..functions.scalars import clean_text
from ..operators import clustering as K
from ..operators import collection as C
from ..operators import corpus, frames, langid, modeling, stats, topics
from ..operators.density_tree import hierarchical_clusters
from ..operators.neighbours import nearest_neighbours
from ..operators.spectral import spectral_dims
from ..params import DEFAULT, Params
from ..session import cut_lineage, ensure_checkpoint_dir
from ..streaming.ingest import incremental_ingest
from . import views
from .pipeline import preprocess_with_detection

def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields])


class ArticlePlan:
    """The study's analysis chain over the article view, built lazily once."""

    def __init__(self, spark: SparkSession, d: str, params: Params = DEFAULT):
        self.spark, self.d, self.params = spark, d, params
        self._prep = None
        self._counts = None
        self._bin_counts = None
        self._summary = None

    def raw(self) -> DataFrame:
        return views.articles(self.spark, self.d)

    def articles(self) -> DataFrame:
        """The ARTICLE table."""
        return topics.with_model_group(corpus.preprocess(self.raw(), params=self.params), self.params)

    def prep(self) -> DataFrame:
        """The ARTICLE table without the bodies, which ``text`` repeats; cached because sizes,
        terms and frames all read it."""
        if self._prep is None:
            self._prep = self.articles().drop("body").persist()
        return self._prep

    def counts(self) -> DataFrame:
        """Topic x term counts: read three times by c-TF-IDF, so cached once.

        Aggregated straight to topics. Keys that need documents too tokenise the cached
        texts again, which costs less than keeping a row per document and term.
        """
        if self._counts is None:
            self._counts = topics.term_counts(self.prep(), self.params).persist()
        return self._counts

    def bin_counts(self) -> DataFrame | None:
        """Topic x time bin x term counts, cached; None where documents share an id."""
        if self._bin_counts is None:
            found = topics.term_counts_in_bins(self.prep(), self.params)
            self._bin_counts = found.persist() if found is not None else None
        return self._bin_counts

    def weights(self) -> DataFrame:
        return topics.ctfidf(self.counts())

    def idf_weights(self) -> DataFrame:
        return topics.ctfidf(self.counts(), with_idf=True)

    def summary(self) -> DataFrame:
        """Topic table (one row per topic): cached, every frame key joins it."""
        if self._summary is None:
            self._summary = topics.topic_summary(self.prep(), self.weights(), self.params).persist()
        return self._summary

    def names(self) -> DataFrame:
        return frames.frame_names(topics.topic_names(self.summary()),
                                  views.frame_annotation(self.spark))

    def framed(self) -> DataFrame:
        return frames.framed(self.prep(), self.names())

    def contingency(self) -> DataFrame:
        return frames.frame_contingency(self.framed())


def q_clean_text(spark, d):
    raw = views.articles(spark, d)
    return raw.select("doc_id", clean_text("body").alias("body_clean"),
                      clean_text(F.coalesce(F.col("title"), F.lit(""))).alias("title_clean"))


def q_compose_text(spark, d):
    return corpus.clean_articles(views.articles(spark, d)).select("doc_id", "text")


def q_drop_stubs(spark, d):
    return (corpus.drop_stubs(corpus.clean_articles(views.articles(spark, d)))
            .select("doc_id", "url", F.length("body").alias("body_chars")))


def q_dedup_articles(spark, d):
    df = corpus.drop_stubs(corpus.clean_articles(views.articles(spark, d)))
    return corpus.dedup_articles(df).select("doc_id", "url")


def q_date_year(spark, d):
    return ArticlePlan(spark, d).prep().select(
        "doc_id", F.col("date").cast("string").alias("date"), "year")


def q_preprocess(spark, d):
    return ArticlePlan(spark, d).articles().select(
        "doc_id", "title", "body", "text", F.col("date").cast("string").alias("date"),
        "year", "source", "domain", "lang", "url")


def q_corpus_split(spark, d):
    return corpus.corpus_split_counts(ArticlePlan(spark, d).prep())


def q_volume_counts(spark, d):
    return corpus.volume_counts(ArticlePlan(spark, d).prep())


def q_attrition(spark, d):
    return corpus.attrition(views.articles(spark, d))


def q_term_counts(spark, d):
    return ArticlePlan(spark, d).counts().select("model_group", "topic", "term", "n")


def q_ctfidf(spark, d):
    return rounded(ArticlePlan(spark, d).weights().select("model_group", "topic", "term", "n",
                                                          "weight"))


def q_topic_keywords(spark, d):
    p = ArticlePlan(spark, d)
    return rounded(topics.topic_keywords(p.weights(), 10)
                   .select("model_group", "topic", "rank", "term", "weight"))


def q_topic_summary(spark, d):
    return ArticlePlan(spark, d).summary()


def q_assign_frame(spark, d):
    return ArticlePlan(spark, d).names()


def q_frames_over_time(spark, d):
    return rounded(frames.frames_over_time(ArticlePlan(spark, d).framed()))


def q_compare_lang(spark, d):
    return rounded(frames.compare_lang(ArticlePlan(spark, d).framed()))


def q_frame_contingency(spark, d):
    return ArticlePlan(spark, d).contingency()


def q_expected_counts(spark, d):
    return rounded(frames.expected_counts(ArticlePlan(spark, d).contingency()))


def q_chi_square(spark, d):
    exp = frames.expected_counts(ArticlePlan(spark, d).contingency())
    res = stats.chi_square(exp)
    tail = F.when(F.col("p_value") > 0, F.round(-F.log("p_value"), 6)).alias("neg_ln_p")
    return rounded(res.select("*", tail))


def q_cramers_v(spark, d):
    """Effect size alone, full precision of the test's row."""
    exp = frames.expected_counts(ArticlePlan(spark, d).contingency())
    return rounded(stats.chi_square(exp).select("n", "cramers_v"))


def q_tokenize(spark, d):
    """Unigrams and bigrams of every article, in order, joined by ``|``."""
    toks = topics.tokenize(ArticlePlan(spark, d).prep())
    return toks.select("doc_id", F.size("terms").cast("long").alias("n_terms"),
                       F.array_join("terms", "|").alias("terms"))


def q_annotation_gaps(spark, d):
    p = ArticlePlan(spark, d)
    info = p.summary().select(F.col("topic_id").alias("topic"))
    return frames.annotation_gaps(views.frame_annotation(spark), info)


def q_annotation_template(spark, d):
    return frames.annotation_template(ArticlePlan(spark, d).summary())


QUERIES = {
    "clean_text": q_clean_text,
    "compose_text": q_compose_text,
    "drop_stubs": q_drop_stubs,
    "dedup_articles": q_dedup_articles,
    "date_year": q_date_year,
    "preprocess": q_preprocess,
    "corpus_split": q_corpus_split,
    "volume_counts": q_volume_counts,
    "attrition": q_attrition,
    "term_counts": q_term_counts,
    "ctfidf": q_ctfidf,
    "topic_keywords": q_topic_keywords,
    "topic_summary": q_topic_summary,
    "assign_frame": q_assign_frame,
    "frames_over_time": q_frames_over_time,
    "compare_lang": q_compare_lang,
    "frame_contingency": q_frame_contingency,
    "expected_counts": q_expected_counts,
    "chi_square": q_chi_square,
    "cramers_v": q_cramers_v,
    "tokenize": q_tokenize,
    "annotation_gaps": q_annotation_gaps,
    "annotation_template": q_annotation_template,
}


# ---------------------------------------------------------------------------
# Collection, recovery and scalar keys over the export / page views
# ---------------------------------------------------------------------------

DISCOVERY_KEYWORDS = ("4chan", "far right")
LANG_NAMES_OF_SEGMENT = (("en", "English"), ("fr", "French"), ("es", "Spanish"), ("de", "German"))


def _records(spark, d):
    return C.normalize_records(views.media_export(spark, d), views.FIXTURE_OUTLETS)


def _known(spark, d):
    p = views.table(spark, d, "pages", "page_id")
    return p.filter(F.col("page_id") % 3 != 0).select("url").distinct()


def _live_corpus(spark, d):
    """First collection pass: the known pages with their extracted bodies, written once
    (every later step reads that table, as the study reads its corpus file)."""
    recs = _records(spark, d).join(_known(spark, d), "url", "left_semi")
    return cut_lineage(C.with_bodies(recs, views.table(spark, d, "pages", "page_id")))


def _ledger(spark, d, live=None):
    live = _live_corpus(spark, d) if live is None else live
    return cut_lineage(C.missing_ledger(_records(spark, d), live))


def _recovered(spark, d):
    """(merged corpus, still missing) of the recovery over the written corpus and ledger."""
    live = _live_corpus(spark, d)
    return C.recover_merge(_ledger(spark, d, live), live, views.snapshot_index(spark, d))


def q_canon_domain(spark, d):
    e = views.media_export(spark, d)
    return e.select("id", "media_name", S.canon_domain("media_name").alias("domain"),
                    S.canon_domain("url").alias("canon_url"))


def q_url_slug(spark, d):
    return views.media_export(spark, d).select("id", S.url_slug("url").alias("slug"))


def q_url_host(spark, d):
    return views.media_export(spark, d).select("id", S.url_host("url").alias("host"))


def q_normalize_date(spark, d):
    e = views.media_export(spark, d)
    seen = F.concat(F.regexp_replace("publish_date", "-", ""), F.lit("T120000Z"))
    return e.select("id", S.normalize_publish_date("publish_date").alias("date"),
                    S.normalize_seendate(seen).alias("seen_date"),
                    S.normalize_seendate(F.col("language")).alias("not_a_date"))


def _language_name(segment):
    out = None
    for code, name in LANG_NAMES_OF_SEGMENT:
        cond = F.col(segment) == code
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.col(segment))


def q_lang_hint(spark, d):
    e = views.media_export(spark, d)
    return e.select("id", S.lang_hint(_language_name("language"),
                                      C.outlet_default_lang("media_name", views.FIXTURE_OUTLETS))
                    .alias("lang"))


def q_keyword_query(spark, d):
    doms = _records(spark, d).select("domain").distinct()
    return C.discovery_plan(doms, DISCOVERY_KEYWORDS, "2017-01-01", "2025-12-31")


def q_match_outlet(spark, d):
    e = views.media_export(spark, d)
    return e.select("id", "media_name",
                    C.outlet_match("media_name", views.FIXTURE_OUTLETS).alias("source"))


def q_normalize_records(spark, d):
    return _records(spark, d)


def _responses(spark, d):
    """One landed discovery response (JSON text) per page of a configured outlet."""
    e = views.media_export(spark, d, keep_html=True)
    ords = None
    for o in views.FIXTURE_OUTLETS:
        dom = S.canon_domain(F.lit(o[2]))
        m = S.canon_domain("media_name")
        cond = (F.length(m) > 0) & ((m == dom) | m.contains(dom) | dom.contains(m))
        ords = F.when(cond, o[0]) if ords is None else ords.when(cond, o[0])
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    art = F.struct(F.col("url"), F.concat(F.lit("  "), title, F.lit(" ")).alias("title"),
                   F.concat(F.regexp_replace("publish_date", "-", ""), F.lit("T120000Z"))
                   .alias("seendate"),
                   _language_name("language").alias("language"))
    return (e.select("id", ords.alias("outlet_ord"),
                                   F.to_json(F.struct(F.array(art).alias("articles")))
                                   .alias("response"))
             .filter(F.col("outlet_ord").isNotNull()))


def q_ingest_artlist(spark, d):
    return C.ingest_artlist(_responses(spark, d), views.FIXTURE_OUTLETS)


def q_known_urls(spark, d):
    return _known(spark, d)


def q_todo_urls(spark, d):
    return C.todo_urls(_records(spark, d), _known(spark, d)).select("url", "id")


def q_extract_body(spark, d):
    p = views.table(spark, d, "pages", "page_id")
    return p.select("page_id", extract_body("html").alias("body"))


def q_missing_ledger(spark, d):
    return _ledger(spark, d)


def q_nearest_snapshot(spark, d):
    return C.nearest_snapshot(_ledger(spark, d), views.snapshot_index(spark, d))


def q_fetch_schedule(spark, d):
    req = C.page_requests(views.table(spark, d, "pages", "page_id"))
    return C.fetch_schedule(req).select("seq", "host", "slot", "offset_s")


def q_latest_per_outlet(spark, d):
    return C.latest_per_outlet(_records(spark, d)).select("source", "url", "date", "rank")


def q_collect_merge(spark, d):
    merged = C.collect_merge(_records(spark, d), _live_corpus(spark, d),
                             views.table(spark, d, "pages", "page_id"))
    return merged.select("id", "url", "source", "lang", "date",
                         F.length("body").alias("body_chars"))


def q_recover_merge(spark, d):
    merged, _ = _recovered(spark, d)
    return merged.select("id", "url", "source", "date", F.length("body").alias("body_chars"),
                         "retrieved_via")


def q_still_missing(spark, d):
    _, still = _recovered(spark, d)
    return still


QUERIES.update({
    "canon_domain": q_canon_domain,
    "url_slug": q_url_slug,
    "url_host": q_url_host,
    "normalize_date": q_normalize_date,
    "lang_hint": q_lang_hint,
    "discovery_plan": q_keyword_query,
    "match_outlet": q_match_outlet,
    "normalize_records": q_normalize_records,
    "ingest_artlist": q_ingest_artlist,
    "known_urls": q_known_urls,
    "todo_urls": q_todo_urls,
    "extract_body": q_extract_body,
    "missing_ledger": q_missing_ledger,
    "nearest_snapshot": q_nearest_snapshot,
    "fetch_schedule": q_fetch_schedule,
    "latest_per_outlet": q_latest_per_outlet,
    "collect_merge": q_collect_merge,
    "recover_merge": q_recover_merge,
    "still_missing": q_still_missing,
})


# ---------------------------------------------------------------------------
# Language identification
# ---------------------------------------------------------------------------


def language_model(spark, d, params: Params = DEFAULT):
    """Profiles trained on the labelled rows (``label_train_mod``), written once."""
    docs = views.table(spark, d, "documents", "doc_id")
    labelled = docs.filter(F.col("doc_id") % params.label_train_mod == 0)
    return tuple(cut_lineage(t) for t in langid.train_profiles(labelled, "doc_id", "text", "lang"))


def q_detect_language(spark, d):
    profile, consts = language_model(spark, d)
    return langid.detect_language(views.table(spark, d, "documents", "doc_id"), profile, consts)


QUERIES["detect_language"] = q_detect_language
QUERIES["detect_language_join"] = q_detect_language     # the key of the one form that is left


# ---------------------------------------------------------------------------
# Topic keys that need the document table too
# ---------------------------------------------------------------------------
def q_topics_over_time(spark, d):
    p = ArticlePlan(spark, d)
    found = p.bin_counts()
    out = topics.topics_over_time(p.prep(), p.counts() if found is None else found)
    return out.select("model_group", "topic", "bin", F.col("bin_start").cast("string").alias("bin_start"),
                      "frequency", "words")


def q_representative_docs(spark, d):
    p = ArticlePlan(spark, d)
    out = topics.representative_docs(p.prep(), p.counts(), p.idf_weights())
    return rounded(out.select("model_group", "topic", "doc_id", "score", "rank", "source",
                              F.col("date").cast("string").alias("date"), "title", "url"))


QUERIES["topics_over_time"] = q_topics_over_time
QUERIES["representative_docs"] = q_representative_docs


# ---------------------------------------------------------------------------
# Vectors, graph and clusters over the embeddings table
# ---------------------------------------------------------------------------


def _vectors(spark, d):
    return views.table(spark, d, "embeddings", "vec_id").select("vec_id", "embedding")


def q_knn_graph(spark, d):
    nodes = K.collapse_copies(_vectors(spark, d))
    return K.eps_edges(nodes)


def q_nearest_neighbours(spark, d):
    return rounded(nearest_neighbours(_vectors(spark, d)))


def q_hierarchical_clusters(spark, d):
    """Condensed-tree clusters of the reduced vectors, as the study clusters."""
    reduced = K.reduce_dims(_vectors(spark, d))
    return rounded(hierarchical_clusters(cut_lineage(reduced), col="reduced"))


def q_density_clusters(spark, d):
    return K.density_clusters(_vectors(spark, d))


def q_assign_topics(spark, d):
    return rounded(K.assign_topics(_vectors(spark, d)))


def q_topic_probability(spark, d):
    v = _vectors(spark, d)
    return rounded(K.topic_probability(v, K.density_clusters(v)))


def q_reduce_dims(spark, d):
    out = K.reduce_dims(_vectors(spark, d))
    return out.select("vec_id", *[F.round(F.col("reduced")[i], 6).alias(f"c{i}") for i in range(5)])


def q_spectral_dims(spark, d):
    """Coordinates on the neighbour graph, up to sign; with the largest residual of the vectors."""
    found = spectral_dims(_vectors(spark, d))
    worst = float(found.residuals.max()) if len(found.residuals) else 0.0
    return found.coords.select("vec_id", *[F.round(F.col("reduced")[i], 6).alias(f"c{i}") for i in range(5)],
                               F.lit(round(worst, 6)).alias("residual"))


def q_embed_docs(spark, d):
    docs = ArticlePlan(spark, d).prep()
    out = K.embed_docs(docs)
    stored = F.unwrap_udt("features")["values"]          # the filled entries: no row is ever 2^18 wide
    return out.select("doc_id", F.size(F.filter(stored, lambda x: x != 0)).alias("nnz"),
                      F.round(F.sqrt(F.aggregate(stored, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


QUERIES.update({
    "knn_graph": q_knn_graph,
    "density_clusters": q_density_clusters,
    "nearest_neighbours": q_nearest_neighbours,
    "hierarchical_clusters": q_hierarchical_clusters,
    "assign_topics": q_assign_topics,
    "topic_probability": q_topic_probability,
    "reduce_dims": q_reduce_dims,
    "spectral_dims": q_spectral_dims,
    "embed_docs": q_embed_docs,
})


# ---------------------------------------------------------------------------
# Streaming ingest over the pages table (one availableNow pass)
# ---------------------------------------------------------------------------



def q_incremental_ingest(spark, d):
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/ingest-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/pages.parquet").schema
    corpus = incremental_ingest(spark, f"{d}/pages*.parquet", f"{base}/corpus", f"{base}/state",
                                fmt="parquet", schema=schema)
    return corpus.select("url")


QUERIES["incremental_ingest"] = q_incremental_ingest


# ---------------------------------------------------------------------------
# Whole preprocessing with language identification, and topic reduction
# ---------------------------------------------------------------------------


def q_preprocess_detect(spark, d):
    return preprocess_with_detection(spark, d).select(
        "doc_id", "lang", F.col("date").cast("string").alias("date"), "year", "url")


QUERIES["preprocess_detect"] = q_preprocess_detect


def q_collection_status(spark, d):
    return C.collection_status(*_recovered(spark, d))


QUERIES["collection_status"] = q_collection_status


def q_wordcloud_weights(spark, d):
    p = ArticlePlan(spark, d)
    return rounded(topics.topic_word_weights(p.summary(), p.weights())
                   .select("model_group", "topic", "topic_rank", "rank", "term", "weight"))


QUERIES["wordcloud_weights"] = q_wordcloud_weights


def q_stable_clusters(spark, d):
    return K.stable_clusters(_vectors(spark, d))


QUERIES["stable_clusters"] = q_stable_clusters


def q_topics_over_time_tuned(spark, d):
    p = ArticlePlan(spark, d)
    found = p.bin_counts()
    out = (topics.topics_over_time_tuned(p.prep(), p.counts(), p.idf_weights()) if found is None
           else topics.topics_over_time_tuned(p.prep(), found))
    return out.select("model_group", "topic", "bin", F.col("bin_start").cast("string").alias("bin_start"),
                      "frequency", "words")


QUERIES["topics_over_time_tuned"] = q_topics_over_time_tuned


def q_text_topics(spark, d):
    """Topics fitted on the articles' own texts."""
    return rounded(modeling.assigned(modeling.fit_topics(ArticlePlan(spark, d).prep())))


def q_reduce_topics(spark, d, nr_topics: int = 15):
    """Old -> new topic after merging the most similar topics down to ``nr_topics``."""
    p = ArticlePlan(spark, d)
    return topics.reduce_topics(p.prep(), p.counts(), nr_topics)


QUERIES["text_topics"] = q_text_topics
QUERIES["reduce_topics"] = q_reduce_topics
