"""Topic representation: tokens, class-based TF-IDF, keywords, names, time.

Every table after ``term_counts`` is keyed by ``(model_group, topic, term)``;
documents are touched once, in one exploding pass with a partial aggregation.
``model_group`` is ``'all'`` for the unified strategy or the language for the
split strategy, so the split strategy is a key, not a loop.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stopwords import topic_stopwords
from ..params import DEFAULT, Params
from .termcount import bucket_of, counted_terms, folded_best, packed_rows, packed_terms, summed_terms, weighted_products
from .topk import top_k_candidates, top_k_per_group

# Lower-cased runs of two or more word characters (letters, digits, '_').
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

BUCKET_ROWS = 1 << 20      # weights that a task holds while documents pass


def with_model_group(docs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Add ``model_group``: ``'all'`` (unified) or the language (split)."""
    if "model_group" in docs.columns:
        return docs
    g = F.lit("all") if params.strategy == "unified" else F.col("lang")
    return docs.withColumn("model_group", g)


def _found(text_col: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def tokenize(docs: DataFrame, text_col: str = "text", params: Params = DEFAULT) -> DataFrame:
    """Add ``terms``: unigrams without stopwords, then bigrams of those.

    Each of the two arrays leaves a one-element ``inline``: the optimizer does
    not copy generator output into later expressions (the bigrams read the
    words five times, an ``explode`` adds a filter on its array), so a text is
    tokenised once.
    """
    stop = topic_stopwords(tuple(params.protected_terms))
    empty = F.array().cast("array<string>")
    words = F.coalesce(F.filter(_found(text_col), lambda w: ~w.isin(stop)), empty)
    name = "terms" if params.ngram_max < 2 else "_words"
    out = docs.select("*", F.inline(F.array(F.struct(words.alias(name)))))
    if params.ngram_max < 2:
        return out
    pairs = F.when(F.size("_words") >= 2, F.zip_with(
        F.slice("_words", F.lit(1), F.size("_words") - 1),
        F.slice("_words", F.lit(2), F.size("_words") - 1),
        lambda x, y: F.concat_ws(" ", x, y))).otherwise(empty)
    return out.select("*", F.inline(F.array(F.struct(F.concat("_words", pairs).alias("terms"))))).drop("_words")


def _listed(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    return docs.select(*keys, F.coalesce(F.array_join(_found(text_col), " "), F.lit("")).alias("_words"))


def partial_terms(docs: DataFrame, keys: list[str], params: Params = DEFAULT, text_col: str = "text") -> DataFrame:
    """``(keys..., term, n)`` with the terms of ``tokenize``, partly added up and dealt out by term.

    The pieces are added up before the shuffle, which is by the term alone:
    the sums per term and any keys, and windows over a term, need no other.
    """
    stop = topic_stopwords(tuple(params.protected_terms))
    return counted_terms(_listed(docs, keys, text_col), stop, params.ngram_max >= 2).repartition("term")


def _vocabulary(docs: DataFrame, keys: list[str], params: Params) -> DataFrame:
    """``(keys..., term, n, f)`` of the terms in at least ``min_df`` topics; ``f`` counts a term over its model group.

    The counts are shuffled packed, by buckets of terms.
    """
    listed = _listed(docs, keys)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = packed_terms(listed, topic_stopwords(tuple(params.protected_terms)), params.ngram_max >= 2, buckets)
    dealt = packed.withColumnRenamed("bucket", "term_bucket").repartition(buckets, "term_bucket").sortWithinPartitions("term_bucket")
    return summed_terms(dealt, listed.schema.fields[:-1], params.min_df)


def doc_terms(docs: DataFrame, params: Params = DEFAULT, key: str = "doc_id") -> DataFrame:
    """``(model_group, topic, key, term, n)`` term counts per document."""
    return (partial_terms(with_model_group(docs, params), ["model_group", "topic", key], params)
            .groupBy("term", key, "topic", "model_group")
            .agg(F.sum("n").alias("n"))
            .select("model_group", "topic", key, "term", "n"))


def term_counts(docs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per-topic term counts, kept only for terms seen in >= ``min_df`` topics."""
    counts = _vocabulary(with_model_group(docs, params), ["model_group", "topic"], params)
    return counts.select("model_group", "topic", "term", "n", "f")


def term_counts_from_docs(dterms: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per-topic term counts from per-document counts (no second tokenisation)."""
    counts = dterms.groupBy("model_group", "topic", "term").agg(F.sum("n").alias("n"))
    return min_df_filter(counts, params)


def min_df_filter(counts: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Keep terms that occur in at least ``min_df`` topics (class documents).

    The same (model_group, term) window also yields ``f``, the term's total
    count over all topics, so the idf needs no further shuffle of the
    vocabulary-sized table.
    """
    # a term's window holds at most one row per topic, so it stays small; sorts compare the first
    # key's leading bytes fastest, so the term comes first and the group, often one, last
    w = Window.partitionBy("term", "model_group")
    return (counts.withColumn("_n_topics", F.count(F.lit(1)).over(w))
                  .withColumn("f", F.sum("n").over(w))
                  .filter(F.col("_n_topics") >= params.min_df).drop("_n_topics"))


def _with_f(counts: DataFrame) -> DataFrame:
    if "f" in counts.columns:
        return counts
    return counts.withColumn("f", F.sum("n").over(Window.partitionBy("term", "model_group")))


def _class_constants(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-topic token totals, per-group A = int(mean tokens per topic)); both small."""
    totals = counts.groupBy("model_group", "topic").agg(F.sum("n").alias("total"))
    avg = totals.groupBy("model_group").agg(F.floor(F.avg("total")).alias("A"))
    return totals, avg


def idf(counts: DataFrame) -> DataFrame:
    """``(model_group, term, idf)``: ln(1 + A / f_t), A = int(mean tokens per topic)."""
    c = _with_f(counts)
    _, avg = _class_constants(c)
    return (c.select("model_group", "term", "f").dropDuplicates(["term", "model_group"])
             .join(F.broadcast(avg), "model_group")
             .select("model_group", "term", F.log(F.col("A") / F.col("f") + 1).alias("idf")))


def ctfidf(counts: DataFrame, with_idf: bool = False, of: DataFrame | None = None) -> DataFrame:
    """``(model_group, topic, term, n, weight)``; weight = n / topic total * idf. With ``with_idf``, also ``idf``
    and any further columns. Totals are those of ``of``, by default of ``counts``.

    Only the per-topic totals and the per-group constant are joined (small
    tables, copied to the vocabulary's tasks: a shuffle by topic or group would
    leave it to as many tasks as there are topics or groups, often one); the
    term frequency ``f`` rides along from the min_df window.
    """
    c = _with_f(counts)
    totals, avg = _class_constants(c if of is None else of)
    value = F.log(F.col("A") / F.col("f") + 1)
    more = [x for x in c.columns if x not in ("model_group", "topic", "term", "n", "f")]
    return (c.join(F.broadcast(totals), ["model_group", "topic"]).join(F.broadcast(avg), "model_group")
             .select("model_group", "topic", "term", "n", (F.col("n") / F.col("total") * value).alias("weight"),
                     *([value.alias("idf"), *more] if with_idf else [])))


def _with_idf(weights: DataFrame, counts: DataFrame) -> DataFrame:
    return weights if "idf" in weights.columns else weights.join(idf(counts), ["term", "model_group"])


def topic_keywords(weights: DataFrame, k: int = 10, params: Params = DEFAULT) -> DataFrame:
    """Best ``k`` terms per topic by weight (ties by term)."""
    return top_k_per_group(top_k_candidates(weights, ["model_group", "topic"], "weight", k), ["model_group", "topic"],
                           [F.col("weight").desc(), F.col("term")], k, unique="term",
                           salt_buckets=params.hot_key_salt)


def topic_summary(docs: DataFrame, weights: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Topic id, size, automatic name ``id_w1_w2_w3_w4``, top keywords (empty for -1)."""
    kw = topic_keywords(weights, params.keywords_per_topic, params)
    lists = (kw.groupBy("model_group", "topic")
               .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_kw"))
               .select("model_group", "topic",
                       F.transform("_kw", lambda x: x["term"]).alias("_terms")))
    sizes = with_model_group(docs, params).groupBy("model_group", "topic").agg(
        F.count(F.lit(1)).alias("count"))
    terms = F.coalesce(F.col("_terms"), F.array().cast("array<string>"))
    return (sizes.join(lists, ["model_group", "topic"], "left")
                 .select("model_group", F.col("topic").alias("topic_id"), "count",
                         F.concat(F.col("topic").cast("string"), F.lit("_"),
                                  F.array_join(F.slice(terms, 1, params.name_words), "_"))
                          .alias("name"),
                         F.when(F.col("topic") == -1, F.lit(""))
                          .otherwise(F.array_join(terms, ", ")).alias("keywords")))


def topic_names(summary: DataFrame) -> DataFrame:
    """``(model_group, topic, name)`` for the frame fallback."""
    return summary.select("model_group", F.col("topic_id").alias("topic"), "name")


def _packed_products(docs: DataFrame, w: DataFrame, params: Params, key: str) -> DataFrame:
    """``(model_group, topic, key, dot, square)``: sums over a document's terms in a bucket of terms, added up by the caller.

    Terms of documents and weights meet in buckets, both packed: no row per
    document and term is shuffled. There are as many buckets as keep a
    bucket's weights within ``BUCKET_ROWS``, since a document has a part in each.
    """
    listed = _listed(docs, ["model_group", "topic", key])
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-w.count() // BUCKET_ROWS))
    stop = topic_stopwords(tuple(params.protected_terms))
    known = packed_rows(w.select(bucket_of(F.col("term"), buckets).alias("bucket"), "model_group", "topic", "term", "weight", "idf"))
    terms = packed_terms(listed, stop, params.ngram_max >= 2, buckets)
    both = (known.select("bucket", F.lit(0).alias("kind"), "payload")
            .unionByName(terms.select("bucket", F.lit(1).alias("kind"), "payload")))
    return weighted_products(both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind"),
                             listed.schema.fields[:-1])


def representative_docs(docs: DataFrame, counts: DataFrame, weights: DataFrame,
                        params: Params = DEFAULT, key: str = "doc_id",
                        dterms: DataFrame | None = None) -> DataFrame:
    """Top ``n`` documents per topic by cosine of their c-TF-IDF to the topic's.

    Every document of a topic is ranked (not a sample of it); the document's
    vector is its term counts over the vocabulary times the idf.
    """
    # Every vocabulary term of a document of topic T has a weight in T, so one
    # join on (model_group, topic, term) brings both idf and topic weight, and
    # one aggregation per document gives the cosine (the document's term
    # total cancels out of it).
    w = _with_idf(weights, counts).select("model_group", "topic", "term", "weight", "idf")
    tnorm = w.groupBy("model_group", "topic").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("tnorm"))
    x = F.col("n") * F.col("idf")

    def joined(terms: DataFrame) -> DataFrame:
        return (terms.join(w, ["term", "topic", "model_group"])
                .select("model_group", "topic", key, (x * F.col("weight")).alias("dot"), (x * x).alias("square")))

    if dterms is None:
        d = with_model_group(docs, params)
        # counts of documents that share a key are added up before they are squared
        own = ["model_group", "topic", key]
        shared = d.groupBy(*own).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*[F.col(c).alias(f"_{c}") for c in own])
        if shared.isEmpty():
            per_doc = _packed_products(d, w, params, key)
        else:
            same = reduce(and_, [d[c].eqNullSafe(F.col(f"_{c}")) for c in own])
            per_doc = _packed_products(d.join(shared, same, "left_anti"), w, params, key).unionByName(
                joined(doc_terms(d.join(shared, same, "left_semi"), params, key)))
    else:
        per_doc = joined(dterms)
    per_doc = per_doc.groupBy("model_group", "topic", key).agg(
        F.sum("dot").alias("dot"), F.sqrt(F.sum("square")).alias("dnorm"))
    scored = (per_doc.join(F.broadcast(tnorm), ["model_group", "topic"])
                     .select("model_group", "topic", key,
                             F.round(F.col("dot") / (F.col("dnorm") * F.col("tnorm")), 9).alias("score")))
    top = top_k_per_group(scored, ["model_group", "topic"], [F.col("score").desc(), F.col(key)],
                          params.representative_docs, unique=key, salt_buckets=params.hot_key_salt)
    meta = with_model_group(docs, params).select("model_group", key, "source", "date", "title", "url")
    return top.join(meta, ["model_group", key])


def _bin_partials(docs: DataFrame, binned: DataFrame, params: Params, key: str) -> DataFrame:
    """``partial_terms`` per group, topic and time bin."""
    texts = docs.select("model_group", "topic", key, "text").join(
        binned.select(key, "bin", "model_group"), [key, "model_group"])
    return partial_terms(texts, ["model_group", "topic", "bin"], params)


def bin_terms(docs: DataFrame, binned: DataFrame, params: Params = DEFAULT, key: str = "doc_id") -> DataFrame:
    """``(term, bin, topic, model_group, n)``: term counts of the documents in each time bin.

    The whole texts meet their document's bin before they are tokenised: a row
    per document is shuffled, not one per document and term.
    """
    return (_bin_partials(docs, binned, params, key)
            .groupBy("term", "bin", "topic", "model_group").agg(F.sum("n").alias("n")))


def _in_bins(d: DataFrame, params: Params, how: str = "inner") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with ``bin`` and ``bin_start``, those of the reported topics, the reported topics)."""
    rng = d.groupBy("model_group").agg(
        F.min("_day").alias("_lo"), F.max("_day").alias("_hi"),
        F.least(F.lit(params.max_time_bins),
                F.greatest(F.countDistinct("year"), F.lit(1))).alias("_nb"))
    span = F.col("_hi") - F.col("_lo")
    binned = d.join(F.broadcast(rng), "model_group", how).withColumn(
        "bin", F.when(span == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col("_day") - F.col("_lo")) * F.col("_nb") / span),
                    F.col("_nb") - 1)).cast("int")
    ).withColumn("bin_start", F.date_from_unix_date(
        (F.col("_lo") + F.floor(F.col("bin") * span / F.col("_nb"))).cast("int")))
    sizes = d.filter(F.col("topic") != -1).groupBy("model_group", "topic").agg(
        F.count(F.lit(1)).alias("size"))
    top_topics = top_k_per_group(sizes, ["model_group"], [F.col("size").desc(), F.col("topic")],
                                 params.top_topics_over_time, unique="topic",
                                 salt_buckets=params.hot_key_salt).select("model_group", "topic")
    return binned, binned.join(F.broadcast(top_topics), ["model_group", "topic"], "left_semi"), top_topics


def term_counts_in_bins(docs: DataFrame, params: Params = DEFAULT, key: str = "doc_id") -> DataFrame | None:
    """``term_counts`` with the time bin as a further key, null outside the reported topics: one pass for both.

    ``n`` counts in the bin, ``f`` over all topics. A document meets its bin in its
    own row; where documents share a key, every text meets every bin of the key,
    which needs the join of ``bin_terms``: None.
    """
    d = with_model_group(docs, params).withColumn("_day", F.unix_date("date"))
    keyed = d.filter(F.col(key).isNotNull() & F.col("model_group").isNotNull())
    if not keyed.groupBy(key, "model_group").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").isEmpty():
        return None
    binned, _, top_topics = _in_bins(d, params, "left")
    reported = F.broadcast(top_topics.withColumn("_top", F.lit(True)))
    rows = binned.join(reported, ["model_group", "topic"], "left").withColumn(
        "bin", F.when(F.col("_top") & F.col(key).isNotNull(), F.col("bin")))
    return _vocabulary(rows, ["model_group", "topic", "bin"], params).select(
        "model_group", "topic", "term", "bin", "n", "f")


def topics_over_time(docs: DataFrame, counts: DataFrame, params: Params = DEFAULT,
                     dterms: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Per topic x equal-width time bin: frequency and top words.

    bins = min(max_time_bins, distinct years, >= 1) over the date range; words
    rank by the bin's term share times the global idf. Only the
    ``top_topics_over_time`` largest non-outlier topics are reported. ``counts``
    may be those of ``term_counts_in_bins``: nothing is tokenised or joined then.
    """
    d = with_model_group(docs, params).withColumn("_day", F.unix_date("date"))
    _, binned, top_topics = _in_bins(d, params)
    freq = binned.groupBy("model_group", "topic", "bin", "bin_start").agg(
        F.count(F.lit(1)).alias("frequency"))
    if "bin" in counts.columns:
        _, avg = _class_constants(counts)
        bt = (counts.filter(F.col("bin").isNotNull()).join(F.broadcast(avg), "model_group")
                    .withColumn("idf", F.log(F.col("A") / F.col("f") + 1)))
    else:
        if dterms is None:
            per_bin = bin_terms(d, binned, params, key)
        else:
            per_bin = (dterms.join(binned.select("model_group", key, "bin"), ["model_group", key])
                             .groupBy("term", "bin", "topic", "model_group").agg(F.sum("n").alias("n")))
        bt = per_bin.join(idf(counts), ["term", "model_group"]).persist()   # read for the totals and for the weights
    btot = bt.groupBy("model_group", "topic", "bin").agg(F.sum("n").alias("total"))
    bw = (bt.join(F.broadcast(btot), ["model_group", "topic", "bin"])
            .withColumn("weight", F.round(F.col("n") / F.col("total") * F.col("idf"), 9)))
    bw = top_k_candidates(bw, ["model_group", "topic", "bin"], "weight", params.words_over_time)
    words = top_k_per_group(bw, ["model_group", "topic", "bin"],
                            [F.col("weight").desc(), F.col("term")], params.words_over_time,
                            unique="term", salt_buckets=params.hot_key_salt)
    wl = (words.groupBy("model_group", "topic", "bin")
               .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_w"))
               .select("model_group", "topic", "bin",
                       F.array_join(F.transform("_w", lambda x: x["term"]), ", ").alias("words")))
    return freq.join(wl, ["model_group", "topic", "bin"], "left").withColumn(
        "words", F.coalesce(F.col("words"), F.lit("")))


def reduce_topics(docs: DataFrame, counts: DataFrame, nr_topics: int | None = None,
                  params: Params = DEFAULT) -> DataFrame:
    """``(model_group, topic, new_topic)`` after merging down to ``nr_topics``
    (default: the parameter; without either nothing merges).

    Repeatedly, in every model group with too many topics, the two most
    similar topics (cosine of their c-TF-IDF vectors; ties by ids) merge, the
    smaller into the larger; then topics are renumbered 0.. by size. The
    loop runs on the small topic tables; one row per group is read back per
    round. A term's row holds at most one entry per topic, and the products of
    its entries are added up per pair of topics before any shuffle.
    """
    from ..session import cut_lineage

    d = with_model_group(docs, params)
    mapping = d.select("model_group", "topic").distinct().withColumn("new_topic", F.col("topic"))
    mapping = cut_lineage(mapping)
    doc_sizes = cut_lineage(d.groupBy("model_group", "topic").agg(F.count(F.lit(1)).alias("size")))
    # written once, one row per term: a round reads it and shuffles nothing wider than the pairs of topics
    counts = counts.select("model_group", "topic", "term", "n").join(
        mapping.select("model_group", "topic"), ["model_group", "topic"], "left_semi")
    terms = cut_lineage(counts.groupBy("model_group", "term").agg(
        F.collect_list(F.struct("topic", "n")).alias("_t"), F.sum("n").alias("f")))
    totals = cut_lineage(terms.select("model_group", F.explode("_t").alias("t")).groupBy("model_group", "t.topic")
                         .agg(F.sum("t.n").alias("total")))
    nr_topics = nr_topics or params.nr_topics
    while nr_topics:
        sizes = (doc_sizes.join(mapping, ["model_group", "topic"])
                          .groupBy("model_group", "new_topic").agg(F.sum("size").alias("size")))
        groups = (sizes.filter(F.col("new_topic") != -1).groupBy("model_group")
                       .agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > nr_topics))
        if groups.isEmpty():
            break
        # cosines of merged topics follow from products summed over pairs of unmerged ones; the
        # topics' totals cancel out of them
        merged = totals.join(mapping, ["model_group", "topic"]).groupBy("model_group", "new_topic").agg(
            F.sum("total").alias("total"))
        avg = (merged.groupBy("model_group").agg(F.floor(F.avg("total")).alias("A"))
               .join(groups.select("model_group"), "model_group"))                      # one row per group
        real = (terms.join(F.broadcast(avg), "model_group")
                .select("model_group", F.pow(F.log(F.col("A") / F.col("f") + 1), 2).alias("s"),
                        F.filter("_t", lambda t: t["topic"] != -1).alias("_t")))
        a, b = F.col("a"), F.col("b")
        cells = cut_lineage(
            real.select("model_group", "s", "_t", F.explode("_t").alias("a"))
            .select("model_group", "s", "a", F.explode(F.filter(
                "_t", lambda t: t["topic"] >= F.col("a")["topic"])).alias("b"))
            .groupBy("model_group", a["topic"].alias("ta"), b["topic"].alias("tb"))
            .agg(F.sum(F.col("s") * a["n"] * b["n"]).alias("v")))
        to = mapping.select("model_group", "topic", "new_topic")
        moved = (cells.join(to.toDF("model_group", "ta", "na"), ["model_group", "ta"])
                 .join(to.toDF("model_group", "tb", "nb"), ["model_group", "tb"])
                 .groupBy("model_group", F.least("na", "nb").alias("t1"), F.greatest("na", "nb").alias("t2"))
                 .agg(F.sum(F.when((F.col("na") == F.col("nb")) & (F.col("ta") != F.col("tb")), 2 * F.col("v"))
                            .otherwise(F.col("v"))).alias("dot")))
        dots = moved.filter("t1 < t2")
        norms = moved.filter("t1 = t2").select("model_group", F.col("t1").alias("topic"), F.sqrt("dot").alias("nrm"))
        n1 = norms.select("model_group", F.col("topic").alias("t1"), F.col("nrm").alias("n1"))
        n2 = norms.select("model_group", F.col("topic").alias("t2"), F.col("nrm").alias("n2"))
        sims = (dots.join(n1, ["model_group", "t1"]).join(n2, ["model_group", "t2"])
                    .select("model_group", "t1", "t2",
                            F.round(F.col("dot") / (F.col("n1") * F.col("n2")), 12).alias("sim")))
        best = sims.groupBy("model_group").agg(
            F.max_by(F.struct("t1", "t2"), F.struct("sim", -F.col("t1"), -F.col("t2"))).alias("p"))
        s1 = sizes.select("model_group", F.col("new_topic").alias("t1"), F.col("size").alias("s1"))
        s2 = sizes.select("model_group", F.col("new_topic").alias("t2"), F.col("size").alias("s2"))
        moves = cut_lineage(best.select("model_group", "p.t1", "p.t2").join(s1, ["model_group", "t1"])
                     .join(s2, ["model_group", "t2"])
                     .select("model_group",
                             F.when(F.col("s1") < F.col("s2"), F.col("t1")).otherwise(F.col("t2"))
                             .alias("from_t"),
                             F.when(F.col("s1") < F.col("s2"), F.col("t2")).otherwise(F.col("t1"))
                             .alias("to_t")))
        if moves.isEmpty():   # no two topics share a term: nothing left to merge
            break
        mapping = cut_lineage(
            mapping.join(moves, (mapping.model_group == moves.model_group)
                         & (mapping.new_topic == moves.from_t), "left")
                   .select(mapping.model_group, "topic",
                           F.coalesce("to_t", "new_topic").alias("new_topic")))
    sizes = (doc_sizes.join(mapping, ["model_group", "topic"])
                      .groupBy("model_group", "new_topic").agg(F.sum("size").alias("size")))
    order = Window.partitionBy("model_group").orderBy(F.col("size").desc(), F.col("new_topic"))
    renum = (sizes.filter(F.col("new_topic") != -1)
                  .withColumn("final", (F.row_number().over(order) - 1).cast("int")))
    return (mapping.join(renum.select("model_group", "new_topic", "final"),
                         ["model_group", "new_topic"], "left")
                   .select("model_group", "topic",
                           F.coalesce("final", F.lit(-1)).alias("new_topic")))


def topic_word_weights(summary: DataFrame, weights: DataFrame, top_n_topics: int = 8,
                       params: Params = DEFAULT) -> DataFrame:
    """Word -> weight of the keywords of the ``top_n_topics`` largest
    non-outlier topics (the table behind the word clouds)."""
    big = top_k_per_group(summary.filter(F.col("topic_id") != -1), ["model_group"],
                          [F.col("count").desc(), F.col("topic_id")], top_n_topics,
                          unique="topic_id", salt_buckets=params.hot_key_salt, rank_col="topic_rank")
    kw = topic_keywords(weights, params.keywords_per_topic, params)
    return kw.join(big.select("model_group", F.col("topic_id").alias("topic"), "topic_rank"),
                   ["model_group", "topic"])


def topics_over_time_tuned(docs: DataFrame, counts: DataFrame, weights: DataFrame | None = None,
                           params: Params = DEFAULT, dterms: DataFrame | None = None,
                           key: str = "doc_id") -> DataFrame:
    """Topics over time with the library's default smoothing.

    Per (topic, time bin) the bin's c-TF-IDF row (global idf) is L1-normalised;
    if the topic also occurs in the previous non-empty bin, the row is averaged
    with the topic's tuned row of that bin (evolution); the result is averaged
    with the topic's L1-normalised global row (global tuning). The top
    ``words_over_time`` terms of the tuned row are reported.

    Each (topic, term) carries one array over the time bins (``max_time_bins``
    entries), folded from bin to bin over many terms at once; nothing grows
    with the number of documents. ``counts`` may be those of
    ``term_counts_in_bins``, which the weights follow from.
    """
    d = with_model_group(docs, params).withColumn("_day", F.unix_date("date"))
    everywhere, binned, top_topics = _in_bins(d, params)
    bins, topic = range(params.max_time_bins), ["model_group", "topic"]
    # position of each non-empty bin among all non-empty bins (any topic)
    tpos = (everywhere.select("model_group", "bin").distinct()
                      .withColumn("t", F.dense_rank().over(Window.partitionBy("model_group").orderBy("bin"))))
    freq = binned.groupBy("model_group", "topic", "bin", "bin_start").agg(
        F.count(F.lit(1)).alias("frequency"))
    per_term = [F.sum(F.when(F.col("bin") == b, F.col("n"))).alias(f"_n{b}") for b in bins]
    if "bin" in counts.columns:
        # dealt out before the sums: a row per bin is narrower than the sums of all bins
        own = (counts.join(F.broadcast(top_topics), topic, "left_semi").repartition("term").groupBy("term", "topic", "model_group")
                     .agg(F.sum("n").alias("n"), F.max("f").alias("f"), *per_term))
        series = ctfidf(own, with_idf=True, of=counts).persist()        # read for the sums and for the fold
    else:
        if dterms is None:
            per_bin = _bin_partials(d, binned, params, key)
        else:
            per_bin = dterms.join(binned.select("model_group", key, "bin"), ["model_group", key])
        wide = per_bin.groupBy("term", "topic", "model_group").agg(*per_term)
        # every term of a topic's bin that is in the vocabulary has a weight in the topic
        known = ctfidf(counts, with_idf=True) if weights is None else _with_idf(weights, counts)
        series = (known.join(F.broadcast(top_topics), topic, "left_semi")
                  .join(wide, ["term", "topic", "model_group"], "left").persist())
    # the bin total cancels in the L1 normalisation of n / total * idf
    # totals by partial sums and a join on few rows: a window would bring a topic's whole vocabulary to one task
    sums = series.groupBy(*topic).agg(
        F.sum("weight").alias("_weights"), *[F.sum(F.col(f"_n{b}") * F.col("idf")).alias(f"_raws{b}") for b in bins])
    # per topic and bin: 0 absent, 1 present, 2 present as is the non-empty bin before
    pair = F.struct(F.col("bin"), F.when(F.lag("t").over(Window.partitionBy(*topic).orderBy("t")) == F.col("t") - 1, 2)
                    .otherwise(1).alias("link"))
    present = (binned.select(*topic, "bin").distinct().join(F.broadcast(tpos), ["model_group", "bin"])
               .select(*topic, pair.alias("_l"))
               .groupBy(*topic).agg(F.map_from_entries(F.collect_list("_l")).alias("_l"))
               .select(*topic, F.array(*[F.coalesce(F.try_element_at("_l", F.lit(b)), F.lit(0)) for b in bins])
                       .alias("link")))
    small = sums.join(present, topic)
    rows = series.join(F.broadcast(small), topic).select(
        *topic, "term", (F.col("weight") / F.col("_weights")).alias("g"),
        F.array(*[F.coalesce(F.col(f"_n{b}") * F.col("idf") / F.col(f"_raws{b}"), F.lit(0.0)) for b in bins]).alias("w"),
        "link")
    # the margin is wider than what rounding moves
    tuned = (folded_best(rows, topic, params.words_over_time, margin=1e-11)
             .withColumn("y", F.round("y", 12)).filter(F.col("y") > 0))
    words = top_k_per_group(tuned, ["model_group", "topic", "bin"],
                            [F.col("y").desc(), F.col("term")], params.words_over_time,
                            unique="term", salt_buckets=params.hot_key_salt)
    wl = (words.groupBy("model_group", "topic", "bin")
               .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_w"))
               .select("model_group", "topic", "bin",
                       F.array_join(F.transform("_w", lambda x: x["term"]), ", ").alias("words")))
    return freq.join(wl, ["model_group", "topic", "bin"], "left").withColumn(
        "words", F.coalesce(F.col("words"), F.lit("")))
