"""Registered queries ``opN_<name>``: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, forest, langid, lexical, licenses, minhash, packing, secrets, substrings, toxicity, trie
from . import urls, warc
from .common import table


def op1_decontaminate(spark, d):
    """Words of each document inside an occurrence of a benchmark window."""
    judged = decontam.judge(table(spark, d, "documents").select("doc_id", "text"),
                            table(spark, d, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("found.hits", F.lit(0).cast("bigint"), lambda acc, h: acc + h["n"])
    return judged.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def op2_licenses(spark, d):
    """License of every document, laid out as files: source/lang/group/name; each group's first is LICENSE."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
                       F.concat(F.lit("group"), F.floor(F.col("doc_id") / 1000).cast("string")),
                       F.floor(F.col("doc_id") / 100).cast("string"), name)
    files = docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
    return licenses.licenses(files).select(
        "doc_id", "path", "own_license", "own_score", "license", "origin", "from_dir")


def op3_urls(spark, d):
    """Verdict on every page's url."""
    pages = table(spark, d, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op4_secrets(spark, d):
    """Secret spans of every document, through an empty ledger."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found, _ = secrets.scan(docs)
    shown = F.transform("secrets", lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"]))
    base = F.filter("secrets", lambda s: s["ord"] < len(secrets.BASE))
    rules = F.transform("secrets", lambda s: s["rule"])
    counts = [F.size(F.filter(rules, lambda x: x == F.lit(name))).cast("bigint").alias(f"n_{name}")  # noqa: B023
              for name in (r.name for r in secrets.BASE)]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ","),
               256).alias("base_sha256"),
        F.array_join(shown, ",").alias("spans"))


def op5_packing(spark, d):
    """Packed 2048-token sequences of all documents."""
    return packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"))


def op6_warc(spark, d):
    """Records of all pages, read back from the archives written."""
    manifest = warc.write_archives(table(spark, d, "pages").select("page_id", "url", "html"))
    return warc.read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_langid(spark, d):
    """Language of every document, learned from the rows outside the held-out fold."""
    docs = table(spark, d, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_embeddings(spark, d):
    """Links and component of every embedding."""
    found = forest.near_duplicates(table(spark, d, "embeddings").select("vec_id", "embedding", "label"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_minhash(spark, d):
    """Near-duplicate class of every document."""
    found = minhash.classes(table(spark, d, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op10_toxicity(spark, d):
    """Toxicity score of every document, learned from labelled rows outside the held-out fold."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_trie(spark, d):
    """Nodes of the prefix trie of all conversations, each rebuilt with its group's opening."""
    turns = trie.share_openings(trie.sequences(table(spark, d, "conversations")))
    return trie.prefix_trie(turns).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_lexical(spark, d):
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, d, "documents").select("doc_id", "text"),
                          table(spark, d, "benchmark").select("item_id", "text"))


def op13_substrings(spark, d):
    """Bytes of each document covered by a 100-byte string that starts earlier."""
    cut = substrings.deduplicate(table(spark, d, "documents").select("doc_id", "text"), bytes_too=False)
    return cut.select("doc_id", "deduped.n_bytes", "deduped.n_removed",
                      F.size("deduped.spans").cast("bigint").alias("n_spans"), "deduped.kept_sha256")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licenses": op2_licenses,
    "op3_urls": op3_urls,
    "op4_secrets": op4_secrets,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_langid": op7_langid,
    "op8_embeddings": op8_embeddings,
    "op9_minhash": op9_minhash,
    "op10_toxicity": op10_toxicity,
    "op11_trie": op11_trie,
    "op12_lexical": op12_lexical,
    "op13_substrings": op13_substrings,
}
