"""Operator 12: ranked lexical search by presence masks.

Items are the queries, documents the collection. A shard of documents becomes
postings of the items' terms. For one item, the terms' bitmaps give every
document a mask of the matched terms; documents of equal mask form a group,
whose best possible score is the sum of its terms' highest impacts in the
shard. Distinct masks are evaluated by descending maximum until the next one
is below the tenth score found so far: no document left out can enter.

Two passes over the whole texts: the first counts documents, terms and document
frequencies, the second ranks. Texts are never shuffled; a task returns at most
ten documents per item. Items are dealt to blocks of bounded size, written by a
Spark job, and only one block at a time is sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.topk import top_k_per_group
from .common import pieces, span_hashes, text_buffer, word_spans
from .scratch import Scratch

TOP = 10
LENGTH_SHARE = 75  # of 100: how far a document's length counts
SATURATION = 1_000_000_000
BLOCK_TERMS = 1 << 20
SHARD_BYTES = 1 << 23
WAVE = 256


@dataclass
class Queries:
    """A block of items: sorted vocabulary, and per item its terms (places in the vocabulary) and repeats."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term, repeats)``: hashed terms of each item; equal rows count once, texts of one id are one item."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            starts, ends, bounds = word_spans(raw, offsets)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(span_hashes(raw, starts, ends).view(np.int64))],
                names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    cut_terms = items.select("item_id", "text").distinct().mapInArrow(cut, f"item_id {kind}, term bigint")
    return cut_terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def read_block(terms: DataFrame, block: int) -> Queries:
    """The items of one block, of bounded size, on the driver."""
    t = (terms.filter(F.col("block") == block).select("item_id", "term", "repeats")
         .orderBy("item_id", "term").toArrow().combine_chunks())
    hashes, repeats = t.column("term").to_numpy().view(np.uint64), t.column("repeats").to_numpy()
    vocabulary = np.unique(hashes)
    ids = t.column("item_id").to_pylist()
    first = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
    return Queries([ids[i] for i in first[:-1]], vocabulary,
                   [np.searchsorted(vocabulary, hashes[i:j]) for i, j in zip(first, first[1:])],
                   [repeats[i:j] for i, j in zip(first, first[1:])])


class Shard:
    """Postings of the vocabulary in some documents: per term its documents and how often each holds it."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray):
        starts, ends, bounds = word_spans(raw, offsets)
        self.lengths = np.diff(bounds)
        hashes = span_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[at] == hashes)
        row = np.searchsorted(bounds, known, side="right") - 1
        rows = len(self.lengths)
        pair, self.tf = np.unique(at[known] * rows + row, return_counts=True)
        self.doc = pair % max(rows, 1)
        self.term_start = np.searchsorted(pair, np.arange(len(vocabulary) + 1) * rows)


def statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the document frequency of each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            for a, b in pieces(offsets, SHARD_BYTES):
                shard = Shard(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], vocabulary)
                df += np.diff(shard.term_start)
                n += int((shard.lengths > 0).sum())
                total += int(shard.lengths.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])),
                                          pa.array(np.append(df[seen], [n, total]))], names=["term", "n"])

    counts = (docs.select("text").mapInArrow(count, "term bigint, n bigint")
              .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    found = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist()))
    df = np.array([found.get(i, 0) for i in range(len(queries.vocabulary))], np.int64)
    shared.destroy()
    return found.get(-1, 0), found.get(-2, 0), df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def impacts(shard: Shard, documents: int, total: int) -> np.ndarray:
    """Per posting: 10**9 tf div (1000 tf + 8 m), m by the document's length."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * shard.lengths * documents) // max(total, 1)
    return (SATURATION * shard.tf) // (1000 * shard.tf + 8 * m[shard.doc])


def group_masks(postings: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks of matched terms (rows of booleans, one column a term), and each document's mask number."""
    number, masks = np.zeros(rows, np.int64), np.zeros((1, 0), bool)
    for low in range(0, len(postings), 63):  # one machine word of the mask at a time
        part = postings[low:low + 63]
        word = np.zeros(rows, np.int64)
        for bit, found in enumerate(part):
            word[found] |= np.int64(1 << bit)
        words, place = np.unique(word, return_inverse=True)
        pair, number = np.unique(number * len(words) + place, return_inverse=True)
        bits = (words[pair % len(words), None] >> np.arange(len(part))) & 1
        masks = np.concatenate([masks[pair // len(words)], bits.astype(bool)], axis=1)
    return masks, number


def rank_shard(shard: Shard, impact: np.ndarray, worth: np.ndarray, terms: np.ndarray,
               best: tuple[np.ndarray, np.ndarray], doc_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of ``best`` (scores, ids) and the shard, for one item; ties go to the smaller id."""
    spans = [slice(shard.term_start[t], shard.term_start[t + 1]) for t in terms]
    held = [i for i, s in enumerate(spans) if s.stop > s.start and worth[i] > 0]
    if not held:
        return best
    spans, worth = [spans[i] for i in held], worth[held]
    highest = worth * np.array([impact[s].max() for s in spans])
    if len(best[0]) == k and highest.sum() < best[0][-1]:
        return best
    postings = [shard.doc[s] for s in spans]
    masks, number = group_masks(postings, len(shard.lengths))
    bound = masks @ highest
    order = np.argsort(-bound[number], kind="stable")
    limit = bound[number[order]]
    at = 0
    while at < len(order) and limit[at] > 0 and (len(best[0]) < k or limit[at] >= best[0][-1]):
        end = int(np.searchsorted(-limit, -limit[min(at + WAVE, len(order)) - 1], side="right"))  # whole masks
        wave = np.sort(order[at:end])
        score = np.zeros(len(wave), np.int64)
        for i, (s, found) in enumerate(zip(spans, postings)):
            mine = np.flatnonzero(masks[number[wave], i])
            score[mine] += worth[i] * impact[s][np.searchsorted(found, wave[mine])]
        above = score > 0
        score, ids = np.append(best[0], score[above]), np.append(best[1], doc_ids[wave[above]])
        top = np.lexsort((ids, -score))[:k]
        best = score[top], ids[top]
        at = end
    return best


def rank_block(docs: DataFrame, queries: Queries, kind, k: int) -> DataFrame:
    documents, total, df = statistics(docs, queries)
    shared = docs.sparkSession.sparkContext.broadcast(queries)
    weight = weights(documents, df)
    missing = np.iinfo(np.int64).max  # a null doc_id, last among equal scores
    item_type = to_arrow_type(kind)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        worth = [weight[t] * r for t, r in zip(queries.terms, queries.repeats)]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)
        for batch in batches:
            ids = batch.column(0).fill_null(missing).to_numpy()
            raw, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets, SHARD_BYTES):
                shard = Shard(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], queries.vocabulary)
                impact = impacts(shard, documents, total)
                for i, terms in enumerate(queries.terms):
                    best[i] = rank_shard(shard, impact, worth[i], terms, best[i], ids[a:b], k)
        item = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        if len(item):
            doc = np.concatenate([d for _, d in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array([queries.ids[i] for i in item], type=item_type),
                 pa.array(doc, mask=doc == missing), pa.array(np.concatenate([s for s, _ in best]))],
                names=["item_id", "doc_id", "score"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
            .mapInArrow(rank, f"item_id {kind.simpleString()}, doc_id bigint, score bigint"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item, scores above 0 only.

    Reads columns doc_id, text of ``docs`` and item_id, text of ``items``;
    other columns, clashing names included, are not looked at. Null, empty and
    wordless texts hold no term. Repeated rows of ``docs`` are ranked one by
    one; equal scores go to the smaller doc_id, a null doc_id last. Rows of one
    item_id (null is an id) are one item; equal rows of it count once. An empty
    table on either side gives an empty result. A text is processed as a whole,
    in a shard of its own where it is long. Terms are known by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    kind = items.schema["item_id"].dataType
    terms = scratch.keep("terms", item_terms(items))
    blocks = -(-terms.count() // block_terms)
    parts = docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, doc_id bigint, score bigint")
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))))
    for block in range(blocks):
        queries = read_block(terms, block)
        if queries.ids:
            found = rank_block(docs, queries, kind, k)
            parts = parts.unionByName(found if blocks == 1 else scratch.keep(f"block-{block}", found))
    ranked = top_k_per_group(parts, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "doc_id")
    scratch.drop("terms")
    return ranked.select("item_id", "rank", "doc_id", "score")
