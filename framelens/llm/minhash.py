"""Operator 9: near duplicates by improved consistent weighted sampling.

A document is its set of five-word shingles, weighted by TF-IDF. Document
frequencies are counted on hashed features (as ``HashingTF`` with ``IDF``
does): the table has a fixed size, and what it can tell apart is a share of the
corpus, alike at every size. They count each group of near copies once, so that
a large group does not make its own shingles common: in a bucket of plain
MinHash bands, texts whose sketches agree with the bucket's smallest id count as
its copies. That estimate serves the counts only. Improved consistent weighted
sampling draws ``BANDS x ROWS`` samples per document; two documents agree in a
sample with the probability of their weighted Jaccard similarity. Samples are
banded, and every candidate is verified by the weighted Jaccard similarity of
the two whole texts.

Work grows with candidates, not with the square of a group:

1. texts with the same words are one class, known by its smallest doc_id;
2. in each bucket every class is verified against the bucket's smallest id, so
   a group of near copies costs one comparison per member;
3. connected classes are contracted; in buckets with classes still apart, the
   members outside the centre's component are compared with all others, in
   blocks of bounded size whose intersections are matrix products. A block
   returns links to roots, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import mix, pieces, shingles, text_buffer, words
from .components import components
from .scratch import Scratch

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
FEATURE_BITS = 18
TABLE = 1 << 14
CHUNK = 1 << 11
BLOCK = 256
SLICE = 4096
ALIKE = 0.7  # share of equal sketch entries from which a text counts as a copy in document frequencies


def _documents(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text in turn; memory stays within pieces of the batch."""
    raw, offsets = text_buffer(texts)
    for a, b in pieces(offsets, 1 << 20):
        hashes, bounds = words(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        for i, j in zip(bounds[:-1], bounds[1:]):
            yield hashes[i:j]


def _content(hashes: np.ndarray) -> str:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def feature(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _counted(docs: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """Documents that hold each hashed shingle feature, and documents with words.

    Columns text, content, share: a row counts ``share`` times, if ``content``
    is null or that of its text.
    """
    def count(batches):
        total, rows = np.zeros(1 << FEATURE_BITS), 0.0
        for batch in batches:
            expected, share = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, hashes in enumerate(_documents(batch.column(0))):
                if len(hashes) and expected[i] in (None, _content(hashes)):
                    total[np.unique(feature(shingles(hashes, size)))] += share[i]
                    rows += share[i]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1).astype(np.int32)),
                                          pa.array(np.append(total[seen], rows))], names=["feature", "n"])

    counts = (docs.select("text", "content", "share").mapInArrow(count, "feature int, n double")
              .groupBy("feature").agg(F.sum("n").alias("n")).toArrow())  # 2**FEATURE_BITS rows at most
    at, n = counts.column("feature").to_numpy(), counts.column("n").to_numpy()
    out = np.zeros(1 << FEATURE_BITS)
    out[at[at >= 0]] = n[at >= 0]
    return out, float(n[at < 0].sum())


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, content, bands, sketch)``: plain MinHash bands and a byte of each sample; null without words."""
    kind = pa.struct([("content", pa.string()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    @F.arrow_udf("struct<content:string,bands:array<bigint>,sketch:binary>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sampler = Sampler()
        for texts in batches:
            rows = []
            for hashes in _documents(texts):
                if not len(hashes):
                    rows.append(None)
                    continue
                drawn = sampler.lowest(shingles(hashes, size))
                rows.append({"content": _content(hashes), "bands": _bands(drawn),
                             "sketch": drawn.astype(np.uint8).tobytes()})
            yield pa.array(rows, type=kind)

    return docs.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*")


@F.arrow_udf(DoubleType())
def agreement(left: pa.Array, right: pa.Array) -> pa.Array:
    """Share of equal entries of two sketches."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1) for x in (left, right))
    return pa.array((a == b).mean(axis=1) if len(a) else np.zeros(0))


def document_frequencies(docs: DataFrame, size: int = SHINGLE, scratch: Scratch | None = None) -> tuple[np.ndarray, int]:
    """Groups that hold each hashed shingle feature in their first text, and groups with words.

    All rows are counted where they lie; then the rows that repeat a text or
    whose sketch agrees with a smaller id of a bucket are taken off again. The
    groups are found on sketches; only texts that are taken off are moved.
    """
    own_scratch = scratch is None
    scratch = scratch or Scratch(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null")
    whole = named.select("text", F.lit(None).cast("string").alias("content"), F.lit(1.0).alias("share"))
    all_rows, n = _counted(whole, size)
    per_id = (sketches(named, size).filter("content is not null").groupBy("content", "doc_id")
              .agg(F.count(F.lit(1)).alias("own"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    heads = scratch.keep("sketch-heads", per_id.groupBy("content").agg(
        F.min(F.struct("doc_id", "own", "bands", "sketch")).alias("h"), F.sum("own").alias("rows"))
        .select("content", F.col("h.doc_id").alias("node"), "h.own", "h.bands", "h.sketch", "rows"))
    buckets = heads.select("node", "content", "sketch", F.posexplode("bands").alias("band", "key"))
    centres = (buckets.groupBy("band", "key").agg(F.min(F.struct("node", "sketch")).alias("c"), F.max("node").alias("last"))
               .filter("c.node < last").select("band", "key", F.col("c.node").alias("centre"), F.col("c.sketch").alias("other")))
    copies = (buckets.join(centres, ["band", "key"]).filter("centre < node")
              .filter(agreement("sketch", "other") >= ALIKE).select("content").distinct().withColumn("copy", F.lit(1)))
    spare = (heads.join(copies, "content", "left")
             .withColumn("spare", F.col("rows") - F.when(F.col("copy") == 1, 0).otherwise(1)).filter("spare > 0")
             .select(F.col("node").alias("doc_id"), "content", (F.col("spare") / F.col("own")).alias("share")))
    off, spared = _counted(named.join(scratch.keep("spare", spare).hint("merge"), "doc_id"), size)
    scratch.drop("sketch-heads", "spare")
    if own_scratch:
        scratch.close()
    return np.rint(all_rows - off).astype(np.int64), round(n - spared)


def inverse_frequencies(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return np.log((1 + documents) / (1 + frequencies)) + 1


def weigh(hashes: np.ndarray, idf: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a document, sorted, and their TF-IDF weights."""
    found, count = np.unique(shingles(hashes, size), return_counts=True)
    return found, count * idf[feature(found)]


def _folded(shingle: np.ndarray) -> np.ndarray:
    return ((shingle >> np.uint64(32)) ^ shingle).astype(np.uint32)


class Sampler:
    """Improved consistent weighted sampling with tabled random variates.

    A shingle's variates (two gamma, one uniform) for sample k come from a
    table entry chosen by the shingle's k-th hash, so equal shingles draw
    alike in every document. A score lies between two bounds that need no
    level; only shingles whose lower bound reaches the least upper bound are
    scored, which leaves the sample as it is.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        draw = np.random.default_rng(seed)
        r, c, beta = draw.gamma(2, 1, TABLE), draw.gamma(2, 1, TABLE), draw.random(TABLE)
        self.inverse, self.beta, self.r = 1 / r, beta, r
        self.rest = np.log(c) + r * beta - r
        self.high, self.low = np.log(c).astype(np.float32), (np.log(c) - r).astype(np.float32)
        self.multiplier = draw.integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def lowest(self, shingle: np.ndarray) -> np.ndarray:
        """One sample per multiplier for shingles of equal weight: the lowest hash."""
        part = _folded(shingle)
        out = np.full(len(self.multiplier), np.iinfo(np.uint32).max)
        for i in range(0, len(part), CHUNK):
            np.minimum(out, (part[i:i + CHUNK] * self.multiplier[:, None]).min(axis=1), out=out)
        return mix(out.astype(np.uint64) + self.multiplier)

    def draw(self, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One sample (hash of shingle and level) per multiplier; equal scores go to the smaller shingle."""
        log_weight = np.log(weight)
        best = np.full(len(self.multiplier), np.inf)
        out = np.zeros(len(self.multiplier), np.uint64)
        for i in range(0, len(shingle), CHUNK):
            part, log = shingle[i:i + CHUNK], log_weight[i:i + CHUNK]
            # index type and take: the same entries as by fancy indexing, which converts the index anew each time
            entry = ((_folded(part) * self.multiplier[:, None]) >> np.uint32(32 - 14)).astype(np.intp)
            single = log.astype(np.float32)
            reach = np.minimum((self.high.take(entry) - single).min(axis=1), best) + 1e-3  # more than single precision loses
            k, at = np.divmod(np.flatnonzero(self.low.take(entry) - single <= reach[:, None]), len(part))
            if not len(k):
                continue
            entry = entry[k, at]
            level = np.floor(log[at] * self.inverse[entry] + self.beta[entry])
            score = self.rest[entry] - self.r[entry] * level
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            value = np.minimum.reduceat(score, first)
            least = np.flatnonzero(score == np.repeat(value, np.diff(np.append(first, len(k)))))
            least = least[np.append(True, k[least][1:] != k[least][:-1])]
            better = score[least] < best[k[least]]
            chosen, sample = least[better], k[least[better]]
            best[sample] = score[chosen]
            out[sample] = mix(part[at[chosen]] + level[chosen].astype(np.int64).astype(np.uint64)
                              * np.uint64(0x9E3779B97F4A7C15))
        return out


def _bands(drawn: np.ndarray) -> np.ndarray:
    key = np.zeros(BANDS, np.uint64)
    for column in drawn.reshape(BANDS, ROWS).T:
        key = mix(key + column)
    return key.view(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, content, bands)``: hash of the words and band keys, null for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf.astype(np.float32))
    kind = pa.struct([("content", pa.string()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<content:string,bands:array<bigint>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sampler, idf = Sampler(), shared.value
        for texts in batches:
            rows = []
            for hashes in _documents(texts):
                if not len(hashes):
                    rows.append(None)
                    continue
                drawn = sampler.draw(*weigh(hashes, idf, size))
                rows.append({"content": _content(hashes), "bands": _bands(drawn)})
            yield pa.array(rows, type=kind)

    return docs.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*")


def similarity(idf_shared, size: int = SHINGLE):
    """Column function (text, text) -> weighted Jaccard similarity of the whole texts."""
    @F.arrow_udf("double")
    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        idf = idf_shared.value
        for left, right in batches:
            # rows come sorted by the left document, so its weights are taken over from row to row
            encoded = left.dictionary_encode()
            each, new, known = _documents(encoded.dictionary), 0, -1
            out = []
            for i, b in zip(encoded.indices.to_pylist(), _documents(right)):
                if i != known:
                    a = next(each) if i == new else next(_documents(encoded.dictionary.slice(i, 1)))
                    new, known = new + (i == new), i
                    sa, wa = weigh(a, idf, size)
                sb, wb = weigh(b, idf, size)
                _, at, bt = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
                both = np.minimum(wa[at], wb[bt]).sum()
                out.append(both / max(wa.sum() + wb.sum() - both, 1e-12))
            yield pa.array(out, pa.float64())

    return compare


def _linked(idf_shared, least: float, size: int):
    """Group function: all pairs of the two chunks of a group; per text its root among those linked.

    A shingle that occurs n times counts as n columns, so the weighted
    intersection of two texts is a product of binary rows. Columns are taken in
    slices, those of one text alone not at all.
    """
    def link(group: pa.Table) -> pa.Table:
        idf = idf_shared.value
        t = group.combine_chunks()
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        row, column, total = [], [], np.zeros(len(node))
        for i, hashes in enumerate(_documents(t.column("text").combine_chunks())):
            found, count = np.unique(shingles(hashes, size), return_counts=True)
            each = np.repeat(found, count)
            copy = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            total[i] = idf[feature(each)].sum()
            row.append(np.full(len(each), i))
            # the copy number goes into the column's hash, the weight stays the shingle's
            column.append(np.stack([mix(each + copy.astype(np.uint64)), each], axis=1))
        row, column = np.concatenate(row), np.concatenate(column)
        _, first, number, times = np.unique(column[:, 0], return_index=True, return_inverse=True, return_counts=True)
        weight = np.sqrt(idf[feature(column[first, 1])])
        shared_column = times > 1
        place = np.cumsum(shared_column) - 1
        keep = shared_column[number]
        row, number = row[keep], number[keep]
        order = np.argsort(place[number], kind="stable")
        row, at, value = row[order], place[number][order], weight[number][order]
        both = np.zeros((len(node), len(node)))
        for low in range(0, int(shared_column.sum()), SLICE):
            i, j = np.searchsorted(at, [low, low + SLICE])
            part = np.zeros((len(node), SLICE))
            part[row[i:j], at[i:j] - low] = value[i:j]
            both += part @ part.T
        same = side[:, None] == side[None, :] if (side > 0).any() and (side == 0).any() else False
        similar = both / np.maximum(total[:, None] + total[None, :] - both, 1e-12)
        linked = (similar >= least) & ~np.logical_and(same, node[:, None] != node[None, :])
        np.fill_diagonal(linked, True)
        root = node.copy()
        while True:  # smallest id reachable inside the group
            step = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
            if (step == root).all():
                break
            root = step
        moved = root != node
        return pa.table({"src": root[moved], "dst": node[moved]})

    return link


def _linked_nodes(scratch: Scratch, named: DataFrame, idf: np.ndarray, size: int, least: float, block: int):
    """``(signed, node_of, label)``: contents of the rows, the node of each content, labels of linked nodes."""
    signed = scratch.keep("signed", signatures(named, idf, size))
    # a class is known by its smallest id and read there; a doc_id with several texts joins their classes
    heads = scratch.keep("heads", signed.filter("content is not null").groupBy("content").agg(
        F.min(F.struct("doc_id", "bands")).alias("h")).select("content", F.col("h.doc_id").alias("node"), "h.bands"))
    buckets = heads.select("node", F.posexplode("bands").alias("band", "key"))
    centres = (buckets.groupBy("band", "key").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
               .filter("centre < last").drop("last"))
    members = scratch.keep("members", buckets.join(centres, ["band", "key"]))
    # tables of ids grow with the corpus: a join with texts is a merge join at every size
    texts = scratch.keep("texts", named.join(
        members.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id"))
    shared = named.sparkSession.sparkContext.broadcast(idf.astype(np.float32))
    compare = similarity(shared, size)

    star = members.filter("node <> centre").select(F.col("centre").alias("src"), F.col("node").alias("dst")).distinct()
    left = texts.select(F.col("doc_id").alias("src"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("right"))
    links = scratch.keep("links", star.hint("merge").join(right, "dst").hint("merge").join(left, "src")
                         .withColumn("s", compare("left", "right")).filter(F.col("s") >= least).select("src", "dst"))
    label = components(scratch, links, "star")

    # buckets with classes still apart: members outside the centre's component against all others
    bucket = ["band", "key"]
    open_ = members.select(*bucket, "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = (open_.groupBy(*bucket).agg(F.min("label").alias("_low"), F.max("label").alias("_high"),
                                        F.min(F.struct("node", "label")).alias("_c"))
             .filter("_low < _high").select(*bucket, F.col("_c.label").alias("_main")))
    rest = scratch.keep("rest", open_.join(apart, bucket).select(
        *bucket, "node", (F.col("label") == F.col("_main")).alias("main")))
    scratch.drop("members")
    sizes = rest.groupBy(*bucket).agg(
        F.ceil(F.sum((~F.col("main")).cast("int")) / block).cast("int").alias("_few"),
        F.ceil(F.sum(F.col("main").cast("int")) / block).cast("int").alias("_many"))
    chunk = F.when(F.col("main"), F.col("_few") + F.pmod(F.xxhash64("node"), F.col("_many")).cast("int")).otherwise(
        F.pmod(F.xxhash64("node"), F.col("_few")).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("main"), F.col("_few") - 1).otherwise(F.col("_few") + F.col("_many") - 1))
    blocks = (rest.join(sizes, bucket).withColumn("_mine", chunk).withColumn("_other", F.explode(others))
              .select(*bucket, "node", F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"),
                      (F.col("_mine") > F.col("_other")).cast("int").alias("side")))
    more = scratch.keep("more", blocks.hint("merge").join(texts.withColumnRenamed("doc_id", "node"), "node")
                        .groupBy(*bucket, "i", "j").applyInArrow(_linked(shared, least, size), "src bigint, dst bigint"))
    scratch.drop("texts", "rest")
    label = components(scratch, links.unionByName(more), "all")
    return signed.select("doc_id", "content"), heads.select("content", "node"), label


def classes(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``(doc_id, class_id)`` per row: class_id is the smallest doc_id of the row's group.

    Rows with equal words, or linked by a chain of pairs of similarity
    ``least`` or more, are one group. A text shorter than ``size`` words is
    one shingle; a null, empty or wordless text is a class of its own. Rows
    that share a doc_id take the smallest class of their texts. A null doc_id
    has a null class. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = rows.filter("doc_id is not null")
    idf = inverse_frequencies(*document_frequencies(named, size, scratch))
    signed, node_of, label = _linked_nodes(scratch, named, idf, size, least, block)
    class_of = node_of.join(label, "node", "left").select("content", F.coalesce("label", "node").alias("_g"))
    # versions of one document (a doc_id with several texts) take their smallest class
    of_id = scratch.keep("classes", signed.join(class_of, "content", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("_g", "doc_id")).alias("class_id")))
    scratch.close("classes")
    return rows.select("doc_id").join(of_id, "doc_id", "left")


def deduplicate(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row of each group, the smallest doc_id; columns unchanged.

    Of repeated rows with that id one stays. Rows with a null id stay.
    """
    keep = (classes(docs, size, least).filter("doc_id = class_id").select(F.col("doc_id").alias("_keep")).distinct())
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("bigint").alias("_id"))
    kept = packed.filter("_id is not null").join(keep, F.col("_id") == F.col("_keep"))
    first = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("_doc")))
    kept = kept.withColumn("_n", first).filter("_n = 1").select("_doc")
    return kept.unionByName(packed.filter("_id is null").select("_doc")).select("_doc.*")
