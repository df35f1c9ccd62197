"""Operator 13: suffix-array dedup of long repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``threshold`` bytes that covers it also starts
earlier (smaller doc_id, or same document and earlier start). Spark sorts
(rank, position) rows at growing lengths; a row whose rank occurs once is out,
the others are ranked again by pairs, the rank so far and that of the bytes at
a larger offset, until they are unique or past the threshold. A rank is a hash
name, computed where the text lies, so only names and positions are sorted,
never texts.

Four rounds. (1) Prefixes of ``gram`` bytes, at anchors only: each window of
``threshold`` bytes is known by its lowest-named gram, which equal windows
share at the same place, so one row stands for all the windows (about 35) that
choose it, and nothing is lost. (2) Anchors with a repeated gram, ranked by the
pair of names of their whole surroundings, all bytes of all their windows: of
equal ones the first is kept and the others are repeats as a whole. (3) Firsts
whose gram has other surroundings too, in blocks of neighbouring windows, by
the bytes that all windows of the block cover, then by the pair of names of all
its bytes, as in (2). (4) Windows of first blocks that are left, one by one,
ranked by the pair of their halves, past the threshold.

Hot ranks: a task looks for repeats among its own rows first. Of equal ones a
single witness goes to the rank's partition, the others are spread at random.
Later groupings aggregate before they shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, byte_runs, mix, pieces, string_names, text_buffer
from .scratch import Scratch

THRESHOLD = 100
PIECE = 1 << 20
ENTRIES = 1 << 16
POSITION = np.uint64((1 << 24) - 1)
AT = "doc bigint, version bigint, place bigint"
# a place is a start in the text with two distances of at most 16 bits: start << 32 | to low << 16 | to high


def names(raw: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of ``length`` bytes, by doubling; equal strings have equal names."""
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * np.uint64(BASE) + b)

    n = max(len(raw) - length + 1, 0)
    h = min(length, 8)
    out = byte_runs(raw)[:max(len(raw) - h + 1, 0)]
    if h < 8:
        shift = np.uint64(64 - 8 * h)
        out = (out << shift) >> shift
    out = mix(out + np.uint64(1))
    while 2 * h <= length:
        out = pair(out[:len(out) - h], out[h:]) if len(out) > h else out[:0]
        h *= 2
    if h < length:
        out = pair(out[:n], out[length - h:length - h + n])
    return out[:n]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    h = 1
    while 2 * h <= width:
        values = np.minimum(values[:-h], values[h:]) if len(values) > h else values[:0]
        h *= 2
    rest = width - h
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest and len(values) > rest else (
        values if not rest else values[:0])


def gram_length(threshold: int) -> int:
    """Largest power of two up to half the threshold (32 of 100 bytes leaves 69 places to choose from)."""
    return 1 << max(0, (threshold // 2).bit_length() - 1)


def anchors(raw: np.ndarray, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """``(row, start, low, high, name)`` of the anchors of a piece of texts, all relative to the piece.

    ``low`` to ``high`` are the starts of the windows that choose the anchor;
    windows never cross a text's end.
    """
    gram = gram_length(threshold)
    none = np.zeros(0, np.int64)
    if len(raw) < threshold:
        return none, none, none, none, none.astype(np.uint64)
    name = names(raw, gram)
    tagged = (name & ~POSITION) | np.arange(len(name), dtype=np.uint64)  # of equal ones the leftmost
    chosen = (sliding_minimum(tagged, threshold - gram + 1) & POSITION).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int64)
    long_enough = np.flatnonzero(np.diff(offsets) >= threshold)
    np.add.at(inside, offsets[long_enough], 1)
    np.add.at(inside, offsets[long_enough + 1] - threshold + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[:len(chosen)])
    chosen = chosen[window]
    fresh = np.ones(len(window), bool)  # a window of another text never chooses the same anchor
    fresh[1:] = chosen[1:] != chosen[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(window)) - 1
    start = chosen[first]
    return np.searchsorted(offsets, start, side="right") - 1, start, window[first], window[last], name[start]


def text_pieces(offsets: np.ndarray, threshold: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first row, end row, from byte, to byte)``: rows of about PIECE bytes; a longer text in overlapping parts."""
    for a, b in pieces(offsets, PIECE):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= 2 * PIECE:
            yield a, b, low, high
            continue
        while low + threshold <= high:  # parts share threshold - 1 bytes, so that each window lies in one
            yield a, b, low, min(low + PIECE + threshold - 1, high)
            low += PIECE


def each_anchor(batch: pa.RecordBatch, threshold: int) -> Iterator[tuple]:
    """``(row, start, low, high, name, what turns a place in the piece into one in the text)``, piece by piece."""
    raw, offsets = text_buffer(batch.column(2))
    for a, b, low, high in text_pieces(offsets, threshold):
        piece = raw[low:high]
        bounds = np.clip(offsets[a:b + 1], low, high) - low
        row, start, first, last, name = anchors(piece, bounds, threshold)
        yield row + a, start, first, last, name, low - offsets[row + a]


def _ranked(name: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns part, known and the given ones: whether the name repeats here, and where the row is to be sorted."""
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    known, spread = np.zeros(len(name), bool), np.zeros(len(name), bool)
    known[order[1:]] = same
    spread[order[1:]] = same  # all but the first of equal names
    known[order[:-1]] |= same
    part = np.where(spread, mix(name + np.arange(len(name), dtype=np.uint64)), name)
    return [part, known, *columns]


def repeated(rows: DataFrame) -> DataFrame:
    """Rows whose rank occurs more than once: one sort by rank, each sorted partition read as a stream."""
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stayed = None, False  # the last row so far, and whether it is known to stay
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            part, stays = table.column(0).to_numpy(), np.array(table.column(1))
            same = part[1:] == part[:-1]
            stays[1:] |= same
            stays[:-1] |= same
            stays[0] |= stayed
            held, stayed = table.slice(len(stays) - 1).to_batches()[0], bool(stays[-1])
            yield from table.slice(0, len(stays) - 1).filter(pa.array(stays[:-1])).select(kept).to_batches()
        if held is not None and stayed:
            yield held.select(kept)

    kept = rows.columns[2:]
    schema = ", ".join(f"{c} bigint" for c in kept)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(sieve, schema)


def _lists(rows: DataFrame, items: Column) -> DataFrame:
    return rows.groupBy("doc", "version").agg(F.collect_list(items).alias("at"))


def _rows(texts: DataFrame, schema: str, columns: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]]) -> DataFrame:
    """mapInArrow with a function from a batch to lists of equally long columns."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in columns(batch):
                arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in found]
                yield pa.RecordBatch.from_arrays(arrays, names=fields)

    return texts.mapInArrow(rows, schema)


def _identified(docs: DataFrame) -> DataFrame:
    """``(doc, version, text)``: a null doc_id is the smallest; rows of one id with other texts are its versions."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    return docs.select(doc.alias("doc"), F.xxhash64("text").alias("version"), "text")


def anchor_rows(texts: DataFrame, threshold: int) -> DataFrame:
    """Round 1: every anchor, ranked by its gram."""
    def found(batch):
        held: list[tuple] = []
        for row, start, low, high, name, shift in each_anchor(batch, threshold):
            place = (start + shift) << 32 | (start - low) << 16 | (start - high)
            held.append((name, batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], place))
            if sum(len(x[0]) for x in held) > PIECE:
                yield joined(held)
                held = []
        if held:
            yield joined(held)

    def joined(held):
        name, *columns = (np.concatenate(x) for x in zip(*held))
        return _ranked(name, columns)

    return _rows(texts, f"part bigint, known boolean, {AT}", found)


def _listed(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``(byte runs, row, first byte of the row's text, entries of column at)``, some entries at a time."""
    raw, offsets = text_buffer(batch.column(2))
    lists = batch.column(3)
    entries = lists.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
    runs = byte_runs(raw)
    for i in range(0, len(row), ENTRIES):
        part = row[i:i + ENTRIES]
        yield runs, part, offsets[part], entries[i:i + ENTRIES]


def _of(batch: pa.RecordBatch, row: np.ndarray) -> list[np.ndarray]:
    return [batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]]


def _bounds(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = place >> 32
    return start, start - (place >> 16 & 0xFFFF), start - (place & 0xFFFF)


def _halves(runs: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = size // 2
    return string_names(runs, start, half), string_names(runs, start + half, size - half)


def surroundings(texts: DataFrame, threshold: int) -> DataFrame:
    """Round 2: ``(name, left, right, doc, version, place)``: gram and pair of names of the anchors in column ``at``."""
    gram = gram_length(threshold)

    def found(batch):
        for runs, row, base, place in _listed(batch):
            start, low, high = _bounds(place)
            name = string_names(runs, base + start, np.full(len(start), gram))
            left, right = _halves(runs, base + low, high - low + threshold)
            yield [name, mix(left + (start - low).astype(np.uint64)), right, *_of(batch, row), place]

    return _rows(texts, f"name bigint, left bigint, right bigint, {AT}", found)


def block_rows(texts: DataFrame, threshold: int) -> DataFrame:
    """Round 3: blocks of the windows of the anchors in column ``at``, ranked by the bytes their windows share.

    A block is a range of distances from window start to anchor, so equal
    windows fall into the same block. Columns name, left, right, doc, version,
    place; the place is the block's last window, with the distance to its first.
    """
    block = (threshold - gram_length(threshold)) // 4 + 1
    core = threshold - block + 1

    def found(batch):
        for runs, row, base, place in _listed(batch):
            start, low, high = _bounds(place)
            near, count = (start - high) // block, (start - low) // block - (start - high) // block + 1
            each = np.repeat(np.arange(len(row)), count)
            number = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            last = (start - near * block)[each] - number * block  # last window start a block can have
            name = string_names(runs, base[each] + last, np.full(len(each), core))
            first, end = np.maximum(low[each], last - block + 1), np.minimum(high[each], last)
            left, right = _halves(runs, base[each] + first, end - first + threshold)
            left = mix(left + (last - first).astype(np.uint64))
            yield _ranked(name, [name, left, right, *_of(batch, row[each]), end << 32 | (end - first) << 16])

    return _rows(texts, f"part bigint, known boolean, name bigint, left bigint, right bigint, {AT}", found)


def window_rows(texts: DataFrame, threshold: int) -> DataFrame:
    """Round 4: all windows of the blocks in column ``at``, ranked by the pair of their halves."""
    def found(batch):
        for runs, row, base, place in _listed(batch):
            _, low, high = _bounds(place)
            count = high - low + 1
            each = np.repeat(np.arange(len(row)), count)
            start = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            left, right = _halves(runs, base[each] + start, np.full(len(each), threshold))
            yield _ranked(mix(left * np.uint64(BASE) + right), [left, right, *_of(batch, row[each]), start << 32])

    return _rows(texts, f"part bigint, known boolean, left bigint, right bigint, {AT}", found)


def judge(rows: DataFrame) -> DataFrame:
    """``(doc, version, place, later)`` of the rows that repeat an earlier pair, or are first of a pair whose name has others."""
    place = F.struct("doc", "place")
    first = rows.groupBy("name", "left", "right").agg(F.min(place).alias("first"))
    open_ = first.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    first = first.join(open_.withColumn("open", F.lit(True)), "name", "left")
    return (rows.join(first, ["name", "left", "right"]).withColumn("later", place > F.col("first"))
            .filter("later or open").select("doc", "version", "place", "later"))


def repeats(docs: DataFrame, threshold: int = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """``(doc, version, low, high)``: byte ranges to remove, overlapping ones included."""
    scratch = scratch or Scratch(docs.sparkSession)
    texts = _identified(docs.filter(F.octet_length("text") >= threshold))

    live = scratch.keep("grams", repeated(anchor_rows(texts, threshold)))
    known = scratch.keep("texts", texts.join(_lists(live, F.col("place")), ["doc", "version"]))
    scratch.drop("grams")
    around = scratch.keep("around", surroundings(known, threshold))
    anchored = scratch.keep("anchored", judge(around))
    scratch.drop("around")

    def left_over(judged: DataFrame) -> DataFrame:
        """Texts with the places still to be told apart."""
        return known.select("doc", "version", "text").join(
            _lists(judged.filter("not later"), F.col("place")), ["doc", "version"])

    blocks = scratch.keep("blocks", repeated(block_rows(left_over(anchored), threshold)))
    blocked = scratch.keep("blocked", judge(blocks))
    scratch.drop("blocks")
    windows = scratch.keep("windows", repeated(window_rows(left_over(blocked), threshold)))
    scratch.drop("texts")
    place = F.struct("doc", "place")
    first = windows.groupBy("left", "right").agg(F.min(place).alias("first"))
    later = windows.join(first, ["left", "right"]).filter(place > F.col("first")).select("doc", "version", "place")
    start = F.shiftright("place", 32)
    return (anchored.unionByName(blocked).filter("later").drop("later").unionByName(later).select(
        "doc", "version", (start - F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF))).alias("low"),
        (start - F.col("place").bitwiseAND(F.lit(0xFFFF)) + threshold).alias("high")))


def _cut(texts: pa.Array, lists: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Per text the bytes that stay and the maximal removed runs."""
    raw, offsets = text_buffer(texts)
    flat = lists.values
    low, high = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))
    for r in range(len(texts)):
        body, i, j = raw[offsets[r]:offsets[r + 1]], ends[r], ends[r + 1]
        if i == j:
            yield body.tobytes(), np.zeros((0, 2), np.int64)
            continue
        depth = np.zeros(len(body) + 1, np.int32)
        np.add.at(depth, low[i:j], 1)
        np.add.at(depth, high[i:j], -1)
        gone = np.cumsum(depth)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        yield body[~gone].tobytes(), edges.reshape(-1, 2)


CUT = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                 ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 ("kept", pa.binary()), ("kept_sha256", pa.string())])


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, column: str = "deduped", bytes_too: bool = True) -> DataFrame:
    """``docs`` with ``column``: struct of n_bytes, n_removed, spans (start, end in bytes), kept bytes, kept_sha256.

    Texts are judged as UTF-8 bytes; a null text is empty, one shorter than
    ``threshold`` has no match. A null doc_id is the smallest. Rows that share
    a doc_id are versions of one document: strings that start at the same place
    of both are not earlier than each other. Other columns are kept; one named
    ``column`` is replaced. Very long texts are named in parts. An empty table
    gives an empty result. ``kept`` may end inside a character and is null
    unless ``bytes_too``.
    """
    scratch = Scratch(docs.sparkSession)
    ranges = repeats(docs, threshold, scratch)
    lists = scratch.keep("ranges", ranges.groupBy("doc", "version").agg(F.collect_list(F.struct("low", "high")).alias("_at")))
    scratch.close("ranges")

    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,spans:array<struct<start:bigint,end:bigint>>,kept:binary,"
                 "kept_sha256:string>")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = []
            for kept, spans in _cut(texts, found):
                removed = int((spans[:, 1] - spans[:, 0]).sum())
                out.append({"n_bytes": len(kept) + removed, "n_removed": removed,
                            "spans": [{"start": a, "end": b} for a, b in spans.tolist()],
                            "kept": kept if bytes_too else None, "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.array(out, type=CUT)

    body = docs.select(F.struct("*").alias("_doc"))
    keyed = body.select("_doc", F.coalesce(F.col("_doc.doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"),
                        F.xxhash64("_doc.text").alias("version"))
    at = F.coalesce("_at", F.array().cast("array<struct<low:bigint,high:bigint>>"))
    judged = keyed.join(lists, ["doc", "version"], "left").select("_doc", judge("_doc.text", at).alias("_judged"))
    kept = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c != column]
    return judged.select(*kept, F.col("_judged").alias(column))
