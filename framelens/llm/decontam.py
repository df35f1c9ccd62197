"""Operator 1: benchmark decontamination with training suffix arrays.

The training texts are cut into shards (runs of rows of a scan task, about
``SHARD_BYTES`` each). A task builds the suffix array over the words of its
shard and binary-searches every test suffix in it: the interval of training
suffixes that share the first k words is narrowed word by word until it is
empty, which gives the longest verbatim match of the test suffix in the shard
and all its locations; the interval at the window length gives every location
of that window.

Test items travel in blocks of at most ``BLOCK_WORDS`` words, each broadcast
on its own and searched in turn, so what a task holds is bounded by a shard
and a block, and the training texts are never shuffled. A long item is cut
into segments that overlap by a window less one word, so no window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_buffer, words

WINDOW = 10
SHARD_BYTES = 1 << 22
BLOCK_WORDS = 1 << 20
FOUND = "struct<n_words:bigint,hits:array<struct<start:bigint,n:bigint>>,items:array<string>>"
_FOUND = pa.struct([("n_words", pa.int64()),
                    ("hits", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))),
                    ("items", pa.list_(pa.string()))])


class TestBlock:
    """Test segments as word codes: 1.. by hash order, 0 between segments."""

    def __init__(self, segments: list[tuple[str | None, int, np.ndarray]], window: int):
        hashes = [h for _, _, h in segments]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        gap = np.zeros(1, np.int64)
        codes = [np.append(np.searchsorted(self.vocabulary, h) + 1, gap) for h in hashes]
        self.codes = np.concatenate([*codes, gap])
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        ends = np.cumsum(sizes)
        self.item = np.repeat(np.arange(len(segments)), sizes)
        self.ids = [i for i, _, _ in segments]
        first = ends - sizes
        self.offset = np.concatenate([np.arange(len(c)) + s for c, (_, s, _) in zip(codes, segments)] or [gap])
        # suffix starts, the words left in their segment, and the length that makes a window there
        self.start = np.flatnonzero(self.codes[:-1])
        left = (ends - 1)[self.item] - np.arange(len(self.item))
        self.left = left[self.start]
        size = np.array([len(h) for h in hashes], dtype=np.int64)
        short = (size[self.item[self.start]] < window) & (self.start == first[self.item[self.start]])
        self.need = np.where(short, self.left, np.where(self.left >= window, window, 0))

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Word hashes -> codes; a word that no test item has is 0 and ends any match."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``codes``, sorted by their first ``depth`` words.

    A 0 ends a suffix; suffixes that start with 0 are left out. The first sort
    takes as many words as fit into 62 bits; groups of equal ranks are then
    sorted by the rank of what follows, doubling the depth, ties only.
    """
    n = len(codes)
    where = np.flatnonzero(codes)
    bits = max(1, int(codes.max(initial=0)).bit_length())
    width = max(1, 62 // bits)
    padded = np.append(codes, np.zeros(width, codes.dtype))
    key, live = np.zeros(len(where), np.int64), np.ones(len(where), bool)
    for i in range(width):
        word = padded[where + i]
        live &= word > 0
        key = (key << bits) | np.where(live, word, 0)
    order = np.argsort(key, kind="stable")
    found, key, live = where[order], key[order], live[order]
    new = np.ones(len(found), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[found] = group + 1
    stop = np.append(codes == 0, True)
    reach = np.flatnonzero(stop)  # next stop at or after a position
    at = np.arange(len(found))
    while width < depth:
        size = np.bincount(group, minlength=len(found))[group]
        tied = at[(size > 1) & live]
        # a suffix that ends within `width` words needs no further order
        tied = tied[reach[np.searchsorted(reach, found[tied])] - found[tied] > width] if len(tied) else tied
        if not len(tied):
            break
        tied = at[np.isin(group, np.unique(group[tied]))]
        follow = rank[np.minimum(found[tied] + width, n)]
        sub = np.lexsort((follow, group[tied]))
        moved, follow, same = found[tied][sub], follow[sub], group[tied][sub]
        found[tied] = moved
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (same[1:] != same[:-1]) | (follow[1:] != follow[:-1])
        group[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[found[tied]] = group[tied] + 1
        width *= 2
    return found


def search(block: TestBlock, codes: np.ndarray, found: np.ndarray):
    """Binary search of every test suffix in the suffix array of a shard.

    Returns per test suffix the longest match (words), its interval of the
    array, and the interval of its window (empty if the window is absent).
    """
    m = len(block.start)
    longest, best = np.zeros(m, np.int64), np.zeros((2, m), np.int64)
    window = np.zeros((2, m), np.int64)
    low, high = np.zeros(m, np.int64), np.full(m, len(found), np.int64)
    alive = np.flatnonzero(block.left > 0)
    depth = 0
    while len(alive) and len(found):
        word = block.codes[block.start[alive] + depth]

        def bound(right: bool) -> np.ndarray:
            lo, hi = low[alive].copy(), high[alive].copy()
            while True:
                open_ = lo < hi
                if not open_.any():
                    return lo
                mid = (lo + hi) >> 1
                here = codes[np.minimum(found[np.minimum(mid, len(found) - 1)] + depth, len(codes) - 1)]
                below = (here <= word) if right else (here < word)
                lo = np.where(open_ & below, mid + 1, lo)
                hi = np.where(open_ & ~below, mid, hi)

        left, right = bound(False), bound(True)
        hit = left < right
        alive, left, right = alive[hit], left[hit], right[hit]
        low[alive], high[alive] = left, right
        depth += 1
        longest[alive] = depth
        best[0, alive], best[1, alive] = left, right
        full = block.need[alive] == depth
        window[0, alive[full]], window[1, alive[full]] = left[full], right[full]
        alive = alive[block.left[alive] > depth]
    return longest, best, window


def _shards(texts: pa.Array, shard_bytes: int):
    """``(first row, codes-ready word hashes, word bounds)`` of each shard of a batch."""
    raw, offsets = text_buffer(texts)
    for a, b in pieces(offsets, shard_bytes):
        part = raw[offsets[a]:offsets[b]]
        hashes, bounds = words(part, offsets[a:b + 1] - offsets[a])
        yield a, hashes, bounds


def _index(block: TestBlock, hashes: np.ndarray, bounds: np.ndarray):
    """Codes of a shard with a 0 after each text, the text of each code, the suffix array."""
    n = len(bounds) - 1
    codes = np.zeros(len(hashes) + n, np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    codes[np.arange(len(hashes)) + doc] = block.encode(hashes)
    starts = bounds[:-1] + np.arange(n)
    depth = int(block.left.max(initial=1))
    return codes, starts, suffix_array(codes, depth)


def _expand(low: np.ndarray, high: np.ndarray):
    """Interval numbers and places of all members of the intervals."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which]
    return which, place


def found_in(block: TestBlock, hashes: np.ndarray, bounds: np.ndarray):
    """Per text of a shard: word count, hit runs, ids of the items found."""
    codes, starts, array = _index(block, hashes, bounds)
    n = len(starts)
    _, _, (low, high) = search(block, codes, array)
    used = np.flatnonzero(high > low)
    empty = [{"n_words": int(w), "hits": [], "items": []} for w in np.diff(bounds)]
    if not len(used):
        return empty
    # equal windows share an interval: expand it once, keep all its items
    interval, group = np.unique(np.stack([low[used], high[used], block.need[used]]), axis=1,
                                return_inverse=True)
    group = group.reshape(-1)
    which, place = _expand(interval[0], interval[1])
    at = array[place]
    text = np.searchsorted(starts, at, side="right") - 1
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + interval[2][which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    run, end = turn[::2], turn[1::2]
    owner = np.searchsorted(starts, run, side="right") - 1
    for t, a, b in zip(owner.tolist(), (run - starts[owner]).tolist(), (end - run).tolist()):
        empty[t]["hits"].append({"start": a, "n": b})
    order = np.argsort(group, kind="stable")
    item_at, item_end = np.searchsorted(group[order], [np.arange(interval.shape[1]),
                                                       np.arange(1, interval.shape[1] + 1)])
    items = block.item[block.start[used[order]]]
    pairs = np.unique(np.stack([text, which]), axis=1)
    for t, g in zip(*pairs.tolist()):
        empty[t]["items"].extend(block.ids[i] for i in items[item_at[g]:item_end[g]])
    for t in set(pairs[0].tolist()):
        empty[t]["items"] = sorted({i for i in empty[t]["items"] if i is not None})
    assert n == len(empty)
    return empty


def test_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[TestBlock]:
    """Blocks of at most ``block_words`` words, read one after another."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    segments, room = [], block_words
    for row in rows.filter("t is not null").toLocalIterator(prefetchPartitions=True):
        hashes, _ = words(*text_buffer(pa.array([row["t"]])))
        start, stride = 0, max(block_words - window + 1, 1)
        while len(hashes):
            part = hashes[start:start + block_words]
            if len(part) > room and segments:
                yield TestBlock(segments, window)
                segments, room = [], block_words
            segments.append((row["i"], start, part))
            room -= len(part)
            if start + len(part) >= len(hashes):
                break
            start += stride
    yield TestBlock(segments, window)  # the last block, or an empty one: texts are counted all the same


test_blocks.__test__ = False
TestBlock.__test__ = False


def _finder(shared, shard_bytes: int):
    """Column function text -> findings of one broadcast block."""
    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for _, hashes, bounds in _shards(texts, shard_bytes):
                rows += found_in(shared.value, hashes, bounds)
            yield pa.array(rows, type=_FOUND)

    return find


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``found``: n_words, hit runs (start, n in words, merged) and items, per row.

    Null and empty texts have no words and no hits; a null item text is no
    item; items with a null id mark words but are not listed; an item shorter
    than ``window`` counts as a whole. Repeated rows are judged alike, an
    empty benchmark finds nothing. Other columns pass through; a column
    named ``found`` is replaced.
    """
    sc = docs.sparkSession.sparkContext
    parts = [_finder(sc.broadcast(block), shard_bytes)(F.col("text"))
             for block in test_blocks(benchmark, window, block_words)]
    out = docs.withColumn("found", parts[0])
    for part in parts[1:]:
        out = out.withColumn("_next", part).withColumn("found", _merged("found", "_next")).drop("_next")
    return out


def _merged(a: str, b: str):
    """Union of two findings of one text: runs are merged, items united."""
    run = "struct<start:bigint,n:bigint>"
    return F.expr(f"""named_struct('n_words', {a}.n_words, 'hits',
      aggregate(array_sort(concat({a}.hits, {b}.hits)), cast(array() as array<{run}>), (acc, x) ->
        CASE WHEN size(acc) > 0 AND element_at(acc, -1).start + element_at(acc, -1).n >= x.start
        THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'n',
          greatest(element_at(acc, -1).n, x.start + x.n - element_at(acc, -1).start))))
        ELSE concat(acc, array(x)) END),
      'items', array_sort(array_union({a}.items, {b}.items)))""")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of any test item, columns unchanged."""
    judged = judge(docs.select(F.struct("*").alias("_doc"), F.col("text")), benchmark, window)
    return judged.filter(F.size("found.hits") == 0).select("_doc.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                    shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Longest verbatim match of every test suffix over all shards.

    One row per (item_id, test_start) whose match has ``window`` words or
    reaches the item's end: ``n`` words, ``doc_id`` and ``doc_start`` of the
    first place (smallest doc_id) and ``places``, the number of places of that
    length in all shards.
    """
    sc = docs.sparkSession.sparkContext
    fields = pa.schema([("item_id", pa.string()), ("test_start", pa.int64()), ("n", pa.int64()),
                        ("doc_id", pa.int64()), ("doc_start", pa.int64()), ("places", pa.int64())])
    out = None
    for block in test_blocks(benchmark, window, block_words):
        shared = sc.broadcast(block)

        def shard_rows(batches, shared=shared):
            for batch in batches:
                ids = np.array([-1 if i is None else i for i in batch.column(0).to_pylist()], dtype=np.int64)
                for first, hashes, bounds in _shards(batch.column(1), shard_bytes):
                    block = shared.value
                    codes, starts, array = _index(block, hashes, bounds)
                    longest, (low, high), _ = search(block, codes, array)
                    keep = np.flatnonzero((longest > 0) & (longest >= np.minimum(block.left, window)))
                    which, place = _expand(low[keep], high[keep])
                    at = array[place]
                    text = np.searchsorted(starts, at, side="right") - 1
                    order = np.lexsort((at - starts[text], ids[first + text], which))
                    head = order[np.unique(which[order], return_index=True)[1]]
                    s = block.start[keep]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block.ids[i] for i in block.item[s]], pa.string()), pa.array(block.offset[s]),
                        pa.array(longest[keep]), pa.array(ids[first + text[head]]),
                        pa.array((at - starts[text])[head]), pa.array(high[keep] - low[keep])], schema=fields)

        found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
            shard_rows, "item_id string, test_start bigint, n bigint, doc_id bigint, doc_start bigint, places bigint")
        out = found if out is None else out.unionByName(found)
    per_length = out.groupBy("item_id", "test_start", "n").agg(
        F.min(F.struct("doc_id", "doc_start")).alias("at"), F.sum("places").alias("places"))
    return per_length.groupBy("item_id", "test_start").agg(
        F.max(F.struct("n", "at", "places")).alias("m")).select(
        "item_id", "test_start", "m.n", "m.at.doc_id", "m.at.doc_start", "m.places")
