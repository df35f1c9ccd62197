"""Operator 5: pack token sequences by a configuration linear program.

A pattern (configuration) is a multiset of piece lengths that fits into one
sequence. The program asks for the fewest patterns that cover the histogram of
lengths. Multiplicative weights solve it: prices start at the volume bound
(length / capacity, the dual of "no sequence holds more than its capacity"),
fall exponentially with how much of a length is covered already, and a
knapsack dynamic program finds the patterns of the highest price, which are
used in whole numbers until every length is covered. Only lengths with fewer
pieces left than a pattern asks for are packed best fit, longest first, again
as patterns with multiplicities.

Only the histogram (one count per length, ``capacity`` at most) reaches the
driver. Each piece learns its place from its rank within its length, so the
assignment is a lookup on every executor and no task sees a whole length.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CAPACITY = 2048
RANK_BUCKET = 4096
ROUNDS = 100_000
PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>>"


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """Token ids of one text as uint32.

    The vocabulary's ranks give the same ids as its ``tokenizers`` file, at a
    third of the CPU time; texts holding a special token's string go to
    ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))

    def encode(text: str) -> np.ndarray:
        if "<|" in text:
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def token_pieces(capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", end_id: int = 0,
                 keep_ids: bool = False):
    """Column function text -> pieces; a document ends with ``end_id``.

    A document longer than ``capacity`` is cut into whole pieces; the first
    takes the remainder. A null text is empty: one piece, the end id.
    """
    @F.arrow_udf(PIECE)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoder(vocabulary)
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                                   ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]))
        for texts in batches:
            rows = []
            for text in texts:
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                rows.append([{"piece": i, "start": a, "length": b - a,
                              "ids_crc32": zlib.crc32(ids[a:b].tobytes()),
                              "ids": ids[a:b].astype(np.int32) if keep_ids else None}
                             for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))])
            yield pa.array(rows, type=kind)

    return cut


def best_values(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest total price in each room (unbounded knapsack) and the length taken there, -1 for none.

    Lengths without a price are never taken.
    """
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    at = np.flatnonzero(price > 0)
    sizes, price = lengths[at], price[at]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = upto[room]
        best[room] = best[room - 1]
        if k:
            value = best[room - sizes[:k]] + price[:k]
            i = int(value.argmax())
            if value[i] > best[room]:
                best[room], take[room] = value[i], at[i]
    return best, take


def _traced(lengths: np.ndarray, take: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """Counts of the best pattern that holds the length ``first``."""
    counts, room = {first: 1}, capacity - int(lengths[first])
    while room > 0:
        i = int(take[room])
        if i < 0:
            room -= 1
        else:
            counts[i] = counts.get(i, 0) + 1
            room -= int(lengths[i])
    return counts


def configuration_program(lengths: np.ndarray, demand: np.ndarray, capacity: int,
                          rounds: int = ROUNDS, step: float = 0.25, rate: float = 2.0, near: float = 0.05):
    """Whole patterns ``[({index: count}, times)]`` by multiplicative weights, and the pieces left.

    A length is priced at its volume share, lowered by ``exp(-rate * covered)``.
    Each round solves one dynamic program and takes, for every length, the best
    pattern that holds it, as long as its value at the prices reached meanwhile
    is within ``near`` of the best. A pattern is used for ``step`` of the demand
    of its scarcest length, in whole numbers and no more often than the pieces
    left allow. The program ends when no length is left that a pattern of the
    program can use; ``rounds`` only guards against a run without an end.
    """
    left = demand.astype(np.int64).copy()
    usable = left > 0
    amounts: dict[tuple, int] = {}
    for _ in range(rounds):
        if not usable.any():
            break
        covered = 1 - left / demand
        low = covered[usable].min()
        price = np.where(usable, lengths / capacity * np.exp(-rate * (covered - low)), 0.0)
        best, take = best_values(lengths, price, capacity)
        value = np.where(usable, price + best[capacity - lengths], -1.0)
        least, fresh = (1 - near) * value.max(), False
        for i in np.argsort(-value, kind="stable").tolist():
            if value[i] < least:
                break
            counts = _traced(lengths, take, i, capacity)
            if sum(n * price[j] for j, n in counts.items()) < least:
                continue
            short = [j for j, n in counts.items() if left[j] < n]
            if short:  # too few pieces for this pattern: what is left of them is packed at the end
                usable[short] = False
                price[short] = 0
                fresh = True
                continue
            times = min(min(int(left[j]) // n for j, n in counts.items()),
                        max(1, int(step * min(demand[j] / n for j, n in counts.items()))))
            key = tuple(sorted(counts.items()))
            amounts[key] = amounts.get(key, 0) + times
            for j, n in counts.items():
                left[j] -= times * n
                usable[j] &= left[j] > 0
                price[j] = lengths[j] / capacity * np.exp(-rate * (1 - left[j] / demand[j] - low)) if usable[j] else 0
            fresh = True
        assert fresh  # the best pattern is used or one of its lengths ends
    else:
        if usable.any():
            raise RuntimeError(f"the configuration program has not covered all lengths after {rounds} rounds")
    return [(dict(k), n) for k, n in amounts.items()], left


def pack_rest(lengths: np.ndarray, left: np.ndarray, capacity: int):
    """Patterns ``[({index: count}, times)]`` for the pieces left, best fit.

    The longest piece left opens a pattern, which takes the longest pieces
    that still fit, as often as the counts allow.
    """
    left, out = left.copy(), []
    while left.any():
        room, counts = capacity, {}
        for i in np.flatnonzero(left)[::-1].tolist():
            if lengths[i] <= room:
                counts[i] = int(min(left[i], room // lengths[i]))
                room -= counts[i] * int(lengths[i])
                if room < lengths[0]:
                    break
        times = min(int(left[i]) // n for i, n in counts.items())
        for i, n in counts.items():
            left[i] -= times * n
        out.append((counts, times))
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS):
    """Patterns ``[({length: count}, times)]`` for a histogram of lengths.

    Where plain best fit needs fewer sequences than the program (few pieces
    per length, so that whole numbers cost more than the program gains), its
    patterns are taken.
    """
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(k for k, n in histogram.items() if 0 < k < capacity and n), dtype=np.int64)
    if len(lengths):
        demand = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
        placed, left = configuration_program(lengths, demand, capacity, rounds)
        placed += pack_rest(lengths, left, capacity)
        plain = pack_rest(lengths, demand, capacity)
        for counts, times in min(placed, plain, key=lambda p: sum(times for _, times in p)):
            out.append(({int(lengths[i]): n for i, n in counts.items()}, times))
    return out


def _places(patterns):
    """Lookup arrays over (length, first rank): sequence base, count, offset, sorted."""
    rows, used, base = [], {}, 0
    for counts, times in patterns:
        offset = 0
        for length in sorted(counts, reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, base, counts[length], offset))
            used[length] = first + counts[length] * times
            offset += length * counts[length]
        base += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Sequences hold at most ``capacity`` tokens, offsets are gapless from 0.
    Equal lengths and repeated rows are ranked in any order. No rows give no
    rows. A length outside the range, or null, raises an error.
    """
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).limit(capacity + 2).collect()}
    if any(k is None or not 0 < k <= capacity for k in histogram):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    places = _places(solve(histogram, capacity, rounds))
    widths = np.ones(capacity + 1, dtype=np.int64)
    for k, n in histogram.items():
        widths[k] = -(-n // RANK_BUCKET)
    shared = pieces.sparkSession.sparkContext.broadcast(places)  # at most patterns x lengths

    # the rank within a length: within a bucket of about RANK_BUCKET rows, plus the buckets before
    keys = [c for c in ("doc_id", "piece", "start") if c in pieces.columns]
    spread = F.xxhash64(*keys) if keys else F.xxhash64(*pieces.columns)
    width = F.element_at(F.array(*[F.lit(int(w)) for w in widths]), (F.col("length") + 1).cast("int"))
    bucketed = pieces.withColumn("_bucket", F.pmod(spread, width))
    counts = bucketed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("length", "_bucket", (F.sum("_n").over(
        Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*(keys or ["length"])))
    ranked = bucketed.withColumn("_rank", local).join(before, ["length", "_bucket"])

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        table = shared.value
        span = np.int64(1) << 40
        length, rank = np.asarray(lengths), np.asarray(ranks)
        at = np.searchsorted(table[:, 0] * span + table[:, 1], length * span + rank, side="right") - 1
        _, first, base, count, offset = table[at].T if len(table) else np.zeros((5, 0), np.int64)
        inside = rank - first
        return pa.StructArray.from_arrays(
            [pa.array(base + inside // count), pa.array(offset + inside % count * length)],
            ["sequence_id", "offset"])

    out = ranked.withColumn("_place", place("length", F.col("_rank") + F.col("_before") - 1))
    return out.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k",
                   end_id: int = 0, keep_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """Documents (doc_id, text) -> packed pieces; see ``token_pieces`` and ``pack``.

    Columns other than doc_id and text are left out. Null ids stay null.
    The pieces are written once to the checkpoint folder: tokenising is the
    dear part and must not run again for the histogram, ranks and lookup.
    """
    cut = token_pieces(capacity, vocabulary, end_id, keep_ids)
    cols = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    pieces = docs.select("doc_id", F.explode(cut("text")).alias("_p")).select(
        "doc_id", *[f"_p.{c}" for c in cols])
    return pack(cut_lineage(pieces), capacity, rounds)
