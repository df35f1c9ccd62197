"""Shared helpers: table scans, word hashing on byte buffers, hashed features.

Words follow one rule everywhere: A-Z are lower-cased, a word is a run of
digits, ASCII letters and non-ASCII characters. On UTF-8 bytes that is a run
of ``0-9``, ``a-z`` and bytes from 0x80 on, so whole batches are cut with
numpy and never become Python strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CODES = np.arange(256)
IS_WORD = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90)) \
    | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)

# Fixed odd multipliers: the polynomial base, its inverse modulo 2**64, a mixer.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIXER = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 values (bijective)."""
    x = (x ^ (x >> np.uint64(32))) * MIXER
    x = (x ^ (x >> np.uint64(32))) * MIXER
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 2 * BLOCK), base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if len(known) <= 4 * BLOCK:
            _POWERS[base] = known
    return known[:n]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string array; nulls are empty. No copy of the texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset:texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(offsets[0])
    raw, offsets = raw[base:int(offsets[-1])], offsets - base
    if texts.null_count:  # a null slot has no bytes in Arrow data written by Spark; make sure
        lengths = np.diff(offsets)
        lengths_ok = np.where(np.asarray(texts.is_null()), lengths == 0, True)
        if not lengths_ok.all():
            return text_buffer(texts.fill_null(""))
    return raw, offsets


def pieces(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a longer text stands alone."""
    out, start = [], 0
    n = len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        out.append((start, end))
        start = end
    return out


def polynomial_words(raw: np.ndarray, offsets: np.ndarray, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (uint64) of all texts in order, and the words' bounds per text, for hashed features.

    The hash of a word is its polynomial over the bytes, from one running sum,
    then mixed. ``bounds`` has one entry more than there are texts. With
    ``prefix``, only that many bytes of each word count and instead of the
    bounds comes whether each word is longer.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0 if prefix else len(offsets), bool if prefix else np.int64)
    is_word = IS_WORD[raw]
    edge = np.empty(n, dtype=bool)  # a word never runs on into the next text
    edge[0] = True
    np.logical_not(is_word[:-1], out=edge[1:])
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    starts = np.flatnonzero(is_word & edge)
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = edge[1:] | ~is_word[1:]
    ends = np.flatnonzero(is_word & last) + 1
    if prefix:
        longer = ends - starts > prefix
        ends = np.minimum(ends, starts + prefix)
    hashes = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # runs of words within about BLOCK bytes: short powers, little memory
        j = max(int(np.searchsorted(starts, starts[i] + BLOCK)), i + 1)
        low, high = int(starts[i]), int(ends[j - 1])  # ends do not fall
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((LOWER[raw[low:high]].astype(np.uint64) + np.uint64(1)) * powers(BASE, high - low),
                  out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        value = (total[e] - total[s]) * powers(BASE_INVERSE, high - low)[s]
        hashes[i:j] = mix(value ^ ((e - s).astype(np.uint64) << np.uint64(48)))
        i = j
    return hashes, longer if prefix else np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; a shorter, non-empty text is one run."""
    if len(hashes) == 0:
        return hashes
    k = min(size, len(hashes))
    n = len(hashes) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(BASE) + hashes[i:i + n])
    return out


LONG_WORD = 64


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts in order, and the words' bounds per text (one entry more)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = IS_WORD[raw]
    edge = np.empty(n, dtype=bool)  # a word never runs on into the next text
    edge[0] = True
    np.logical_not(is_word[:-1], out=edge[1:])
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    starts = np.flatnonzero(is_word & edge)
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = edge[1:] | ~is_word[1:]
    return starts, np.flatnonzero(is_word & last) + 1, np.searchsorted(starts, offsets)


def byte_runs(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end. No copies per position."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def string_names(runs: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit names of byte strings of ``byte_runs``: eight bytes at a time through the mixer.

    Every step is a bijection of what it adds, so no family of strings
    collides by structure, as with a polynomial.
    """
    out = mix(size.astype(np.uint64) + np.uint64(BASE))
    live, at = np.flatnonzero(size > 0), 0
    while len(live):
        left = size[live] - at
        chunk = runs[start[live] + at]
        unused = np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        out[live] = mix(out[live] * np.uint64(BASE) + ((chunk << unused) >> unused))
        live, at = live[left > 8], at + 8
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased word; long words by BLAKE2b."""
    lowered = LOWER[raw]
    length = ends - starts
    out = string_names(byte_runs(lowered), starts, np.where(length <= LONG_WORD, length, 0))
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(lowered[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the words' bounds per text (one entry more than texts)."""
    starts, ends, bounds = word_spans(raw, offsets)
    return (span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)), bounds
