"""Term counts and best terms, column-wise inside tasks.

Spark finds the words, shuffles and adds up; the helpers here count the terms
of a few megabytes of words at a time and leave out rows that cannot be among
a group's best. Both hold a bounded amount of a task's rows.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PIECE_BYTES = 8 << 20      # words counted at once
PIECE_ROWS = 1 << 16
PENDING = 1 << 20          # counts of a bucket that wait to be added up
POSTING = 12               # bytes of a count in a payload, about


def group_codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(group number of every row, first row of every group) by the values of ``columns``; null is a value."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        found = c.dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * (len(found.dictionary) + 1) + found.indices.to_numpy(zero_copy_only=False),
                            return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + PIECE_BYTES, "right")), at + 1), at + PIECE_ROWS)
        yield batch.slice(at, to - at)
        at = to


def _words(piece: pa.RecordBatch, stop: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """(vocabulary, number of every word in it, row of every word) of the last column, without the stop words."""
    text = piece.column(piece.num_columns - 1)
    chars = np.frombuffer((" ".join(text.to_pylist()) + " ").encode(), np.uint8)
    row_ends = np.cumsum(pc.binary_length(text).to_numpy() + 1)
    space = chars == 32
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return None
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(chars[~space])).dictionary_encode()
    kept = pc.invert(pc.is_in(found.dictionary, stop)).to_numpy(zero_copy_only=False)
    word = found.indices.to_numpy().astype(np.int64)
    row = np.searchsorted(row_ends, starts, "right")
    return found.dictionary, word[kept[word]], row[kept[word]]


def _counted(piece: pa.RecordBatch, stop: pa.Array, bigrams: bool) -> Iterator[list[pa.Array]]:
    """Key columns, term and count of the words, then of the pairs of neighbouring words, of each group of keys."""
    keys = [piece.column(i) for i in range(piece.num_columns - 1)]
    group, first = group_codes(keys)
    if (found := _words(piece, stop)) is None:
        return
    vocab, word, row = found
    of, size = group[row], len(vocab)

    def counts(codes: np.ndarray, span: int, term) -> list[pa.Array]:
        codes, n = np.unique(codes, return_counts=True)
        at = pa.array(first[codes // span])
        return [*[k.take(at) for k in keys], term(codes % span), pa.array(n, pa.int64())]

    if len(word):
        yield counts(of * size + word, size, lambda c: vocab.take(pa.array(c)))
    if bigrams:
        near = row[1:] == row[:-1]
        if near.any():
            yield counts(((of[:-1] * size + word[:-1]) * size + word[1:])[near], size * size, lambda c:
                         pc.binary_join_element_wise(vocab.take(pa.array(c // size)), vocab.take(pa.array(c % size)), " "))


def counted_terms(listed: DataFrame, stop: list[str], bigrams: bool) -> DataFrame:
    """``(keys..., term, n)``: counts of the words in the last column (joined by spaces) per combination of the others.

    Without ``stop`` words; with ``bigrams``, also the pairs of words that are
    neighbours in a row once those are gone. Counts are added up in pieces of a
    task's rows: a combination comes once per piece, and the caller sums.
    """
    schema = T.StructType([*listed.schema.fields[:-1], T.StructField("term", T.StringType()),
                           T.StructField("n", T.LongType())])
    names, dropped = schema.names, list(stop)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(dropped, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                for columns in _counted(piece, words, bigrams):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return listed.mapInArrow(count, schema)


def bucket_of(term: Column, buckets: int) -> Column:
    """The bucket that ``packed_terms`` puts a term in."""
    words = F.split(term, " ")
    second = F.coalesce(F.crc32(F.get(words, F.lit(1)).cast("binary")), F.lit(0))
    return ((F.crc32(words[0].cast("binary")) + 31 * second) % buckets).cast("int")


def _packed(piece: pa.RecordBatch, stop: pa.Array, bigrams: bool, buckets: int) -> Iterator[tuple[int, bytes]]:
    keys = [piece.column(i) for i in range(piece.num_columns - 1)]
    group, first = group_codes(keys)
    if (found := _words(piece, stop)) is None or not len(found[1]):
        return
    vocab, word, row = found
    of, size, groups = group[row], len(vocab), len(first)
    crc = np.array([zlib.crc32(w.encode()) for w in vocab.to_pylist()], np.int64)
    near = np.flatnonzero(row[1:] == row[:-1]) if bigrams else np.zeros(0, np.int64)
    parts = []                       # (terms, buckets of the terms, postings of each, groups, counts) of words and of pairs
    for code in (word, word[near] * size + word[near + 1]):
        codes, n = np.unique(code * groups + (of if code is word else of[near]), return_counts=True)
        code, g = np.divmod(codes, groups)
        start = np.flatnonzero(np.diff(code, prepend=-1))
        a, b = (code[start], None) if not parts else np.divmod(code[start], size)
        at = (crc[a] if b is None else crc[a] + 31 * crc[b]) % buckets
        terms = vocab.take(pa.array(a)) if b is None else pc.binary_join_element_wise(
            vocab.take(pa.array(a)), vocab.take(pa.array(b)), " ")
        parts.append((terms, at, np.diff(np.append(start, len(code))), g, n))
    at, sizes, g, n = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
    order = np.argsort(at, kind="stable")
    begins, moved = np.cumsum(sizes) - sizes, sizes[order]
    posting = np.arange(moved.sum()) + np.repeat(begins[order] - (np.cumsum(moved) - moved), moved)
    terms = pa.chunked_array([p[0] for p in parts]).combine_chunks().take(pa.array(order))
    kind = np.uint16 if groups <= 1 << 16 else np.int64
    g, n, named = g[posting].astype(kind), n[posting].astype(np.uint32), [k.take(pa.array(first)) for k in keys]
    edges = np.searchsorted(at[order], np.arange(buckets + 1))
    ends = np.append(0, np.cumsum(moved))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        i, j = edges[b], edges[b + 1]
        text = "\n".join(terms.slice(i, j - i).to_pylist())
        raw = pickle.dumps((named, text, moved[i:j].astype(np.uint32), g[ends[i]:ends[j]], n[ends[i]:ends[j]]), 5)
        yield b, len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def packed_terms(listed: DataFrame, stop: list[str], bigrams: bool, buckets: int) -> DataFrame:
    """``(bucket, payload)``: the counts of ``counted_terms``, packed per piece and bucket of terms.

    A term comes once per piece, followed by the groups of keys that hold it
    and its counts there; ``unpacked`` gives them back. Packed so, the counts
    take about the room of the texts, not several times as much.
    """
    dropped = list(stop)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(dropped, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                found = list(_packed(piece, words, bigrams, buckets))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()),
                                                      pa.array([p for _, p in found], pa.binary())], ["bucket", "payload"])

    return listed.mapInArrow(pack, "bucket int, payload binary")


def unpacked(payload: bytes) -> tuple[list[pa.Array], pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(key columns of the groups, terms, postings of each term, group of every posting, its count)."""
    size = int.from_bytes(payload[:8], "little")
    named, text, sizes, g, n = pickle.loads(pa.decompress(payload[8:], size, "zstd", asbytes=True))
    return named, pa.array(text.split("\n")), sizes.astype(np.int64), g.astype(np.int64), n.astype(np.int64)


class Numbers:
    """Lasting numbers of tuples of values."""

    def __init__(self):
        self.number: dict[tuple, int] = {}

    def of(self, columns: list[pa.Array]) -> np.ndarray:
        values = zip(*[c.to_pylist() for c in columns])
        return np.array([self.number.setdefault(v, len(self.number)) for v in values], np.int64)


class Summed:
    """Sums of the unpacked counts of one bucket, added up whenever ``PENDING`` of them wait."""

    def __init__(self):
        self.groups, self.vocabulary, self.code, self.group, self.n, self.waiting = Numbers(), [], [], [], [], 0

    def add(self, payload: bytes) -> None:
        named, terms, sizes, g, n = unpacked(payload)
        at = sum(map(len, self.vocabulary))
        self.vocabulary.append(terms)
        self.code.append(np.repeat(np.arange(at, at + len(terms)), sizes))
        self.group.append(self.groups.of(named)[g])
        self.n.append(n)
        self.waiting += len(n)
        if self.waiting >= max(PENDING, len(self.n[0])):
            self.settle()
            self.waiting = 0

    def settle(self) -> None:
        """One entry per term and group, ordered by term."""
        if not self.n:
            return
        found = pa.chunked_array(self.vocabulary).combine_chunks().dictionary_encode()
        code = found.indices.to_numpy().astype(np.int64)[np.concatenate(self.code)]
        both = code * len(self.groups.number) + np.concatenate(self.group)
        order = np.argsort(both, kind="stable")
        both = both[order]
        start = np.flatnonzero(np.diff(both, prepend=-1))
        n = np.add.reduceat(np.concatenate(self.n)[order], start)
        code, group = np.divmod(both[start], len(self.groups.number))
        self.vocabulary, self.code, self.group, self.n = [found.dictionary], [code], [group], [n]


def summed_terms(packed: DataFrame, keys: list[T.StructField], min_df: int) -> DataFrame:
    """``(keys..., term, n, f)``: sums of the packed counts.

    ``packed`` holds whole buckets per partition, sorted. The first key is the model
    group, the second the topic: ``f`` is a term's sum per model group, and
    terms seen in fewer than ``min_df`` topics of a group are left out.
    """
    schema = T.StructType([*keys, T.StructField("term", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("f", T.LongType())])
    names = schema.names

    def rows(found: Summed) -> Iterator[pa.RecordBatch]:
        found.settle()
        if not found.n:
            return
        code, group, n, terms = found.code[0], found.group[0], found.n[0], found.vocabulary[0]
        tuples = list(found.groups.number)
        classes, topics = {}, {}
        of = np.array([classes.setdefault(t[0], len(classes)) for t in tuples], np.int64)
        topic = np.array([topics.setdefault(t[:2], len(topics)) for t in tuples], np.int64)
        whole, inverse = np.unique(code * len(classes) + of[group], return_inverse=True)
        f = np.zeros(len(whole), np.int64)
        np.add.at(f, inverse, n)
        _, first = np.unique(code * len(topics) + topic[group], return_index=True)
        kept = np.flatnonzero((np.bincount(inverse[first], minlength=len(whole)) >= min_df)[inverse])
        columns = [pa.array([t[i] for t in tuples], to_arrow_type(schema[i].dataType)) for i in range(len(keys))]
        for at in np.array_split(kept, -(-len(kept) // PIECE_ROWS)) if len(kept) else []:
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(group[at])) for c in columns], terms.take(pa.array(code[at])),
                                              pa.array(n[at]), pa.array(f[inverse[at]])], names)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in by_bucket(batches):
            found = Summed()
            for payload in payloads:
                found.add(payload)
            yield from rows(found)

    return packed.mapInArrow(add_up, schema)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """``(bucket, its payloads)`` of rows sorted by bucket."""
    rows = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for batch in batches for i in range(batch.num_rows))
    for bucket, found in itertools.groupby(rows, key=lambda r: r[0]):
        yield bucket, (p for _, p in found)


def packed_rows(df: DataFrame) -> DataFrame:
    """``(bucket, payload)`` of rows whose first column is their bucket: the others, packed ``PENDING`` rows at a time."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if n and (batch is None or n >= PENDING):
                table = pa.Table.from_batches(held).combine_chunks()
                bucket = table.column(0).to_numpy()
                order = np.argsort(bucket, kind="stable")
                places = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                out = []
                for rows in np.split(order, places[1:]):
                    raw = pickle.dumps([c.combine_chunks().take(pa.array(rows)) for c in table.columns[1:]], 5)
                    out.append(len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][places], pa.int32()), pa.array(out, pa.binary())],
                                                 ["bucket", "payload"])
                held, n = [], 0

    return df.mapInArrow(pack, "bucket int, payload binary")


class Vocabulary:
    """Weights and idf of a bucket's terms per group, from payloads ``(group columns..., term, weight, idf)``."""

    def __init__(self, payloads: list[bytes]):
        numbers, code, terms, values = Numbers(), [], [], []
        for payload in payloads:
            *group, term, weight, idf = pickle.loads(pa.decompress(
                payload[8:], int.from_bytes(payload[:8], "little"), "zstd", asbytes=True))
            number, first = group_codes(group)
            code.append(numbers.of([c.take(pa.array(first)) for c in group])[number])
            terms.append(term)
            values.append(np.column_stack([weight.to_numpy(zero_copy_only=False), idf.to_numpy(zero_copy_only=False)]))
        self.groups = numbers.number
        found = pa.chunked_array(terms, pa.string()).combine_chunks().dictionary_encode()
        self.terms = found.dictionary
        at = found.indices.to_numpy().astype(np.int64) * max(1, len(self.groups)) + np.concatenate([*code, np.zeros(0, np.int64)])
        order = np.argsort(at, kind="stable")
        self.at, self.values = at[order], np.concatenate([*values, np.zeros((0, 2))])[order]

    def products(self, postings: list[bytes]) -> list[pa.Array]:
        """Per group of the postings with a known term: its key columns, sum of n idf weight and of (n idf)^2."""
        named, terms, sizes, g, n = zip(*map(unpacked, postings))
        count = np.array([len(x[0]) for x in named])
        columns = [pa.chunked_array(c).combine_chunks() for c in zip(*named)]
        number, first = group_codes(columns[:-1])
        known = np.array([-1 if None in t else self.groups.get(t, -1) for t in
                          zip(*[c.take(pa.array(first)).to_pylist() for c in columns[:-1]])], np.int64)[number]
        term = pc.index_in(pa.chunked_array(terms).combine_chunks(), self.terms).fill_null(-1).to_numpy().astype(np.int64)
        term = np.repeat(term, np.concatenate(sizes))
        doc = np.concatenate([x + at for x, at in zip(g, np.cumsum(count) - count)])
        rows = np.flatnonzero((term >= 0) & (known[doc] >= 0))
        want = term[rows] * max(1, len(self.groups)) + known[doc[rows]]
        place = np.minimum(np.searchsorted(self.at, want), max(0, len(self.at) - 1))
        hit = self.at[place] == want if len(self.at) else np.zeros(0, bool)
        rows, place = rows[hit], place[hit]
        weight, idf = self.values[place].T
        x, doc = np.concatenate(n)[rows] * idf, doc[rows]
        kept = np.unique(doc)
        dot, square = (np.bincount(doc, v, count.sum())[kept] for v in (x * weight, x * x))
        return [*[c.take(pa.array(kept)) for c in columns], pa.array(dot), pa.array(square)]


def weighted_products(packed: DataFrame, keys: list[T.StructField]) -> DataFrame:
    """``(keys..., dot, square)``: parts of every document's products with its topic's weights, one per bucket that it has terms of.

    ``packed`` is ``(bucket, kind, payload)``, whole buckets per partition,
    sorted by both: a bucket's vocabulary (kind 0), then its postings (1).
    A task holds one bucket's vocabulary and ``PENDING`` postings or one payload.
    """
    schema = T.StructType([*keys, T.StructField("dot", T.DoubleType()), T.StructField("square", T.DoubleType())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for _, found in itertools.groupby(rows, key=lambda r: r[0]):
            known, vocabulary, held, size = [], None, [], 0
            for _, kind, payload in itertools.chain(found, [(None, None, None)]):
                if kind == 0:
                    known.append(payload)
                    continue
                if payload is not None:
                    held.append(payload)
                    size += int.from_bytes(payload[:8], "little")
                if held and (payload is None or size >= PENDING * POSTING):
                    vocabulary = vocabulary or Vocabulary(known)
                    known.clear()
                    yield pa.RecordBatch.from_arrays(vocabulary.products(held), schema.names)
                    held, size = [], 0

    return packed.mapInArrow(multiply, schema)


class Best:
    """The ``k`` highest scores seen of every group; ``admit`` says which rows may still be among them."""

    def __init__(self, k: int, margin: float):
        self.k, self.margin, self.number, self.best = k, margin, {}, np.empty((0, k))

    def numbers(self, columns: list[pa.Array]) -> np.ndarray:
        """Lasting numbers of the groups of a batch's rows."""
        code, first = group_codes(columns)
        values = zip(*[c.take(pa.array(first)).to_pylist() for c in columns])
        own = np.array([self.number.setdefault(v, len(self.number)) for v in values], np.int64)
        return own[code]

    def admit(self, group: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Rows not below the k-th best score of their group so far (ties and no numbers stay)."""
        if len(group) and (new := group.max() + 1 - len(self.best)) > 0:
            self.best = np.vstack([self.best, np.full((max(new, len(self.best)), self.k), -np.inf)])
        rows = np.flatnonzero(~(score < self.best[group, -1] - self.margin))
        rows = rows[np.lexsort((-score[rows], group[rows]))]
        g, s = group[rows], score[rows]
        begins = np.flatnonzero(np.diff(g, prepend=-1))
        for a, b in zip(begins, [*begins[1:], len(g)]):
            top = s[a:min(b, a + self.k)]
            both = np.concatenate([self.best[g[a]], top[~np.isnan(top)]])
            self.best[g[a]] = -np.sort(-both)[:self.k]
        return np.sort(rows[~(s < self.best[g, -1] - self.margin)])


def folded_best(df: DataFrame, group: list[str], k: int, margin: float) -> DataFrame:
    """``(group..., term, bin, y)`` of ``(group..., term, g, w, link)``: the tuned values that may be among the ``k`` best.

    ``w`` and ``link`` hold one entry per time bin. Where ``link`` is 0 the
    group has no bin; elsewhere y is the mean of ``g`` and e, and e is ``w``
    or, where ``link`` is 2, the mean of ``w`` and the y of the bin before.
    """
    schema = T.StructType([*[df.schema[c] for c in [*group, "term"]], T.StructField("bin", T.IntegerType()),
                           T.StructField("y", T.DoubleType())])
    names, shown = schema.names, [df.columns.index(c) for c in [*group, "term"]]
    g_at, w_at, link_at = (df.columns.index(c) for c in ("g", "w", "link"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, margin)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(g_at).to_numpy(zero_copy_only=False)
            w = batch.column(w_at).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            link = batch.column(link_at).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            own = best.numbers([batch.column(i) for i in shown[:-1]])
            last = np.zeros(n)
            rows, bins, values = [], [], []
            for b in range(w.shape[1]):
                y = (np.where(link[:, b] == 2, (w[:, b] + last) / 2, w[:, b]) + g) / 2
                has = np.flatnonzero(link[:, b])
                last = np.where(link[:, b] > 0, y, last)
                ok = has[best.admit(own[has] * w.shape[1] + b, y[has])]
                rows.append(ok)
                bins.append(np.full(len(ok), b, np.int32))
                values.append(y[ok])
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in shown],
                                              pa.array(np.concatenate(bins)), pa.array(np.concatenate(values))], names)

    return df.mapInArrow(fold, schema)
