"""Truncated singular value decomposition of a sparse table of rows, by block iteration.

Rows are ``(at array<int>, w array)``: the filled columns of a row,
ascending, and their values. A pass multiplies the table with a block of
``dims + extra`` vectors and its transpose with the result, inside each task,
``PARTIAL_BYTES`` of the result at a time: there are as many partials as
cores, added up slice by slice and deleted before the next ones are made, so
neither the memory of a task nor that of the driver nor the disk depends on
the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import shuffles_released

ENTRIES = 1 << 18               # filled entries looked at at a time
PARTIAL_BYTES = 16 << 20        # of a task's partial result
SLICE_BYTES = 1 << 20           # of a row that partials are added up in
ORTHO_ROWS = 1 << 12            # rows made orthonormal at a time
RANK_CUT = 1e-8                 # singular values below this share of the largest count as zero

Weigh = Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, row numbers, columns, values)`` of a batch's last two columns, ``ENTRIES`` entries or one row at a time."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 2)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + ENTRIES, "right")), at + 1)
        rows = batch.slice(at, to - at)
        flat = [rows.column(i).flatten().to_numpy(zero_copy_only=False) for i in (-2, -1)]
        yield rows, np.repeat(np.arange(to - at), sizes[at:to]), flat[0].astype(np.int64), flat[1].astype(np.float64)
        at = to


def filled(n: int, owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(row, first entry, end)`` of the rows with entries; ``owner`` ascends."""
    ends = np.searchsorted(owner, np.arange(n + 1)).tolist()
    return ((i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a)


def _added(slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Body: sums of the slices of the same place."""
    total: dict[int, np.ndarray] = {}
    for batch in slices:
        for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(part.as_buffer())
            total[i] = total[i] + values if i in total else values.copy()
    for i, values in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([values.tobytes()])], ["i", "part"])


def _some_products(rows: DataFrame, block: np.ndarray, weigh: Weigh | None, out: np.ndarray, some: slice) -> None:
    """Writes the product with some of the block's vectors into the same columns of ``out``."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(np.ascontiguousarray(block[:, some]))
    length = max(1, SLICE_BYTES // 8 // (some.stop - some.start))       # rows of a slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, total = shared.value, None
        for batch in batches:
            for part, owner, columns, values in pieces(batch):
                if weigh is not None:
                    owner, columns, values = weigh(part.num_rows, owner, columns, values)
                for _, a, b in filled(part.num_rows, owner):
                    if total is None:
                        total = np.zeros_like(vectors)
                    at, w = columns[a:b], values[a:b]
                    total[at] += w[:, None] * (w @ vectors[at])     # a row's columns are distinct
        for i in range(0, 0 if total is None else len(total), length):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i:i + length].tobytes()])],
                                             ["i", "part"])

    schema = "i int, part binary"
    try:
        with shuffles_released(rows.sparkSession):
            parts = rows.select("at", "w").coalesce(context.defaultParallelism).mapInArrow(run, schema)
            found = parts.repartition(min(-(-len(block) // length), context.defaultParallelism), "i").mapInArrow(
                _added, schema).collect()                           # the result itself
    finally:
        shared.destroy()
    out[:, some] = 0.0
    for r in found:
        part = np.frombuffer(r["part"]).reshape(-1, some.stop - some.start)
        out[r["i"]:r["i"] + len(part), some] = part


def gram_product(rows: DataFrame, block: np.ndarray, weigh: Weigh | None = None) -> np.ndarray:
    """``A' A block`` of the table A. ``weigh`` turns (rows, row numbers, columns, values) into the last three of A."""
    width = block.shape[1]
    step = min(max(1, width * PARTIAL_BYTES // max(1, block.nbytes)), width)
    step = -(-width // -(-width // step))                               # even steps
    out = np.empty_like(block)
    for at in range(0, width, step):
        _some_products(rows, block, weigh, out, slice(at, min(at + step, width)))
    return out


def orthonormal(block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, in place: QR of pieces, then of their triangles on one another."""
    tall = max(4 * block.shape[1], ORTHO_ROWS)
    spans = [slice(at, at + tall) for at in range(0, len(block), tall)]
    if len(spans) == 1 or len(block) - spans[-1].start < block.shape[1]:
        spans[-2:] = [slice(spans[-2].start if len(spans) > 1 else 0, len(block))]
    triangles = []
    for span in spans:
        block[span], r = np.linalg.qr(block[span])
        triangles.append(r)
    turns, _ = np.linalg.qr(np.vstack(triangles))
    for span, turn in zip(spans, np.split(turns, len(spans))):
        block[span] = block[span] @ turn
    return block


def truncated_svd(rows: DataFrame, size: int, dims: int, extra: int = 16, tolerance: float = 1e-3,
                  max_passes: int = 40, seed: int = 42, weigh: Weigh | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``dims`` largest singular values, descending, and their right vectors (``size x dims``).

    ``size`` bounds the column numbers. Passes end when no value moves by
    more than ``tolerance`` of itself, or after ``max_passes``. Beyond the rank
    of the table values and vectors are zero; an empty table has rank zero.
    """
    width = min(dims + extra, size)
    block = orthonormal(np.random.default_rng(seed).normal(size=(size, width)))
    known = np.zeros(width)
    for left in reversed(range(max_passes)):
        image = gram_product(rows, block, weigh)
        small = block.T @ image
        squares, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = np.sqrt(np.maximum(squares[::-1], 0.0)), turn[:, ::-1]
        settled = (np.abs(values - known)[:dims] <= tolerance * values[:dims] + RANK_CUT * values[0]).all()
        known = values
        if settled or not left:
            best = block @ turn
            break
        block = orthonormal(image)              # the driver holds one block and its product at a time
    real = known > RANK_CUT * max(known[0], 1e-300)
    out_values, out = np.zeros(dims), np.zeros((size, dims))
    n = min(dims, width)
    out_values[:n], out[:, :n] = np.where(real, known, 0.0)[:n], np.where(real, best, 0.0)[:, :n]
    return out_values, out
