"""Vector codes by product quantisation in exact integer arithmetic.

Components become integers ``floor(SCALE * x)``; a vector is cut into equal
consecutive parts, and every part is coded by its nearest entry of its position's
codebook.  The codebooks start as the parts of the vectors with the smallest ids
and are refined by rounds of assignment and floored means.

Limb-split exact GEMM: squared distances need the products of parts and
entries.  Both are broken into limbs narrow enough that every float64 BLAS
product stays below 2^53, so it is an exact integer; the products of the limbs
are recombined in int64, and the first argmin takes the lowest index of a tie.

Scale: every round is one pass whose tasks send a sum and a count per entry
(``PARTS`` x ``ENTRIES`` rows); the driver holds the codebooks only.  Sums per label
are partial aggregates, and hot labels are joined by broadcast (``join_hot``).

Defined results: rows whose vector is null, empty or holds null or non-finite
components are dropped, and so are rows with a component of
2^29 / ``SCALE`` or more (their squared distances do not fit a long) or with another
dimension than the kept row of the smallest id.  Null ids rank last; rows with
equal ids rank by their components.  Fewer rows than ``ENTRIES`` give as many
entries, no rows give no result and empty codebooks.  Labels are compared
null-safe; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.llm.common import col, join_hot, stage

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
TOP_BITS = 29             # components stay below 2^29, squared distances of a part below 2^63
BLOCK = 2048              # vectors of a kernel call


def _limbs(x: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    """``n`` float64 limbs, lowest first: ``x = sum(limb[k] << bits k)``; the last one is signed."""
    out = []
    for _ in range(n - 1):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of stacked int64 matrices, exact where the result fits an int64."""
    inner = a.shape[-1]
    bits = (53 - (inner - 1).bit_length()) // 2
    need = [max(1, -(-(int(max(x.max(initial=0), -x.min(initial=0))).bit_length()) // bits)) for x in (a, b)]
    out = np.zeros((*a.shape[:-1], b.shape[-1]), np.int64)
    right = _limbs(b, bits, need[1])
    for i, x in enumerate(_limbs(a, bits, need[0])):
        for j, y in enumerate(right):
            out += np.matmul(x, y).astype(np.int64) << bits * (i + j)
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of every part's nearest entry: ``(parts, rows)`` each.

    ``x``: (parts, rows, width), ``books``: (parts, entries, width)."""
    far = (books * books).sum(axis=2)[:, None, :] - 2 * exact_products(x, books.transpose(0, 2, 1))
    at = far.argmin(axis=2)
    return at, np.take_along_axis(far, at[:, :, None], 2)[:, :, 0] + (x * x).sum(axis=2)


def _blocks(column: pa.Array, dim: int, parts: int) -> Iterator[np.ndarray]:
    for lo in range(0, len(column), BLOCK):
        flat = pc.list_flatten(column.slice(lo, BLOCK)).to_numpy()
        yield np.floor(flat.astype(np.float64) * SCALE).astype(np.int64).reshape(-1, parts, dim // parts).transpose(1, 0, 2)


def _summer(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for x in _blocks(batch.column(0), parts * width, parts):
                at = nearest(x, books)[0]
                for p in range(parts):
                    n[p] += np.bincount(at[p], minlength=entries)
                    np.add.at(sums[p], at[p], x[p])
        slot = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.ravel()[slot]), pa.array(list(sums.reshape(-1, width)[slot]), pa.list_(pa.int64()))],
                                         ["slot", "n", "sums"])
    return run


def _coder(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [nearest(x, books) for x in _blocks(batch.column(2), parts * width, parts)]
            if got:
                at, far = (np.concatenate([g[k] for g in got], axis=1) for k in (0, 1))
                codes = pa.FixedSizeListArray.from_arrays(pa.array(at.T.ravel()), parts).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(far.sum(axis=0))],
                                                 ["vec_id", "label", "codes", "error"])
    return run


def usable(vector: Column) -> Column:
    """Whether a vector can be coded (see the module's docstring)."""
    top = float(1 << TOP_BITS) / SCALE
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= top))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def code_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(rows, codebooks)``: per kept vector ``vec_id, label, codes`` (array<long>, part order), ``error`` (squared
    distances summed over the parts) and ``label_error`` (summed over equal labels); codebooks by part, entry, component."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(col(vector))).select(col(vec_id).cast("long").alias("vec_id"), col(label).alias("label"),
                                                     col(vector).alias("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    shape = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, codes array<bigint>, error long"
    if not first:
        return spark.createDataFrame([], shape + ", label_error long"), np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0].vector)
    if dim % parts:
        raise ValueError(f"a vector of {dim} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("vector") == dim)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    ints = np.floor(np.array([r.vector for r in seeds], np.float64) * SCALE).astype(np.int64)
    books = np.ascontiguousarray(ints.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        per_slot = (rows.select("vector").mapInArrow(_summer(books), "slot long, n long, sums array<bigint>")
                    .groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dim // parts))))
        books = books.copy()
        for r in per_slot.collect():                                   # at most parts x entries rows
            books[divmod(r.slot, len(seeds))] = [r[f"s{k}"] // r.n for k in range(dim // parts)]
    coded = stage(rows.select("vec_id", "label", "vector").mapInArrow(_coder(books), shape), "codes")
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "code-labels")
    return join_hot(coded, sums, ["label"], "n", coded.count()), books
