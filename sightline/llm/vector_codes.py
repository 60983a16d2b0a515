"""Vectors as short codes: one codebook for each part of a vector, nearest entries found in integers.

Parts and entries are padded with zeros to a power of two and turned by the Walsh-Hadamard transform, whose matrix has entries of 1 and -1 only
and keeps squared distances up to the factor of its size. Squared differences are added coefficient by coefficient in sequency order (slow
sign changes first); an entry whose partial sum is above the whole sum of a likely entry cannot be nearest and is dropped. Sums that are
left at the end are exact multiples of the size. No step uses floating point after the components are floored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sightline.llm.common import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
STEP = 4  # coefficients between two eliminations
ROWS = 1024  # vectors compared at a time, which bounds the dense step


def sequency(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of ``size`` in order of their sign changes."""
    bits = max(size.bit_length() - 1, 0)
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    out = np.zeros(size, dtype=np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def transform(parts: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, padded with zeros to a power of two, in sequency order."""
    size = 1 << max(parts.shape[1] - 1, 0).bit_length()
    x = np.zeros((len(parts), size), dtype=np.int64)
    x[:, : parts.shape[1]] = parts
    half = 1
    while half < size:
        y = x.reshape(len(parts), size // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(parts), size)
        half *= 2
    return x[:, sequency(size)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, differences squared) of transformed rows: the nearest of the transformed entries, the lower one of equals."""
    size, n = x.shape[1], len(x)
    first = min(STEP, size)
    total = np.zeros((n, len(entries)), dtype=np.int64)
    for k in range(first):
        total += (x[:, k, None] - entries[None, :, k]) ** 2
    work = total.size * first
    likely = total.argmin(axis=1)
    bound = ((x - entries[likely]) ** 2).sum(axis=1)
    rows, which = np.nonzero(total <= bound[:, None])
    sums = total[rows, which]
    for begin in range(first, size, STEP):
        for k in range(begin, min(begin + STEP, size)):
            sums += (x[rows, k] - entries[which, k]) ** 2
            work += len(rows)
        alive = sums <= bound[rows]
        rows, which, sums = rows[alive], which[alive], sums[alive]
    starts = np.searchsorted(rows, np.arange(n))
    least = np.minimum.reduceat(sums, starts) if n else np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(sums == least[rows])
    winners = at[np.searchsorted(rows[at], np.arange(n))]
    return which[winners], least // size, work


@dataclass(frozen=True)
class Codebooks:
    """entries[part] has one row of integers an entry. All parts have as many entries and components."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def limit_of(width: int) -> int:
    """The largest size of a component for which transformed sums fit 64 bits."""
    return 1 << ((61 - 2 * max(width - 1, 0).bit_length()) // 2)


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(table, width): vec_id, label, x (``parts`` times ``width`` little-endian int64: floor(scale * component)) of the vectors that have finite components
    only, written to the shared folder.

    Null vectors and those with a null, NaN or infinite component are dropped. All vectors are as long as the longest, rounded up to whole parts: zeros
    are put behind shorter ones. Components beyond ``limit_of(width)`` after scaling (2**26 for 16 components a part) are set to it, as a long cannot hold their errors.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull() & finite)
    width = -(-(kept.agg(F.max(F.size("embedding"))).first()[0] or 0) // parts)
    most, size = limit_of(width), parts * width

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            values = np.floor(np.clip(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale, -most, most)).astype("<i8")
            x = np.zeros((batch.num_rows, size), dtype="<i8")
            x[np.arange(size)[None, :] < lengths[:, None]] = values
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "label", "x"])

    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, x binary"
    return materialize(kept.mapInArrow(floored, schema), "vectors"), width


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), parts, width)


def _assigned(x: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray]]:
    """(rows, part, entries, distances) of a few rows at a time."""
    for begin in range(0, len(x), ROWS):
        rows = slice(begin, min(begin + ROWS, len(x)))
        for part, entries in enumerate(books):
            yield rows, part, *nearest(transform(x[rows, part]), entries)[:2]


def train(table: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and replacement by floored means.

    They start as the parts of the ``entries`` vectors of least vec_id (nulls last, equal ids by their components); fewer vectors make fewer entries. Each task sends the sums of
    its vectors, at most one number a component of the codebooks; these are summed by Spark and only the codebooks reach the driver.
    """
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([np.frombuffer(r.x, dtype="<i8") for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if not len(first):
        return Codebooks(books)
    shape = (parts, books.shape[1], width + 1)
    for _ in range(rounds):
        turned = [transform(b) for b in books]

        def sums(batches: Iterator[pa.RecordBatch], turned: list[np.ndarray] = turned) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, dtype=np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), parts, width)
                for rows, part, which, _ in _assigned(x, turned):
                    np.add.at(total[part, :, :width], which, x[rows, part])
                    total[part, :, width] += np.bincount(which, minlength=shape[1])
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total.ravel()[place], pa.int64())], names=["place", "value"])

        summed = table.select("x").mapInArrow(sums, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
        total = np.zeros(shape, dtype=object)
        for r in summed.collect():
            total[np.unravel_index(r.place, shape)] = int(r.value)
        used = total[:, :, width] > 0
        books[used] = (total[used][:, :width] // total[used][:, width:]).astype(np.int64)
    return Codebooks(books)


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (sum of the parts' squared distances) of each row of ``integers``."""
    parts, _, width = books.entries.shape
    turned = [transform(b) for b in books.entries]
    label = table.schema["label"].dataType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            which, error = np.zeros((batch.num_rows, parts), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for rows, part, found, distances in _assigned(_matrix(batch.column(2), parts, width), turned):
                which[rows, part] = found
                error[rows] += distances
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in which]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return table.mapInArrow(codes, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error of all kept vectors; the codebooks). ``entries`` is 256 at most.

    ``vectors`` has vec_id, embedding, label; other columns are ignored, repeated rows stay, an empty table gives none. label_error is null where a
    long cannot hold it. Sums by label are written first, so that Spark broadcasts them where their size allows it and else joins by label, splitting hot ones.
    """
    table, width = integers(vectors, parts, scale)
    books = train(table, width, parts, entries, rounds)
    coded = materialize(encode(table, books), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("label_of_sum")).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"))
    sums = materialize(sums.select("label_of_sum", F.expr("try_cast(total as long)").alias("label_error")), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("label_of_sum"))).drop("label_of_sum"), books


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` (with a column code) with vector, array<long>: the entries of each code, one part after the other; a null code has a null vector."""
    parts, _, width = books.entries.shape
    entry = books.entries

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("code")
            rows = [None if c is None else entry[np.arange(parts), list(bytes.fromhex(c))].ravel().tolist() for c in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))], names=[*batch.schema.names, "vector"])

    out = codes.drop("vector")
    return out.mapInArrow(vectors, StructType([*out.schema.fields, StructField("vector", ArrayType(LongType()))]))
