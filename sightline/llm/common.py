"""Shared folders and text buffers for the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session (as in tests) gets a temporary one; a cluster
    has no folder that could stand in for it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: cuts lineage, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """A 64-bit hash of the columns, never null; nulls count as values of their own."""
    return F.xxhash64(*[c for name in columns for c in (F.col(name).isNull(), F.col(name))])


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Gives freed memory back to the system, so that a Python worker, which lives for many tasks, holds what one batch needs."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row, so that temporary arrays stay small."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between [\\x20\\x09-\\x0D] of each row: (starts, ends, 64-bit hashes, row of each word).

    A word's hash is a polynomial of its bytes, mixed; fold lower-cases A-Z first. Words never cross rows.
    """
    if len(data) == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64), empty
    inside = ~SPACE[data]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    rows_at = offsets[:-1][offsets[:-1] < len(data)]
    starts_here[rows_at] = inside[rows_at]
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:]
    row_ends = offsets[1:][(offsets[1:] > 0)] - 1
    ends_here[row_ends] = inside[row_ends]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return starts, ends, span_hashes(data, starts, ends, fold), np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each byte span: its polynomial, from prefix sums, mixed."""
    values = data.astype(np.uint64)
    if fold:
        values += ((data >= 65) & (data <= 90)).astype(np.uint64) << np.uint64(5)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((values + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * MIX2)


_POWERS: dict[str, np.ndarray] = {}
BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse modulo 2**64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries, by doubling; entry i covers [i, i + size)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    done, out, block, block_size, left = 0, None, hashes, 1, size
    while left:
        if left & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else mix64(out * np.uint64(BASE) + part)
            done += block_size
        left >>= 1
        if left:
            m = len(block) - block_size
            block = mix64(block[:m] * MIX1 + block[block_size : block_size + m])
            block_size *= 2
    return out


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over each row's range."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def same_in_row(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, later): entries whose key is found again in their row, and those after the first of them."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    k, r = keys[order], rows[order]
    after = np.zeros(len(keys), dtype=bool)
    after[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    again = after.copy()
    again[:-1] |= after[1:]
    repeated, later = np.zeros_like(after), np.zeros_like(after)
    repeated[order], later[order] = again, after
    return repeated, later
