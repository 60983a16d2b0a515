"""Benchmark decontamination by the q-gram lemma.

Each benchmark item is cut into overlapping segments: of ``length`` characters at half that stride, which take the most edits, and of
half the length at a stride of a tenth, so that a copied part of six tenths of ``length`` holds a whole segment wherever it begins. A segment of m characters that occurs in a document with at most e
edits shares at least m + 1 - q - q * e q-grams with it, all of them on diagonals (place in the document minus place in the
segment) at most e apart. Hits are counted in bands of diagonals that are 2 * (e + 1) wide and start every e + 1, so that one band holds them all. Bands that
reach the bound are retained, and a banded alignment decides.

Texts are compared in code points, with case folded in all scripts (a sharp s is ss) and runs of white space as one space. The benchmark is the query
set: it goes to the tasks in blocks of at most ``block_chars`` characters, one pass over the documents for each block. Only one block
is on the driver, or broadcast, at a time, however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import _powers, fresh, materialize, row_key, slices, text_buffers

FIELDS = "doc_id long, item_id long, start long, stop long, edits int"
BITS = 22
PAIRS = 512


class Segments:
    """The segments of a block of benchmark items and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str | None]], q: int, length: int, error: float):
        self.q = q
        chars, self.item, self.short, at, size, grams, place = [], [], [], [], [], [], []
        total = 0
        for item, text in items:
            x = normalize(np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32))[0]
            x = x[1:] if len(x) and x[0] == 32 else x
            x = x[:-1] if len(x) and x[-1] == 32 else x
            if len(x) < q:
                self.short += [(item, x)] if len(x) else []
                continue
            hashes = gram_hashes(x, q)
            for m, step in ((length, length // 2), (length // 2, length // 10)):
                if m < length and not q <= m < len(x):
                    continue
                m = min(m, len(x))
                starts = np.unique(np.append(np.arange(0, len(x) - m + 1, max(step, 1)), len(x) - m))
                inside = np.arange(m + 1 - q)
                grams.append(hashes[starts[:, None] + inside].ravel())
                place.append(np.tile(inside, len(starts)).astype(np.int32))
                at.append(total + starts)
                size += [m] * len(starts)
                self.item += [item] * len(starts)
            chars.append(x)
            total += len(x)
        # items below q characters, by length: distinct hashes, and the items of each
        self.short_hashes: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in {len(x) for _, x in self.short}:
            by: dict[int, list[int]] = {}
            for item, x in self.short:
                if len(x) == n:
                    by.setdefault(int(gram_hashes(x, n)[0]), []).append(item)
            keys = sorted(by)
            self.short_hashes[n] = np.array(keys, dtype=np.uint64), [by[k] for k in keys]
        self.chars = np.concatenate(chars) if chars else np.zeros(0, dtype=np.uint32)
        self.at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
        self.size = np.array(size, dtype=np.int64)
        self.edits = np.minimum((error * self.size).astype(np.int64), (self.size - q) // q)
        self.need = self.size + 1 - q - q * self.edits
        hashes = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        place = np.concatenate(place) if place else np.zeros(0, dtype=np.int32)
        segment = np.repeat(np.arange(len(size), dtype=np.int32), self.size + 1 - q)
        order = np.argsort(hashes, kind="stable")
        self.place, self.segment = place[order], segment[order]
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << BITS, dtype=bool)
        self.seen[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def text(self, segment: int) -> np.ndarray:
        return self.chars[self.at[segment] : self.at[segment] + self.size[segment]]


def _folds() -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """(first code point of each one's case folding, number of code points, those of the foldings of several)."""
    fold, width, long = np.arange(0x110000, dtype=np.uint32), np.ones(0x110000, dtype=np.uint8), {}
    for c in range(0x20000):  # no case above
        to = [ord(d) for d in chr(c).casefold()]
        fold[c], width[c] = to[0], len(to)
        if len(to) > 1:
            long[c] = to
    fold[9:14] = 32
    return fold, width, long


_FOLD, _WIDTH, _LONG = _folds()


def normalize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points with case folded and single spaces, place of each in x)."""
    width, y, place = _WIDTH[x], _FOLD[x], np.arange(len(x))
    if len(x) and width.max() > 1:
        place, first = np.repeat(place, width), np.cumsum(width, dtype=np.int64) - width
        y = np.repeat(y, width)
        for c in np.unique(x[width > 1]).tolist():
            for k, d in enumerate(_LONG[c]):
                y[first[x == c] + k] = d
    keep = np.ones(len(y), dtype=bool)
    keep[1:] = (y[1:] != 32) | (y[:-1] != 32)
    return y[keep], place[keep]


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], out=sums[1:])
    h = (sums[q:] - sums[:-q]) * inverse[:n]
    return h ^ (h << np.uint64(31))


def band_align(segment: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the best occurrence of ``segment`` in ``region`` with at most ``most`` edits, else None.

    Free ends in the region, which is the band: it is as long as the segment and its edits. A cell holds its edits and, in the low
    bits, where its path began, so that of equal ones the first wins; a row is one vector, and gaps run along it as a running minimum.
    """
    m, n = len(segment), len(region)
    text = region.astype("<u4").tobytes().find(segment.astype("<u4").tobytes())
    if text >= 0 and text % 4 == 0:
        return 0, text // 4, text // 4 + m
    if n - m + most < 0:
        return None
    edit, place = np.int64(1 << 32), np.arange(n + 1)
    gaps, row = place * edit, place.copy()
    for c in segment:
        new = row + edit
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(region != c, edit, 0))
        row = np.minimum.accumulate(new - gaps) + gaps
        if row.min() >> 32 > most:
            return None
    stop = int(np.argmin(row >> 32))
    return int(row[stop] >> 32), int(row[stop] & 0xFFFFFFFF), stop


def may_occur(s: Segments, x: np.ndarray, segment: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each segment occurs in x[begin:end] with at most its edits: bit-parallel edit distances (Myers) of many pairs at
    once. Segments of more than 64 characters do not fit a word and pass; their alignment decides."""
    out = s.size[segment] > 64
    todo, one = np.flatnonzero(~out), np.uint64(1)
    for k in range(0, len(todo), PAIRS):
        part = todo[k : k + PAIRS]
        m, width = s.size[segment[part]], max(int((end - begin)[part].max()), 1)
        bit, column = np.arange(64), np.arange(width)
        at = np.minimum(s.at[segment[part]][:, None] + bit, len(s.chars) - 1)
        pattern = np.where(bit < m[:, None], s.chars[at], np.uint32(0xFFFFFFFF))
        at = np.minimum(begin[part][:, None] + column, len(x) - 1)
        region = np.where(begin[part][:, None] + column < end[part][:, None], x[at], np.uint32(0xFFFFFFFE))
        equal = np.packbits(region[:, :, None] == pattern[:, None, :], axis=2, bitorder="little").view("<u8")[:, :, 0].T.copy()
        plus, minus, top = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), dtype=np.uint64), (m - 1).astype(np.uint64)
        score, best = m.copy(), m.copy()
        for eq in equal:
            down = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up, fall = minus | ~(across | plus), plus & across
            score += ((up >> top) & one).astype(np.int64) - ((fall >> top) & one).astype(np.int64)
            np.minimum(best, score, out=best)
            up, fall = up << one, fall << one
            plus, minus = fall | ~(down | up), up & down
        out[part] = best <= s.edits[segment[part]]
    return out


def find_hits(x: np.ndarray, row: np.ndarray, bounds: np.ndarray, s: Segments) -> list[tuple[int, int, int, int, int]]:
    """(row, segment, start, stop, edits) in a slice of normalized texts; ``bounds`` has each row's range."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    h = gram_hashes(x, s.q)
    at = np.flatnonzero(s.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    at = at[row[at] == row[at + s.q - 1]]
    k = np.minimum(np.searchsorted(s.hashes, h[at]), max(len(s.hashes) - 1, 0))
    ok = s.hashes[k] == h[at] if len(s.hashes) else np.zeros(len(at), dtype=bool)
    at, k = at[ok], k[ok]
    n = s.count[k]
    post = np.repeat(s.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(k) else np.zeros(0, dtype=np.int64)
    at = np.repeat(at, n)
    segment = s.segment[post].astype(np.int64)
    diagonal = at - s.place[post] + len(x)  # not below 0
    width = s.edits[segment] + 1
    band = diagonal // width
    stride = np.int64(3 * len(x) + 8)
    for shift in (0, 1):  # a band begins at each multiple of width and is two of them wide
        key = (row[at] * np.int64(len(s.item)) + segment) * stride + np.maximum(band - shift, 0)
        key.sort()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(edge, len(key)))
        if shift == 0:
            keys, sizes = key[edge], size
        else:
            keys, sizes = np.concatenate((keys, key[edge])), np.concatenate((sizes, size))
    keys, inverse = np.unique(keys, return_inverse=True)
    sizes = np.bincount(inverse, weights=sizes, minlength=len(keys)).astype(np.int64)
    which = (keys // stride) % max(len(s.item), 1)
    good = sizes >= s.need[which] if len(keys) else np.zeros(0, dtype=bool)
    which, keys = which[good], keys[good]
    rows, e, m = keys // stride // max(len(s.item), 1), s.edits[which], s.size[which]
    low = (keys % stride) * (e + 1) - len(x)
    begin, end = np.maximum(bounds[rows], low - e), np.minimum(bounds[rows + 1], low + 2 * (e + 1) + m + e)
    for k in np.flatnonzero(may_occur(s, x, which, begin, end)).tolist():
        r, seg, a = int(rows[k]), int(which[k]), int(begin[k])
        if found.get((r, seg), (1,))[0] == 0:
            continue
        hit = band_align(s.text(seg), x[a : end[k]], int(e[k]))
        if hit and (old := found.get((r, seg))) is None or hit and hit[0] < old[0]:
            found[r, seg] = (hit[0], a + hit[1], a + hit[2])
    return [(r, seg, a, z, e) for (r, seg), (e, a, z) in found.items()]


def short_hits(x: np.ndarray, row: np.ndarray, s: Segments) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, stop, 0): where items below q characters occur first in each row."""
    out = []
    for n, (hashes, items) in s.short_hashes.items():
        h = gram_hashes(x, n)
        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        at = np.flatnonzero(hashes[k] == h)
        at = at[row[at] == row[at + n - 1]]
        _, first = np.unique(row[at] * np.int64(len(hashes)) + k[at], return_index=True)
        out += [(int(row[p]), item, int(p), int(p) + n, 0) for p in at[first] for item in items[k[p]]]
    return out


def _matcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Segments = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids, out = batch.column(0).to_pylist(), []
            for a, b in slices(offsets):
                texts = [bytes(data[offsets[i] : offsets[i + 1]]).decode().encode("utf-32-le") for i in range(a, b)]
                ends = np.cumsum([0] + [len(t) // 4 for t in texts])
                raw = np.frombuffer(b"".join(texts), dtype=np.uint32)
                row = np.repeat(np.arange(b - a), np.diff(ends))
                x, place = normalize(raw)
                row = row[place]
                bounds = np.searchsorted(place, ends)
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                hits = [(r, s.item[seg], p, z, e) for r, seg, p, z, e in find_hits(x, row, bounds, s)] if s.item else []
                for r, item, p, z, e in hits + short_hits(x, row, s):
                    old = best.get((r, item))
                    best[r, item] = (p, z, e) if old is None else (min(p, old[0]), max(z, old[1]), min(e, old[2]))
                for (r, item), (p, z, e) in best.items():
                    start = int(place[p] - ends[r])
                    out.append((ids[a + r], item, start, int(place[z - 1] - ends[r]) + 1 if z > p else start, int(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "start", "stop", "edits"])

    return run


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = 12, length: int = 100, error: float = 0.06, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and item of which a segment occurs in it: doc_id, item_id, start, stop (code points of the text,
    from the first to the last matching segment), edits (of the best one).

    ``error`` is the share of edits, lowered where a segment is too short for the lemma. Any excerpt of 59 characters of an item (at
    the default length) is found, with edits if at most 3 of them lie in each 50 characters. Items below q characters need
    exact occurrence, and empty or null ones match nothing. Null and empty texts have no leaks; long ones are read whole, in
    slices; repeated rows and repeated items give repeated rows; ties take the first place; empty tables give none; other columns are
    ignored. With more than one block, each pass is written before the next block is read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    context, done, last = docs.sparkSession.sparkContext, [], None
    for block in _blocks(benchmark, block_chars):
        if last is not None:
            done.append(materialize(rows.mapInArrow(_matcher(last), FIELDS), "leaks"))
            last.destroy()
        last = context.broadcast(Segments(block, q, length, error))
    return reduce(DataFrame.unionByName, [*done, rows.mapInArrow(_matcher(last), FIELDS)])


def clean(docs: DataFrame, benchmark: DataFrame, by_row: bool = False, **options) -> DataFrame:
    """``docs`` without the documents that have a leak (all rows of a leaking doc_id go; a null doc_id stays).

    With ``by_row``, each row is judged by its own text, whatever its doc_id is.
    """
    if by_row:
        own = fresh(docs.columns, "row")
        keyed = docs.withColumn(own, row_key("doc_id", "text"))
        found = leaks(keyed.select(F.col(own).alias("doc_id"), "text"), benchmark, **options)
        return keyed.join(found.select(F.col("doc_id").alias(own)).distinct(), own, "left_anti").select(docs.columns)
    return docs.join(leaks(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
