"""Exact deduplication of word windows with compressed FM-indexes.

Every window of ``WINDOW`` words that a document shares with another holds one of their common anchors (see ``anchors``). The words
around repeated anchors are dealt to shards by anchor, so that all copies of a window meet in one shard. A shard indexes its
distinct passages: suffix order, Burrows-Wheeler transform, and a wavelet matrix of packed bits with rank blocks. The passages of the
documents then stream against the index: backward search takes one word more at each step and keeps, as matching
statistics, the interval of suffixes that begin with the words read so far, up to WINDOW of them. Where WINDOW words match, the interval
names all passages with that window, and the least document among them decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.anchors import SPANS, by_bucket, covered, extents, groups_of, keyed, once_each, pack, precedence, repeated_anchors, shuffled, span_batch, span_lists, unpack, with_spans
from sightline.llm.common import slices, text_buffers, window_hashes, words_of

WINDOW = 50
K = 10
LEFT = WINDOW - K
BUCKET_BYTES = 8_000_000
SLICE = 4 << 20


def word_units(data: np.ndarray, offsets: np.ndarray):
    """Hashes of all K-word strings, for ``anchors``."""
    _, _, hashes, row = words_of(data, offsets)
    size = np.bincount(row, minlength=len(offsets) - 1)
    h = window_hashes(hashes, K)
    n = len(h)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return h, empty, empty, size
    h[row[:n] != row[K - 1 :]] = np.uint64((1 << 64) - 1)
    first = np.concatenate(([0], np.cumsum(size)))
    return h, row[:n], np.arange(n) - first[row[:n]], size


def _passages(shards: int):
    """(key, tag, text, places) -> passages for the shards (way 0) and spans that are already sure (way 1).

    A passage is the windows that have their anchor at one place: up to LEFT words before it and WINDOW from it on. Of equal passages in a batch only that of the least key is
    sent; all windows of the others repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            ends = batch.column(3).offsets.to_numpy()
            spots = batch.column(3).values.to_numpy(zero_copy_only=False)
            single = once_each(tags)
            out: list[tuple[int, int, bytes]] = []
            for a, b in slices(offsets, SLICE):
                seen: dict[tuple[bytes, int], list] = {}
                sure: list[tuple[int, int, int]] = []
                base = offsets[a]
                h, _, _, sizes = word_units(data[base : offsets[b]], offsets[a : b + 1] - base)
                first = np.concatenate(([0], np.cumsum(sizes)))
                for r in np.flatnonzero(single[a:b]) + a:
                    words = data[offsets[r] : offsets[r + 1]].tobytes().split()
                    key, tag = int(keys[r]), int(tags[r])
                    places = np.unique(spots[ends[r] : ends[r + 1]]).astype(np.int64)
                    places = places[places + K <= len(words)]  # rows with one rid share their places
                    left, right = extents(h[first[r - a] : first[r - a + 1]], places, LEFT + 1)
                    for at, x, y in zip(places.tolist(), left.tolist(), right.tolist(), strict=True):
                        begin, end = max(0, at - x), min(len(words), at + K + y)
                        if end - begin < WINDOW:
                            continue
                        name = (b" ".join(words[begin:end]), at - begin)
                        old = seen.get(name)
                        if old is None:
                            seen[name] = [key, end - begin, [(tag, begin)]]
                        elif key == old[0]:
                            old[2].append((tag, begin))
                        elif key > old[0]:
                            sure.append((tag, begin, end))
                        else:
                            sure += [(t, c, c + old[1]) for t, c in old[2]]
                            seen[name] = [key, end - begin, [(tag, begin)]]
                by: dict[int, list] = {}
                for (text, lead), (key, n, where) in seen.items():
                    anchor = b" ".join(text.split(b" ", lead + K)[lead : lead + K])
                    shard = int.from_bytes(hashlib.blake2b(anchor, digest_size=8).digest(), "little") % shards
                    by.setdefault(shard, []).append((text, lead, key, n, where))
                for shard, rows in by.items():
                    rows.sort()
                    joined = np.frombuffer(b"\n".join(x[0] for x in rows), dtype=np.uint8)
                    numbers = [np.array([x[k] for x in rows], dtype=np.int64) for k in (1, 2, 3)]
                    where = [w for x in rows for w in x[4]]
                    out.append((shard, 0, pack(joined, *numbers, np.array([len(x[4]) for x in rows]), np.array([w[0] for w in where]), np.array([w[1] for w in where]))))
                if sure:
                    out.append((sure[0][0] % shards, 1, pack(*(np.array([x[k] for x in sure], dtype=np.int64) for k in range(3)))))
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "way", "blob"])

    return run


class WaveletMatrix:
    """Rank over a sequence of symbols: one plane of packed bits per symbol bit, with a running count for each 64 of them."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.planes = len(symbols), []
        for bit in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.uint32)
            self.planes.append((bit, words, counts, self.n - int(ones.sum())))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, stop = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for bit, words, counts, zeros in self.planes:
            one = (symbol >> bit & 1).astype(bool)
            for edge in (start, stop):
                ones = counts[edge >> 6] + np.bitwise_count(words[edge >> 6] & ((np.uint64(1) << (edge & 63).astype(np.uint64)) - np.uint64(1)))
                edge[:] = np.where(one, zeros + ones, edge - ones)
        return stop - start


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in full order, rank of each by its first ``depth`` symbols), by doubling."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    size, half, by_depth = 1, 1 << (depth.bit_length() - 1), None

    def paired(rank: np.ndarray, ahead: int) -> np.ndarray:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - ahead)] = rank[ahead:] + 1
        return np.unique(rank * np.int64(n + 2) + after, return_inverse=True)[1]

    while True:
        if size == half:
            by_depth = paired(rank, depth - half) if depth > half else rank
        if size >= half and int(rank.max()) == n - 1:
            return np.argsort(rank), by_depth
        rank, size = paired(rank, size), 2 * size


class FMIndex:
    """Index of passages (arrays of symbols from 1 on), each closed by a 0, with the document of each passage.

    Queries never hold a 0, so no search runs from one passage into the next.
    """

    def __init__(self, passages: list[np.ndarray], documents: np.ndarray):
        text = np.concatenate([np.append(p, 0) for p in passages])
        owner = np.repeat(documents, [len(p) + 1 for p in passages])
        order, by_window = suffix_order(text, WINDOW)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1])
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        # stretches of suffixes that share WINDOW symbols, and the least document in each
        stretch = by_window[order]
        first = groups_of(stretch)
        self.first = np.append(first, self.n)
        self.stretch = np.cumsum(np.concatenate(([0], stretch[1:] != stretch[:-1])))
        self.least = np.minimum.reduceat(owner[order], first)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of suffixes that begin with ``symbol`` and go on as those in [low, high)."""
        start = self.before[symbol]
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return start + both[: len(low)], start + both[len(low) :]

    def earliest(self, passages: list[np.ndarray]) -> list[np.ndarray]:
        """For each passage that is in the index and each of its windows: the least document that holds the window."""
        sizes = np.array([len(p) for p in passages])
        width = int(sizes.max())
        ends = np.zeros((len(passages), width), dtype=np.int64)  # right-aligned
        for row, p in zip(ends, passages, strict=True):
            row[width - len(p) :] = p
        out = np.full((len(passages), width), -1, dtype=np.int64)
        low, high = np.zeros(len(passages), dtype=np.int64), np.full(len(passages), self.n, dtype=np.int64)
        for read in range(1, width + 1):
            live = np.flatnonzero(sizes >= read)
            low[live], high[live] = self.step(low[live], high[live], ends[live, width - read])
            if read >= WINDOW:  # drop what was matched beyond WINDOW words: the interval widens to its stretch
                stretch = self.stretch[low[live]]
                out[live, width - read] = self.least[stretch]
                low[live], high[live] = self.first[stretch], self.first[stretch + 1]
        return [row[width - n : width - WINDOW + 1] for row, n in zip(out, sizes, strict=True)]


def _search(bits: int):
    return lambda batches: _found(batches, bits)


def _found(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    def spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return span_batch(*(np.array([x[k] for x in rows], dtype=np.int64) for k in range(3)), bits)

    for _, blobs, passing in by_bucket(batches):
        for blob in passing:
            yield spans(list(zip(*(v.tolist() for v in unpack(blob, *[np.int64] * 3)), strict=True)))
        seen: dict[tuple[bytes, int], list] = {}
        sure: list[tuple[int, int, int]] = []
        for blob in blobs:
            joined, leads, keys, sizes, counts, tags, begins = unpack(blob, np.uint8, *[np.int64] * 6)
            where = list(zip(tags.tolist(), begins.tolist(), strict=True))
            at = 0
            for text, lead, key, n, count in zip(joined.tobytes().split(b"\n"), leads.tolist(), keys.tolist(), sizes.tolist(), counts.tolist(), strict=True):
                own = where[at : at + count]
                at += count
                old = seen.get((text, lead))
                if old is None or key < old[0]:
                    if old is not None:
                        sure += [(t, b, b + n) for t, b in old[2]]
                    seen[text, lead] = [key, n, own]
                elif key == old[0]:
                    old[2].extend(own)
                else:
                    sure += [(t, b, b + n) for t, b in own]
        yield spans(sure)
        anchors: dict[bytes, list] = {}
        for (text, lead), (key, _, where) in seen.items():
            anchors.setdefault(b" ".join(text.split(b" ", lead + K)[lead : lead + K]), []).append((text, key, where))
        open_ones = [x for rows in anchors.values() if len(rows) > 1 for x in rows]  # else all copies are alike
        del seen, anchors
        if not open_ones:
            continue
        numbers: dict[bytes, int] = {}
        passages = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in text.split(b" ")], dtype=np.int32) for text, _, _ in open_ones]
        documents = np.array([key for _, key, _ in open_ones], dtype=np.int64)
        found = []
        for least, (_, key, where) in zip(FMIndex(passages, documents).earliest(passages), open_ones, strict=True):
            edge = np.diff(np.concatenate(([0], (least < key).astype(np.int8), [0])))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                found += [(t, begin + a, begin + b - 1 + WINDOW) for t, begin in where]
        yield spans(found)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(2))
        out: list[list] = [[], [], []]
        for k, (starts, stops) in enumerate(span_lists(batch.column(1), batch.column(3))):
            words = data[offsets[k] : offsets[k + 1]].tobytes().split()
            gone = covered(len(words), starts, stops) if len(starts) else np.zeros(len(words), dtype=bool)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(starts) else words
            for column, v in zip(out, (len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(rows: DataFrame, shards: int, bits: int) -> DataFrame:
    """SPANS of words of ``keyed`` rows that windows of documents with smaller keys cover."""
    places = repeated_anchors(rows, word_units, WINDOW, K, shards)
    passages = rows.join(places, "rid").select(precedence(), "tag", "text", "places").mapInArrow(_passages(shards), "bucket int, way int, blob binary")
    return shuffled(passages).mapInArrow(_search(bits), SPANS)


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row.

    A word goes if a window of WINDOW words that covers it also starts in a document with a smaller doc_id. Null and empty
    texts have no words; rows of one doc_id don't cover each other; a null doc_id counts as the largest long; texts of any
    length are read whole, in slices; other columns are ignored; an empty table gives none.
    """
    rows, shards, bits = keyed(docs, bucket_bytes)
    return with_spans(rows, repeated_spans(rows, shards, bits)).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")
