"""Exact substring deduplication by a distributed, common-prefix-aware merge sort of suffixes.

Every ``WINDOW``-byte string that a document shares with another holds one of their common anchors (see ``anchors``), so only suffixes
that begin at repeated anchors are sorted. Each carries what may share a window with it: up to WINDOW bytes from the anchor on,
then up to WINDOW - K bytes before the anchor, read backwards. A task sorts its suffixes into a run for each bucket of anchors and sends it
front-coded: how many bytes a suffix shares with the one before, and the rest. A bucket merges its runs with a loser
tree whose players know how much they share with the last winner; they compare bytes only from there on. The merge also
yields the shared lengths of neighbours in the bucket's order, from which the repeated windows are read off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.anchors import SPANS, by_bucket, covered, groups_of, keyed, once_each, pack, precedence, repeated_anchors, shuffled, span_batch, span_lists, unpack, with_spans
from sightline.llm.common import _powers, mix64, release, slices, text_buffers

WINDOW = 50
K = 20
LEFT = WINDOW - K
WIDTH = WINDOW + LEFT
PAD = 0xFF  # in no UTF-8 text
BUCKET_BYTES = 14_000_000
SLICE = 8 << 20
CHUNK = 8192


def byte_units(data: np.ndarray, offsets: np.ndarray):
    """Hashes of all K-byte strings, for ``anchors``."""
    n = len(data) - K + 1
    size = np.diff(offsets)
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), empty, empty, size
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = mix64((sums[K:] - sums[:-K]) * inverse[:n])
    row = np.repeat(np.arange(len(size)), size)
    h[row[:n] != row[K - 1 :]] = np.uint64((1 << 64) - 1)
    return h, row[:n], np.arange(n) - offsets[row[:n]], size


def pieces(data: np.ndarray, at: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """n x WIDTH bytes around the places ``at``: those ``after`` (from the place on), then those ``before``, read backwards."""
    out = np.empty((len(at), WIDTH), dtype=np.uint8)
    for a in range(0, len(at), CHUNK):  # index tables are many times the bytes they fetch
        z = slice(a, a + CHUNK)
        right = at[z, None] + np.arange(WINDOW)
        left = at[z, None] - 1 - np.arange(LEFT)
        out[z, :WINDOW] = np.where(np.arange(WINDOW) < after[z, None], data[np.minimum(right, len(data) - 1)], PAD)
        out[z, WINDOW:] = np.where(np.arange(LEFT) < before[z, None], data[np.maximum(left, 0)], PAD)
    return out


def as_words(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, which sort alike."""
    wide = -x.shape[1] % 8
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, wide)))).view(">u8").astype(np.uint64)


def shared_with_last(x: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before it; 0 for the first."""
    out = np.zeros(len(x), dtype=np.int64)
    if len(x) > 1:
        differ = x[1:] != x[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return out


def whole(tag: np.ndarray, at: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans (tag, start, stop) of pieces of which every window goes; pieces below WINDOW have none."""
    ok = after + before >= WINDOW
    return tag[ok], (at - before)[ok], (at + after)[ok]


def front_code(x: np.ndarray, shared: np.ndarray) -> bytes:
    return x[np.arange(x.shape[1]) >= shared[:, None]].tobytes()


def _runs(buckets: int):
    """(key, tag, text, places) -> sorted, front-coded runs for the buckets (way 0) and spans that are already sure (way 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            spots = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            single = once_each(tags)
            out: list[tuple[int, int, bytes]] = []
            for a, b in slices(offsets, SLICE):
                row = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))
                at = spots[ends[a] : ends[b]] + offsets[row]
                inside = (at + K <= offsets[row + 1]) & single[row]  # rows with one rid share their places
                row, at = row[inside], at[inside]
                if not len(at):
                    continue
                after, before = np.minimum(WINDOW, offsets[row + 1] - at), np.minimum(LEFT, at - offsets[row])
                x = pieces(data, at, after, before)
                words = as_words(x)
                key = keys[row]
                h = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(words[:, 1])
                bucket = (mix64(h ^ (words[:, 2] >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((at, key, *words.T[::-1], bucket))
                x, after, before, row, at, key, bucket = (v[order] for v in (x, after, before, row, at, key, bucket))
                shared = shared_with_last(x)
                first = groups_of(bucket)
                shared[first] = 0
                lead = shared < WIDTH
                group = np.cumsum(lead) - 1
                least = key[lead][group]
                late = key > least
                place = at - offsets[row]
                spans = whole(tags[row[late]], place[late], after[late], before[late])
                out.append((int(a % buckets), 1, pack(*(v.astype(np.int64) for v in spans))))
                keep = ~late
                bounds = np.append(first, len(at))
                for c, d in zip(bounds[:-1], bounds[1:], strict=True):
                    own, k = np.flatnonzero(lead[c:d]) + c, np.flatnonzero(keep[c:d]) + c
                    sizes = np.bincount(group[k] - group[c], minlength=len(own))
                    blob = pack(shared[own].astype(np.uint8), np.frombuffer(front_code(x[own], shared[own]), dtype=np.uint8), after[own].astype(np.uint8), before[own].astype(np.uint8), key[own], sizes.astype(np.int32), tags[row[k]], place[k].astype(np.int32))
                    out.append((int(bucket[c]), 0, blob))
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "way", "blob"])
            release()

    return run


def decode_run(shared: np.ndarray, rest: np.ndarray) -> list[bytes]:
    out, last, at, data = [], b"", 0, rest.tobytes()
    for n in shared.tolist():
        end = at + WIDTH - n
        last = last[:n] + data[at:end]
        out.append(last)
        at = end
    return out


def first_difference(x: bytes, y: bytes, start: int) -> int:
    """Where x and y first differ from ``start`` on; their length if they don't."""
    differ = int.from_bytes(x[start:], "big") ^ int.from_bytes(y[start:], "big")
    return len(x) - (differ.bit_length() + 7) // 8


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser tree over front-coded runs: ((run, place in run) in sorted order, length shared with the one before).

    Each player knows how much its head shares with the last winner. The one that shares more comes first; only
    between equals are bytes compared, and only beyond what they are known to share.
    """
    n = len(runs)
    width = 1 << max(0, (n - 1).bit_length())
    head, known = [0] * n, [0] * n
    losers = [-1] * width

    def play(p: int, q: int) -> tuple[int, int]:
        """(winner, loser); updates what the loser shares with the winner."""
        if p < 0 or q < 0:
            return (p, q) if q < 0 else (q, p)
        if known[p] != known[q]:
            return (p, q) if known[p] > known[q] else (q, p)
        x, y = runs[p][head[p]], runs[q][head[q]]
        at = first_difference(x, y, known[p])
        if at == WIDTH or x[at] < y[at]:
            known[q] = at
            return p, q
        known[p] = at
        return q, p

    players = [k if k < n and runs[k] else -1 for k in range(width)]
    node = width
    level = players
    while len(level) > 1:
        node //= 2
        winners = []
        for k in range(0, len(level), 2):
            w, losers[node + k // 2] = play(level[k], level[k + 1])
            winners.append(w)
        level = winners
    order, common = [], []
    champion = level[0]
    while champion >= 0:
        order.append((champion, head[champion]))
        common.append(known[champion])
        head[champion] += 1
        player = champion
        if head[champion] < len(runs[champion]):
            known[champion] = shared[champion][head[champion]]
        else:
            player = -1
        at = (champion + width) // 2
        while at:
            player, losers[at] = play(player, losers[at])
            at //= 2
        champion = player
    return order, common


def repeated_windows(x: np.ndarray, shared: np.ndarray, after: np.ndarray, before: np.ndarray, key: np.ndarray) -> np.ndarray:
    """n x (LEFT + 1): whether the window that begins o bytes before the anchor is also in a piece with a smaller key.

    Two pieces hold the same window if they share WINDOW - o bytes from the anchor on and o bytes before it: both are
    stretches in a sorted order that the shared lengths cut.
    """
    n = len(x)
    backward = as_words(x[:, WINDOW:])
    order = np.lexsort(backward.T[::-1])
    left_shared = shared_with_last(x[order, WINDOW:])
    right_shared = np.minimum(shared, WINDOW)
    out = np.zeros((n, LEFT + 1), dtype=bool)
    left = np.empty(n, dtype=np.int64)
    alone = (np.append(right_shared[1:], 0) < K) & (right_shared < K)
    live = ~alone
    for o in range(LEFT + 1):
        valid = np.flatnonzero(live & (before >= o) & (after >= WINDOW - o))
        if len(valid) < 2:
            continue
        left[order] = np.cumsum(left_shared < o)
        pair = np.cumsum(right_shared < WINDOW - o)[valid] * np.int64(n + 1) + left[valid]
        by = np.argsort(pair, kind="stable")
        first = groups_of(pair[by])
        least = np.repeat(np.minimum.reduceat(key[valid][by], first), np.diff(np.append(first, len(by))))
        out[valid[by], o] = least < key[valid][by]
    return out


def window_spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, least offset, largest offset) of each stretch of repeated windows."""
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    piece, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return piece, low, high


def _merge(bits: int):
    return lambda batches: _merged(batches, bits)


def _merged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    kinds = (np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.int32, np.int64, np.int32)
    spans = lambda *x: span_batch(*x, bits)
    for _, blobs, sure in by_bucket(batches):
        for blob in sure:
            yield spans(*unpack(blob, np.int64, np.int64, np.int64))
        parts = [unpack(blob, *kinds) for blob in blobs]
        if not parts:
            continue
        runs = [decode_run(p[0], p[1]) for p in parts]
        order, common = merge_runs(runs, [p[0].tolist() for p in parts])
        base = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
        index = np.array([base[r] + k for r, k in order], dtype=np.int64)
        x = np.frombuffer(b"".join(runs[r][k] for r, k in order), dtype=np.uint8).reshape(-1, WIDTH)
        common = np.array(common, dtype=np.int64)
        after, before, key, size = (np.concatenate([p[k] for p in parts])[index] for k in (2, 3, 4, 5))
        tag, place = (np.concatenate([p[k] for p in parts]) for k in (6, 7))
        sizes = np.concatenate([p[5] for p in parts])
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1][index]
        after, before = after.astype(np.int64), before.astype(np.int64)
        lead = common < WIDTH
        group = np.cumsum(lead) - 1
        first = np.flatnonzero(lead)
        least = np.minimum.reduceat(key, first)
        late = key > least[group]

        def each(entries: np.ndarray, begin=begin, size=size) -> tuple[np.ndarray, np.ndarray]:
            """(entry, occurrence) of all occurrences of some entries."""
            n = size[entries].astype(np.int64)
            return np.repeat(entries, n), np.repeat(begin[entries] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())

        e, o = each(np.flatnonzero(late))
        yield spans(*whole(tag[o], place[o].astype(np.int64), after[e], before[e]))
        hit = repeated_windows(x[first], common[first], after[first], before[first], least)
        piece, low, high = window_spans(hit)
        if not len(piece):
            continue
        # the occurrences of each piece that belong to its least key
        early = np.flatnonzero(~late)
        e, o = each(early)
        by = np.argsort(group[e], kind="stable")
        e, o = e[by], o[by]
        start = np.searchsorted(group[e], piece)
        n = np.searchsorted(group[e], piece, side="right") - start
        stretch = np.repeat(np.arange(len(piece)), n)
        at = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        yield spans(tag[o[at]], place[o[at]] - high[stretch], place[o[at]] - low[stretch] + WINDOW)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(2))
        out: list[list] = [[], [], [], []]
        for k, (starts, stops) in enumerate(span_lists(batch.column(1), batch.column(3))):
            text = data[offsets[k] : offsets[k + 1]]
            gone = covered(len(text), starts, stops)
            row = (len(text), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(text[~gone].tobytes() if len(starts) else text.tobytes()).hexdigest())
            for column, v in zip(out, row, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(rows: DataFrame, buckets: int, bits: int) -> DataFrame:
    """SPANS of bytes of ``keyed`` rows that windows of documents with smaller keys cover."""
    places = repeated_anchors(rows, byte_units, WINDOW, K, buckets, pieces=True)
    runs = rows.join(places, "rid").select(precedence(), "tag", "text", "places").mapInArrow(_runs(buckets), "bucket int, way int, blob binary")
    return shuffled(runs).mapInArrow(_merge(bits), SPANS)


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row.

    A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller doc_id. Null and empty
    texts have no bytes; rows of one doc_id don't cover each other; a null doc_id counts as the largest long; texts of any
    length are read whole, in slices; other columns are ignored; an empty table gives none.
    """
    rows, buckets, bits = keyed(docs, bucket_bytes)
    return with_spans(rows, repeated_spans(rows, buckets, bits)).mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
