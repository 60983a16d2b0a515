"""Anchors: content-chosen places such that equal windows of two documents have equal anchors.

The anchor of a window of ``window`` units (bytes or words) is the k-gram with the least hash in it, so every repeated window holds a repeated
anchor, and about two places in ``window - k`` are anchors. ``repeated_anchors`` finds those whose k-gram occurs in
several documents; only the text around them can repeat, and only that is sorted or indexed afterwards.

Tasks send packed, sorted hashes to buckets. A k-gram that a task has already seen in several documents is sent once and its places pass
by, so a passage that a third of all documents share costs a bucket one entry for each batch of rows.

Rows are told apart by their tag, a hash of doc_id and text, and joined by ``rid``, the first bits of it, so that null and repeated
doc_ids cost what others cost. Equal rows share a tag: they have the same places and the same spans, which are kept once.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.common import release, slices, text_buffers

ANCHORS = 1 << 20  # about as many meet in a bucket at most
NO_ID = np.int64((1 << 63) - 1)
#: (bytes, offsets) of some rows -> (k-gram hashes, row of each, place of each in its row, units of each row); hash 2**64-1: none.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
NONE = np.uint64((1 << 64) - 1)
PIECE = 1 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Compresses arrays byte plane by byte plane, so that high bytes that are all alike cost nothing."""
    parts = [np.ascontiguousarray(a) for a in arrays]
    head = struct.pack(f"<{len(parts)}q", *(p.nbytes for p in parts))
    planes = (p.view(np.uint8).reshape(-1, p.itemsize).T.tobytes() if p.size else b"" for p in parts)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, out, at = struct.unpack_from(f"<{len(kinds)}q", data), [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds, strict=True):
        planes = np.frombuffer(data, dtype=np.uint8, count=size, offset=at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each run of ``width`` entries, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return out if size == width else best(out[: len(x) - width + 1], out[width - size : len(x) - size + 1])


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Places that are the least of some run of ``width`` k-grams."""
    if len(h) < width:
        return np.zeros(0, dtype=np.int64)
    least = sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero((sliding(np.concatenate((pad, least, pad)), width, np.maximum) == h) & (h != NONE))


def places(data: np.ndarray, offsets: np.ndarray, units: Units, window: int, k: int, pieces: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place) of the anchors of all rows with at least one window. With ``pieces`` (bytes are units), a long row is read in pieces
    that overlap by a window, so that hashes, many times the bytes, are never made of all of it."""
    out: list[list[np.ndarray]] = [[], [], []]
    for a, b in slices(offsets):
        begin, end = offsets[a], offsets[b]
        step = PIECE if pieces and b - a == 1 and end - begin > 2 * PIECE else end - begin
        for c in range(begin, max(end, begin + 1), max(step, 1)):
            d = min(c + step + window - 1, end)
            own = offsets[a : b + 1] - begin if step == end - begin else np.array([0, d - c])
            h, row, place, size = units(data[c:d], own)
            at = minimizers(h, window - k + 1)
            at = at[size[row[at]] >= window]
            for x, y in zip(out, (h[at], (row[at] + a).astype(np.int32), (place[at] + (c - begin)).astype(np.int32)), strict=True):
                x.append(y)
            if d == end:
                break
    h, row, place = (np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in zip(out, (np.uint64, np.int32, np.int32), strict=True))
    if len(row) and pieces:  # two pieces may name the same place
        key = row.astype(np.int64) * np.int64(1 << 32) + place
        if (key[1:] <= key[:-1]).any():
            keep = np.unique(key, return_index=True)[1]
            h, row, place = h[keep], row[keep], place[keep]
    return h, row, place


def extents(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): for how many k-grams on each side of the places ``at``, ``width - 1`` at most, none is less than theirs. These are
    the windows that have their least k-gram there; the others find an anchor elsewhere."""
    reach = width - 1
    pad = np.full(reach, NONE)
    padded = np.concatenate((pad, h, pad))
    left, right = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
    side = np.arange(1, reach + 1)
    for a in range(0, len(at), 8192):
        z = at[a : a + 8192, None] + reach
        for out, sign in ((left, -1), (right, 1)):
            less = padded[z + sign * side] < padded[z]
            out[a : a + 8192] = np.where(less.any(axis=1), less.argmax(axis=1), reach)
    return left, right


def groups_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, dtype=np.int64)


def _send(units: Units, window: int, k: int, buckets: int, bits: int, pieces: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            h, row, place = places(*text_buffers(batch.column(2)), units, window, k, pieces)
            h >>= np.uint64(64 - bits)
            order = np.argsort(h, kind="stable")
            h, row, place = h[order], row[order], place[order]
            del order
            first = groups_of(h)
            several = np.zeros(0, dtype=bool)
            if len(first):
                key = keys[row]
                several = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)
                del key
            size = np.diff(np.append(first, len(h)))
            known = np.repeat(several, size)
            lead = np.zeros(len(h), dtype=bool)
            lead[first] = True
            sent = ~known | lead  # a k-gram known to repeat: one entry, without a place
            bucket, rid = (h % np.uint64(buckets)).astype(np.int32), rids[row]
            del row
            out: list[tuple[int, int, bytes]] = []
            for way, mask in ((0, sent), (1, known)):
                at = np.flatnonzero(mask)
                to = bucket[at] if way == 0 else (rid[at] % buckets).astype(np.int32)
                at = at[np.argsort(to, kind="stable")]
                to = bucket[at] if way == 0 else (rid[at] % buckets)
                bounds = np.append(groups_of(to), len(at))
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    s = at[a:b]
                    steps = np.diff(h[s], prepend=np.uint64(0)) if way == 0 else np.zeros(0, dtype=np.uint64)
                    out.append((int(to[a]), way, pack(steps, rid[s], np.where(known[s], -1, place[s]).astype(np.int32) if way == 0 else place[s])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "way", "blob"])
            del h, place, rid, bucket, known, sent, lead, out
            release()

    return run


def _replies(rid: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(place, pa.int32())], names=["rid", "place"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(bucket, blobs of way 0, blobs of way 1) from rows sorted by bucket."""
    bucket, blobs = None, ([], [])
    for batch in batches:
        for b, way, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if b != bucket:
                if bucket is not None:
                    yield bucket, *blobs
                bucket, blobs = b, ([], [])
            blobs[way].append(blob)
    if bucket is not None:
        yield bucket, *blobs


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, asked, passing in by_bucket(batches):
        for blob in passing:
            _, rid, place = unpack(blob, np.uint64, np.int64, np.int32)
            yield _replies(rid, place)
        parts = [unpack(blob, np.uint64, np.int64, np.int32) for blob in asked]
        if not parts:
            continue
        h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        rid, place = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        sender = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[1]) for p in parts])
        order = np.argsort(h, kind="stable")
        h, rid, place, sender = h[order], rid[order], place[order], sender[order]
        first = groups_of(h)
        if len(first):  # rows of two batches count as two documents, which at worst makes later steps look in vain
            several = (np.minimum.reduceat(sender, first) != np.maximum.reduceat(sender, first)) | (np.minimum.reduceat(place, first) < 0)
            told = np.repeat(several, np.diff(np.append(first, len(h)))) & (place >= 0)
            yield _replies(rid[told], place[told])


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows of (bucket, way, blob), together and in order by bucket."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", "way")


def repeated_anchors(docs: DataFrame, units: Units, window: int, k: int, buckets: int, pieces: bool = False) -> DataFrame:
    """rid, places: where the rows of ``keyed`` have an anchor whose k-gram also occurs in another document.

    Hashes are cut to what tells the anchors of all buckets apart but for one in some thousands; a chance meeting only
    makes later steps look at a place in vain.
    """
    bits = min(64, 10 + int(buckets * ANCHORS).bit_length())
    sent = docs.select("rid", precedence(), "text").mapInArrow(_send(units, window, k, buckets, bits, pieces), "bucket int, way int, blob binary")
    told = shuffled(sent).mapInArrow(_answer, "rid long, place int")
    return told.groupBy("rid").agg(F.collect_set("place").alias("places"))


def precedence() -> Column:
    """doc_id as an order of documents; a null one counts as the largest long."""
    return F.coalesce("doc_id", F.lit(int(NO_ID))).alias("key")


def keyed(docs: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """(doc_id, tag, rid, text; number of buckets; bits of rid). tag is a hash of doc_id and text; rid is as many of its bits as tell
    most rows apart."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    bits = min(62, int(size["rows"]).bit_length() + 4)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tag", F.xxhash64(precedence(), "text"))
    return docs.select("doc_id", "tag", rid_of("tag", bits).alias("rid"), "text"), max(8, -(-(size["bytes"] or 0) // bucket_bytes)), bits


def rid_of(tag: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(tag), 64 - bits)


SPANS = "rid long, span binary"
SPAN = np.dtype([("tag", "<i8"), ("start", "<i4"), ("stop", "<i4")])


def span_batch(tag: np.ndarray, start: np.ndarray, stop: np.ndarray, bits: int) -> pa.RecordBatch:
    """SPANS rows: a span is 16 bytes, so that lists of them stay small."""
    spans = np.empty(len(tag), dtype=SPAN)
    spans["tag"], spans["start"], spans["stop"] = tag, start, stop
    ends = pa.array(np.arange(len(tag) + 1, dtype=np.int32) * SPAN.itemsize).buffers()[1]
    blobs = pa.Array.from_buffers(pa.binary(), len(tag), [None, ends, pa.py_buffer(spans.tobytes())])
    rid = np.asarray(tag, dtype=np.int64).view(np.uint64) >> np.uint64(64 - bits)
    return pa.RecordBatch.from_arrays([pa.array(rid.astype(np.int64)), blobs], names=["rid", "span"])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, tag, text of ``keyed`` and spans, the distinct spans of all rows with its rid.

    Both this join and the one with ``repeated_anchors`` are on rid alone and of the same columns, so Spark moves the texts once.
    """
    lists = spans.groupBy("rid").agg(F.collect_set("span").alias("spans"))
    return docs.join(lists, "rid", "left").select("doc_id", "tag", "text", "spans")


def once_each(tags: np.ndarray) -> np.ndarray:
    """Whether each is the first of its kind."""
    out = np.zeros(len(tags), dtype=bool)
    out[np.unique(tags, return_index=True)[1]] = True
    return out


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n units lie in a span."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps[:n]) > 0


def span_lists(tags: pa.Array, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, stops) of the spans with each row's tag; none where the list is null."""
    ends = column.offsets.to_numpy()
    spans = np.frombuffer(text_buffers(column.values)[0].tobytes(), dtype=SPAN)
    for own, a, b, there in zip(tags.to_numpy(), ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True):
        mine = spans[a:b] if there else spans[:0]
        mine = mine[mine["tag"] == own]
        yield mine["start"].astype(np.int64), mine["stop"].astype(np.int64)
