"""Periodic runs of words: where the same few words come back over and over, side by side.

A run of period q and at least max(6, 4 q) words holds each of its words four times or more. So a word that is found less than four times in a
segment is in no run of that segment and splits it; the parts are counted again, until no word splits any more. What survives is
scanned lag by lag. A run of lag q has words that equal the word q places on for 3 q places in a row, so three multiples of q in a row are among
them: these are tested for all lags at once, and only where they agree is a run drawn out to both sides. Lags come in ascending order, and a
stretch within a run of a smaller period has that period, so the first period found is the smallest.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import release, slices, text_buffers

LEAST, TIMES = 6, 4  # words of a run, and periods in it, at least
CHUNK = 1 << 20  # pairs tested at a time


def segments_of(ids: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the segments in which every word is found TIMES times or more."""
    out, left = [], [(0, len(ids))]
    while left:
        start, stop = left.pop()
        part = np.unique(ids[start:stop], return_inverse=True)[1] if (start, stop) != (0, len(ids)) else ids
        rare = np.flatnonzero(np.bincount(part)[part] < TIMES)
        if not len(rare):
            out.append((start, stop))
            continue
        cuts = np.concatenate([[-1], rare, [stop - start]])
        keep = np.flatnonzero(np.diff(cuts) > LEAST)
        left += [(start + int(cuts[k]) + 1, start + int(cuts[k + 1])) for k in keep]
    return sorted(out)


def _reach(ids: np.ndarray, lag: int, at: int, step: int, limit: int) -> int:
    """How many places from ``at`` on, in steps of 1 or -1, equal the word ``lag`` places on; ``limit`` at most."""
    done, block = 0, 16
    while done < limit:
        n = min(block, limit - done)
        low = at + done if step > 0 else at - done - n + 1
        same = ids[low : low + n] == ids[low + lag : low + lag + n]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done, block = done + n, 2 * block
    return done


def _candidates(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(lag, first, last): chains of multiples of a lag of which three or more in a row equal the word ``lag`` places on, by lag."""
    n, lag = len(ids), 1
    while lag <= n // TIMES:
        stop = lag
        room = CHUNK
        while stop <= n // TIMES and room > 0:
            room -= (n - 1) // stop
            stop += 1
        lags = np.arange(lag, stop)
        many = (n - 1) // lags
        begins = np.cumsum(many) - many
        of = np.repeat(lags, many)
        at = (np.arange(len(of)) - np.repeat(begins, many)) * of
        same = ids[at] == ids[at + of]
        # between two such multiples all places agree too, so some of them are tested before a run is drawn out
        chain = np.zeros(len(of) + 2, dtype=bool)
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:] & (of[:-2] == of[2:]))
        for part in range(1, 8):
            if not len(three):
                break
            places = at[three] + of[three] * part // 4
            three = three[ids[places] == ids[places + of[three]]]
        chain[three] = chain[three + 1] = chain[three + 2] = True
        chain = chain[: len(of)]
        starts = np.flatnonzero(chain & ~np.concatenate([[False], chain[:-1] & (of[1:] == of[:-1])]))
        stops = np.flatnonzero(chain & ~np.concatenate([chain[1:] & (of[1:] == of[:-1]), [False]]))
        for a, b in zip(starts, stops, strict=True):
            yield int(of[a]), int(at[a]), int(at[b])
        lag = stop


def _runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    found: list[tuple[int, int, int]] = []
    known: dict[int, tuple[list[int], list[int]]] = {}  # starts and stops of the runs of a period
    for lag, at, last in _candidates(ids):
        while at <= last - 2 * lag:
            stop = 0
            for period, (starts, stops) in known.items():
                if lag % period == 0 and (k := bisect_right(starts, at) - 1) >= 0 and stops[k] > at + 3 * lag:
                    stop = stops[k]  # a stretch of this lag is all of that run, so its smallest period is not the lag
            if not stop:
                start = at + 1 - _reach(ids, lag, at, -1, at + 1)
                stop = at + lag + _reach(ids, lag, at, 1, len(ids) - lag - at)
                if stop - start >= max(LEAST, TIMES * lag):
                    found.append((start, stop - start, lag))
                    starts, stops = known.setdefault(lag, ([], []))
                    starts.append(start)
                    stops.append(stop)
            at = (stop - lag) // lag * lag + lag
    return found


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of words, by start, then period."""
    if len(words) < LEAST:
        return []
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    return sorted((a + s, n, q) for a, b in segments_of(ids) for s, n, q in _runs_of(ids[a:b]))


def repeated_tail(doc_id: int | None, words: list) -> list:
    """The words of a document whose hashed id asks for it, from a place on replaced by repeats of the words from there."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, prepare=None) -> DataFrame:
    """RUNS of every whole text: all periodic runs by start, then period, and the words that are left when of each run only the first period is kept,
    joined by one space.

    ``prepare(doc_id, words)`` may replace a document's words (a list of bytes). Null and empty texts have no words and no runs; repeated rows stay; null ids are
    ids; other columns are ignored; long texts are read whole, in time that grows little faster than their words; an empty table gives none.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(text_buffers(batch.column(1))[1], 1 << 21):
                keys, out = batch.column(0).slice(start, stop - start), ([], [], [])
                for doc_id, text in zip(keys.to_pylist(), batch.column(1).slice(start, stop - start).to_pylist(), strict=True):
                    words = (text or "").encode().split()  # bytes split at the six ASCII spaces only
                    words = prepare(doc_id, words) if prepare else words
                    runs = runs_of(words)
                    if runs:
                        gone = np.zeros(len(words), dtype=bool)
                        for s, n, q in runs:
                            gone[s + q : s + n] = True
                        kept = [words[k] for k in np.flatnonzero(~gone)]
                    for column, v in zip(out, (len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(kept if runs else words)), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([keys, pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(_RUN)), pa.array(out[2], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, RUNS)


def strongest(runs: F.Column) -> F.Column:
    """The run of greatest length by period, exactly; of equal ones the first by start, then period. Null where there is none."""
    better = lambda r, s: r["length"] * s["period"] > s["length"] * r["period"]
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | better(r, best), r).otherwise(best))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the strongest run, and the digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
