"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to 3, padded by one space at word ends) in rank order. A document's
own most frequent n-grams are compared to each profile by out-of-place distance: the sum over its n-grams of the distance between
the two ranks, or ``top`` where the profile lacks it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from sightline.llm.common import slices, text_buffers

TOP = 300
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTERS[0]


def grams_by_row(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of each text; none if it has no letter. 21 bits a character: 1 is a space, a letter its code point + 1."""
    table = letters()
    for text in texts:
        x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.where(table[x], x.astype(np.int64) + 1, 1)
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = (c[1:] != 1) | (c[:-1] != 1)
        c = np.concatenate(([1], c[keep], [1])) if len(c) else np.ones(1, dtype=np.int64)
        c = c[1:] if len(c) > 1 and c[1] == 1 else c
        c = c[:-1] if len(c) > 1 and c[-2] == 1 else c
        real = c != 1
        two = (c[:-1] << 21 | c[1:])[real[:-1] | real[1:]]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[real[1:-1]] if len(c) > 2 else np.zeros(0, dtype=np.int64)
        yield np.unique(np.concatenate((c[real], two, three)), return_counts=True)


def top_ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first; ties by n-gram."""
    if len(grams) > top:
        cut = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= cut
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:top]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    data, offsets = text_buffers(batch.column(column))
    for a, b in slices(offsets):
        yield a, [bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace") for i in range(a, b)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        sums: dict[str, tuple[list, list]] = {}
        for at, texts in _texts(batch, 1):
            for i, (g, n) in enumerate(grams_by_row(texts)):
                both = sums.setdefault(langs[at + i], ([], []))
                both[0].append(g)
                both[1].append(n)
        for lang, (g, n) in sums.items():
            grams, where = np.unique(np.concatenate(g), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])


def learn_profiles(labelled: DataFrame, top: int = TOP, per_language: int = 2000) -> dict[str, list[int]]:
    """Profiles from about ``per_language`` documents of each language (a hash of doc_id picks them), which bounds the fit.

    Every language gets its profile of ``top`` n-grams; only these come to the driver. ``labelled`` has doc_id, text, lang; rows
    with a null in any are left out; n-grams tied in frequency are ordered by value; an empty table gives no profile.
    """
    rows = labelled.select("doc_id", "text", "lang").dropna()
    known = rows.groupBy("lang").count().collect()  # one row a language, as the model that is learned
    if not known:
        return {}
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in known], "lang string, share double")
    chosen = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.langs, self.top = sorted(profiles), top
        self.grams = np.unique(np.array([g for x in profiles.values() for g in x], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, grams: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """(language, 1 - distance / largest possible distance); ties go to the first language in order."""
        if not len(grams) or not self.langs:
            return "und", 0.0
        own = top_ranked(grams, counts, self.top)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[at]
        distance = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (self.top * len(own))


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; ``und`` and 0 where it is null, has no letter, or nothing was learned.

    Only the text is used. A text as near to several profiles goes to the first language in code point order. Repeated rows give
    repeated rows, an empty table gives none; other columns are ignored.
    """
    model = Profiles(profiles, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(g, n) for _, texts in _texts(batch, 1) for g, n in grams_by_row(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, profiles: dict[str, list[int]], min_score: float = 0.2, top: int = TOP) -> DataFrame:
    """The rows of ``docs``, whole, whose text is in one of the profiles' languages: not ``und``, and a score from ``min_score`` on.

    A text in a language that was not learned shares hardly an n-gram with any profile and scores near 0.
    """
    model, at = Profiles(profiles, top), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(g, n) for _, texts in _texts(batch, at) for g, n in grams_by_row(texts)]
            yield batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of doc_id as text, modulo 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, **bounds) -> dict[str, list[int]]:
    """Profiles learned from the documents that are not held out."""
    return learn_profiles(docs.filter(F.col("doc_id").isNotNull() & ~held_out()), **bounds)
