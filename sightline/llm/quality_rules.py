"""Quality rules: decision lists of threshold conjunctions, learned by sequential covering.

``statistics`` counts, ``learn`` grows and prunes rules on a bounded sample of labelled rows, and ``verdict`` emits them as one
ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.common import per_row, same_in_row, slices, span_hashes, text_buffers, window_hashes, words_of

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct_words", "n_lines"]
UPPER = np.isin(np.arange(256), np.arange(65, 91))
MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", dtype=np.uint8))


def count_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    starts, ends, hashes, row = words_of(data, offsets)
    n_words = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n_words)))
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    # lines: a row's start and the byte after each newline begin one
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    begin = begin[begin < len(data)]
    end = np.minimum(np.append(begin[1:], len(data)), offsets[np.searchsorted(offsets, begin, side="right")])
    end = end - ((data[np.maximum(end - 1, 0)] == 10) & (end > begin))
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[worded], end[worded]
    line_row = np.searchsorted(offsets, begin, side="right") - 1
    _, later = same_in_row(span_hashes(data, begin, end), line_row)
    # three-word windows found again in their row
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) >= 3:
        within = row[:-2] == row[2:]
        at = np.flatnonzero(within)
        again, _ = same_in_row(window_hashes(hashes, 3)[at], row[at])
        for k in range(3):
            covered[at[again] + k] = True
    _, repeated = same_in_row(hashes, row)
    return {
        "n_words": n_words, "word_chars": per_row(in_word & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_row(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_row[later], minlength=rows), "n_repeat_words": per_row(covered, first), "n_upper": per_row(UPPER[data], offsets),
        "n_marks": per_row(MARKS[data], offsets), "n_distinct_words": n_words - np.bincount(row[repeated], minlength=rows), "n_lines": np.bincount(line_row, minlength=rows),
    }


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        parts = [count_statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
        columns = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64) for c in STATS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of STATS for each whole text. Null text counts as empty; a null doc_id and repeated rows stay; long
    texts are counted in one piece; an empty table gives none; other columns are ignored.

    Lines and windows are compared by 64-bit hashes.
    """
    fields = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches, fields)


#: What the rules may test: shares that do not depend on a text's length.
FEATURES = {
    "mean_word": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "mark_share": ("n_marks", "n_words"), "distinct_share": ("n_distinct_words", "n_words"),
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def rows(self, x: pd.DataFrame) -> np.ndarray:
        return (x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold).to_numpy()

    def column(self) -> Column:
        top, bottom = FEATURES[self.feature]
        value = F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for test in rule:
        out &= test.rows(x)
    return out


def _grow(x: pd.DataFrame, bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    rule: Rule = ()
    live = np.ones(len(x), dtype=bool)
    while len(rule) < most and (live & ~bad).any():
        p0, n0 = (live & bad).sum(), (live & ~bad).sum()
        best, best_gain = None, 1e-9
        for f, values in cuts.items():
            column = x[f].to_numpy()[live]
            good_sorted, bad_sorted = np.sort(column[~bad[live]]), np.sort(column[bad[live]])
            n_low, p_low = np.searchsorted(good_sorted, values, side="right"), np.searchsorted(bad_sorted, values, side="right")
            for above, p, n in ((True, p0 - p_low, n0 - n_low), (False, p_low, n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Test(f, above, float(values[k])), gain[k]
        if best is None:
            break
        rule, live = (*rule, best), live & best.rows(x)
    return rule


def _worth(rule: Rule, x: pd.DataFrame, bad: np.ndarray) -> float:
    hit = _covers(rule, x)
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def simplified(rule: Rule) -> Rule:
    """``rule`` without the tests that a tighter one on the same side of the same feature implies."""
    best: dict[tuple[str, bool], Test] = {}
    for t in rule:
        old = best.get((t.feature, t.above))
        if old is None or (t.threshold > old.threshold if t.above else t.threshold < old.threshold):
            best[t.feature, t.above] = t
    return tuple(best.values())


def learn_rules(x: pd.DataFrame, bad: np.ndarray, max_rules: int = 16, max_tests: int = 4, precision: float = 0.97, min_cover: int = 5, cuts: int = 64) -> list[Rule]:
    """Rules for bad rows. Each grows on two rows of three by information gain, loses last tests while the held-out third
    likes it better, and stays if its precision there is high enough; the rows it covers then leave."""
    held = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    live = np.ones(len(x), dtype=bool)
    while len(rules) < max_rules:
        grow, prune = live & ~held, live & held
        if bad[grow].sum() < min_cover:
            break
        points = {f: np.unique(np.quantile(x[f][grow], np.linspace(0, 1, cuts + 1))) for f in x}
        own = {f: np.unique(np.quantile(x[f][grow & bad], np.linspace(0, 1, cuts + 1))) for f in x}
        middle = {f: np.unique(np.concatenate((v, own[f]))) for f, v in points.items()}
        rule = _grow(x[grow], bad[grow], middle, max_tests)
        while len(rule) > 1 and _worth(rule[:-1], x[prune], bad[prune]) >= _worth(rule, x[prune], bad[prune]):
            rule = rule[:-1]
        rule = simplified(rule)
        hit = _covers(rule, x) & live
        p, n = (hit & bad & prune).sum(), (hit & ~bad & prune).sum()
        if not rule or p < 1 or (hit & bad).sum() < min_cover or p / (p + n) < precision:
            break
        rules.append(rule)
        live &= ~hit
    return rules


def learn(stats: DataFrame, labels: DataFrame, sample_rows: int = 20000) -> list[Rule]:
    """Fits on at most ``sample_rows`` labelled rows, those with the lowest hash of doc_id; labels has doc_id, quality (0: bad).

    Rows without a label or with a null one are left out; of several labels of one doc_id the least counts. Without bad or without
    good rows, as in an empty table, the list is empty.
    """
    chosen = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = stats.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(sample_rows).toPandas()
    bad = (rows["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    x = pd.DataFrame({f: np.where(rows[b] > 0, rows[a] / np.maximum(rows[b], 1), 0.0) for f, (a, b) in FEATURES.items()})
    return learn_rules(x, bad)


def verdict(rules: list[Rule]) -> Column:
    """False for rows that a rule covers, tested in order; else true."""
    out = None
    for rule in rules:
        hit = rule[0].column()
        for test in rule[1:]:
            hit = hit & test.column()
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with base_failed and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
