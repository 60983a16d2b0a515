import random
import zlib
from collections import Counter

import cases
import pytest
from sightline.llm import language_id as ident, queries


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    grams = Counter()
    for w in words:
        grams.update(w)
        for n in (2, 3):
            padded = f" {w} "
            grams.update(padded[k : k + n] for k in range(len(padded) - n + 1) if padded[k : k + n].strip() and (n == 2 or padded[k + 1] != " "))
    return grams


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c) + 1)
    return out


def ranked(grams, top):
    return [g for _, g in sorted((-n, code(g)) for g, n in grams.items())][:top]


def test_predictions_equal_brute_force(spark):
    data = cases.rows(4, 90)
    docs = cases.frame(spark, data)
    top = 60
    profiles = ident.fit(docs, top=top)
    counts = {}
    for r in data:
        if r[0] is not None and r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2:
            counts.setdefault(r[2], Counter()).update(brute_grams(r[1]))
    assert profiles == {lang: ranked(c, top) for lang, c in counts.items()}
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in ident.predict(docs, profiles, top).collect())
    want = []
    for r in data:
        own = ranked(brute_grams(r[1]), top)
        best = ("und", 0.0)
        if own:
            far = {lang: sum(abs(k - p.index(g)) if g in p else top for k, g in enumerate(own)) for lang, p in profiles.items()}
            lang = min(sorted(far), key=far.get)
            best = (lang, 1 - far[lang] / (top * len(own)))
        want.append((str(r[0]), best[0], round(best[1], 9)))
    assert got == sorted(want)


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    data = [(k, cases.prose(rng, lang := rng.choice(["en", "de", "fr"]), 40), lang, "a", 1, 0, 0, 0, 0, "", 0) for k in range(400)]
    docs = cases.frame(spark, data)
    got = ident.predict(docs, ident.fit(docs)).withColumn("held", ident.held_out()).filter("held").collect()
    assert {r.doc_id for r in got} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r.lang_pred == data[r.doc_id][2] for r in got) >= 0.97 * len(got)
    profiles = ident.fit(docs)
    mixed = cases.frame(spark, [*data[:5], (900, "Привет мир как дела сегодня", None, "a", 1, 0, 0, 0, 0, "", 0), (901, None, None, None, 0, 0, 0, 0, 0, "", 0), (902, "42!", None, None, 0, 0, 0, 0, 0, "", 0)])
    kept = ident.accept(mixed, profiles)
    assert kept.columns == mixed.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("data", [[], [(1, "words", None, None, 0, 0, 0, 0, 0, "", 0)]])
def test_nothing_to_learn(spark, data):
    docs = cases.frame(spark, data)
    assert [(r.lang_pred, r.score) for r in ident.predict(docs, ident.fit(docs)).collect()] == [("und", 0.0)] * len(data)


def test_query_equals_brute_force(spark):
    """All labelled documents are below the bound of the fit, so that the query's profiles can be counted again."""
    folder = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    counts = {}
    for k, text, lang in data:
        if lang is not None and zlib.crc32(str(k).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    place = {lang: {g: k for k, g in enumerate(ranked(c, 300))} for lang, c in counts.items()}
    want = []
    for k, text, _ in data:
        own = ranked(brute_grams(text), 300)
        far = {lang: sum(abs(n - p[g]) if g in p else 300 for n, g in enumerate(own)) for lang, p in place.items()}
        lang = min(sorted(far), key=far.get)
        want.append((k, zlib.crc32(str(k).encode()) % 4 == 2, lang if own else "und", round(1 - far[lang] / (300 * len(own)), 9) if own else 0.0))
    got = queries.queries()["op6_language_id"](spark, folder).collect()
    assert sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == sorted(want)
