import hashlib
import random
import time

import cases
import pytest
from sightline.llm import substring_dedup, suffix_dedup

LAST = (1 << 63) - 1  # a null doc_id counts as the largest long


def brute_bytes(data):
    first = {}
    for r in data:
        b, key = (r[1] or "").encode(), LAST if r[0] is None else r[0]
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], key), key)
    out = []
    for r in data:
        b, key = (r[1] or "").encode(), LAST if r[0] is None else r[0]
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(r[0]), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def brute_words(data):
    first = {}
    for r in data:
        w, key = cases.WORD.findall(r[1] or ""), LAST if r[0] is None else r[0]
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), key), key)
    out = []
    for r in data:
        w, key = cases.WORD.findall(r[1] or ""), LAST if r[0] is None else r[0]
        gone = bytearray(len(w))
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key:
                gone[k : k + 50] = b"\1" * 50
        out.append((str(r[0]), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def passages(seed):
    """Documents cut from a few texts at odd places, so that repeats of all lengths around the window overlap."""
    rng = random.Random(seed)
    pool = [cases.prose(rng, lang, 160) for lang in ("en", "de", "fr")] + ["ab" * 200, "x " * 130]
    out = []
    for k in range(50):
        text = ""
        for _ in range(rng.randrange(1, 5)):
            source = rng.choice(pool)
            a = rng.randrange(len(source))
            text += source[a : a + rng.choice([20, 48, 49, 50, 51, 90, 300, 600])] + rng.choice(["", " ", "é"])
        out.append((k, text, "en", "a", 1, 0, 0, 0, 0, "", 0))
    return out


@pytest.mark.parametrize("data", [cases.rows(), passages(1), passages(2), []], ids=["cases", "passages1", "passages2", "empty"])
def test_repeats_equal_brute_force(spark, data):
    docs = cases.frame(spark, data)
    got = suffix_dedup.remove_repeats(docs, bucket_bytes=20_000).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(data)
    got = substring_dedup.remove_repeats(docs, bucket_bytes=20_000).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(data)


def test_loser_tree_merges_any_runs():
    rng = random.Random(4)
    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(suffix_dedup.WIDTH - 60)) + b"c" * 60 for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 9))]
        shared = [[0 if k == 0 else suffix_dedup.first_difference(r[k], r[k - 1], 0) for k in range(len(r))] for r in runs]
        order, common = suffix_dedup.merge_runs(runs, shared)
        merged = [runs[r][k] for r, k in order]
        assert merged == sorted(x for r in runs for x in r)
        assert common == [0 if k == 0 else suffix_dedup.first_difference(merged[k], merged[k - 1], 0) for k in range(len(merged))]


def test_null_repeated_and_largest_ids(spark):
    rng = random.Random(9)
    shared = cases.prose(rng, "en", 70)
    own = [cases.prose(rng, "de", 12) + shared + cases.prose(rng, "fr", 12) for _ in range(40)]
    data = [(None, t) for t in own[:12]] + [(5, t) for t in own[12:24]] + [(None, own[0])] * 5 + [(LAST, own[30]), (LAST, own[0]), (-LAST - 1, own[31])] + [(9, None), (None, ""), (5, own[12])]
    docs = cases.frame(spark, [(*r, "en", "a", 1, 0, 0, 0, 0, "", 0) for r in data])
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(data)
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(data)


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup])
def test_null_and_repeated_ids_cost_what_others_cost(spark, operator):
    rng = random.Random(10)
    shared = cases.prose(rng, "en", 70)
    texts = [cases.prose(rng, "de", 10) + shared + cases.prose(rng, "fr", 10) for _ in range(4000)]

    def seconds(ids):
        docs = cases.frame(spark, [(i, t, "en", "a", 1, 0, 0, 0, 0, "", 0) for i, t in zip(ids, texts, strict=True)]).cache()
        docs.count()
        began = time.time()
        operator.remove_repeats(docs).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(range(4000))
    base = seconds(range(4000))
    assert seconds([None] * 4000) < 2 * base + 1
    assert seconds([7] * 4000) < 2 * base + 1


def test_long_rows_are_read_in_pieces(monkeypatch):
    import numpy as np
    from sightline.llm import anchors

    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abc \xc3\xa9") for _ in range(n)) for n in (0, 30, 5000, 70, 49, 50, 9000)]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(anchors, "slices", lambda o: ((k, k + 1) for k in range(len(o) - 1)))
    found = lambda pieces: sorted(zip(*(x.tolist() for x in anchors.places(data, offsets, suffix_dedup.byte_units, 50, 20, pieces)), strict=True))
    whole = found(False)
    monkeypatch.setattr(anchors, "PIECE", 333)
    assert found(True) == whole and len(whole) > 300
