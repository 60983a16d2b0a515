import hashlib
import random
import re
import time
import zlib

import cases
import numpy as np
import pytest
from sightline.llm import periodic_runs as pr, queries


def brute(words):
    """Every lag at every place; a stretch is kept if no smaller period fits it."""
    n, out = len(words), []
    ids = np.unique(words, return_inverse=True)[1] if n else np.zeros(0, dtype=int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2], edge[1::2]):
            length = int(b - a) + q
            if length >= max(6, 4 * q):
                part = ids[a : a + length]
                if not any((part[:-d] == part[d:]).all() for d in range(1, q)):
                    out.append((int(a), length, q))
    return sorted(out)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs, best = brute(words), None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def made(rng):
    words = []
    while len(words) < rng.choice([0, 5, 30, 120]):
        kind, letters = rng.random(), rng.choice(["ab", "abc", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        block = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
        words += block * rng.choice([1, 3, 4, 5, 9]) + block[: rng.randrange(len(block) + 1)] if kind < 0.6 else block
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    many = 0
    for k in range(3000):
        words = made(rng) if k % 3 else [rng.choice("ab") for _ in range(rng.randrange(60))]
        want = brute(words)
        assert pr.runs_of([w.encode() for w in words]) == want
        many += len(want) > 1
    assert many > 200


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_lags_in_any_number_of_chunks(monkeypatch, chunk):
    monkeypatch.setattr(pr, "CHUNK", chunk)
    rng = random.Random(2)
    for _ in range(100):
        words = made(rng)
        assert pr.runs_of(words) == brute(words)


def test_splitting_drops_all_but_runs():
    """Segments hold every run; in ordinary prose nothing else survives."""
    rng = random.Random(3)
    words = cases.prose(rng, "en", 3000).split()
    words[1000:1000] = ["x", "y", "z"] * 5
    ids = np.unique(words, return_inverse=True)[1]
    found = pr.segments_of(ids)
    assert all(any(a <= s and s + n <= b for a, b in found) for s, n, _ in brute(words))
    letters = np.array([k for k in range(50) for _ in range(3)] + [99] * 6)
    assert pr.segments_of(letters) == [(150, 156)]


def test_long_runs_and_long_texts_in_little_time():
    rng = random.Random(4)
    unit = [str(rng.randrange(500)) for _ in range(30000)]
    began = time.time()
    assert pr.runs_of(unit * 4 + unit[:7]) == [(0, 120007, 30000)]
    assert pr.runs_of(["a"] * 200000) == [(0, 200000, 1)]
    assert pr.runs_of(["a", "b"] * 50000 + ["c"] + ["b", "b"] * 20000) == [(0, 100000, 2), (100001, 40000, 1)]
    assert time.time() - began < 60


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    want = [expected(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.queries()["op13_periodic_runs"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark):
    data = cases.rows(n=30)
    rng = random.Random(5)
    data += [(3000 + k, " ".join(made(rng)), None, None, None, 7, -1, 3, 9, "x", 2) for k in range(60)]
    got = pr.digest(pr.find_runs(cases.frame(spark, data), prepare=pr.repeated_tail)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(expected(r[0], r[1])) for r in data)
    plain = {r.doc_id: r for r in pr.find_runs(cases.frame(spark, data)).collect()}
    assert plain[1008].n_words == 90 and [tuple(r) for r in plain[1008].runs] == [(0, 90, 1)] and plain[1008].collapsed == "aaaa"
    assert plain[1000].runs == [] and plain[1000].collapsed == "" and pr.find_runs(cases.frame(spark, [])).count() == 0
