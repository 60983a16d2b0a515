import os
import random
from collections import Counter, defaultdict

import cases
import pytest
from sightline.llm import near_dedup
from sightline.llm.components import components


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = cases.WORD.findall(low)
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(data, size, percent=80):
    ids = sorted({r[0] for r in data if r[0] is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(r[0], shingles(r[1], size)) for r in data if r[0] is not None]
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((str(r[0]), len(shingles(r[1], size)), str(find(r[0]) if r[0] is not None else None), r[0] is None or find(r[0]) == r[0]) for r in data)


@pytest.mark.parametrize(("size", "leaf"), [(2, 32), (5, 2)])
def test_components_equal_brute_force(spark, size, leaf):
    rng = random.Random(size)
    data = cases.rows(size, 70)
    base = cases.prose(rng, "en", 120)
    data += [(2000 + k, cases.edited(rng, base, rng.choice([1, 3, 6, 9])), "en", "a", 1, 0, 0, 0, 0, "", 0) for k in range(40)]
    got = near_dedup.near_duplicates(cases.frame(spark, data), size=size, leaf=leaf).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(data, size)


def test_empty_table_and_one_of_each(spark):
    assert near_dedup.near_duplicates(cases.frame(spark, [])).count() == 0
    data = cases.rows(9)
    docs = cases.frame(spark, data)
    out = near_dedup.one_of_each(docs, size=5)
    assert out.columns == docs.columns
    want = sorted({d for d, _, _, kept in brute(data, 5) if kept and d != "None"} | set()) + ["None"] * sum(r[0] is None for r in data)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(want)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, k) for k in range(100, 150)] + [(7, 7), (None, 3), (900, 901), (901, 900)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in [*range(101, 150), 200]}, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_large_nodes_are_all_compared(spark):
    """Chains of texts in which each has 9 of the last one's 100 words replaced: 89 of 109 word pairs are shared with it (0.82), 79 of
    119 with the one before (0.66). Nodes at depth 2 hold more than two of a chain; at depth 9 many of its links do not meet."""
    data, want = [], {}
    for chain in range(12):
        words = [f"w{chain}x{k}" for k in range(100)]
        for k in range(10):
            data.append((chain * 100 + k, " ".join(words), "en", "a", 1, 0, 0, 0, 0, "", 0))
            want[chain * 100 + k] = chain * 100
            words[k * 10 + 1 : k * 10 + 10] = [f"n{chain}x{k}x{j}" for j in range(9)]
    got = near_dedup.near_duplicates(cases.frame(spark, data), size=2, trees=12, levels=(2, 9), leaf=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("size", [2, 5])
def test_recall_on_the_given_documents(spark, size):
    """Documents whose id is divisible by 20 against all: each link found by counting shared shingles must lie within one component."""
    docs = spark.read.parquet(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01") + "/documents.parquet")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, size=size).collect()}
    sets, holders = {}, defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        sets[r.doc_id] = shingles(r.text, size)
        for s in sets[r.doc_id]:
            holders[s].append(r.doc_id)
    assert {d: len(s) for d, s in sets.items()} == {d: n for d, (n, _) in found.items()}
    links = []
    for d in (d for d in sets if d % 20 == 0):
        shared = Counter(o for s in sets[d] for o in holders[s] if o != d)
        links += [(d, o) for o, n in shared.items() if 100 * n >= 80 * (len(sets[d]) + len(sets[o]) - n)]
    met = sum(found[a][1] == found[b][1] for a, b in links)
    print(f"size {size}: {met} of {len(links)} links")
    assert links and met >= 0.99 * len(links)
