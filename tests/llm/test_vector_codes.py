import hashlib
import math
import random

import numpy as np
from sightline.llm import queries, vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, x string, error long, code int, place long"


def brute(data, parts=4, entries=256, rounds=4):
    """Plain loops over all entries, in Python integers."""
    good = [(i, [math.floor(1024 * v) for v in e], lab) for i, e, lab in data if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    width = -(-max((len(e) for _, e, _ in good), default=0) // parts)
    good = [(i, [(e + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)], lab) for i, e, lab in good]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i8").tobytes()))
    books = [[r[1][p] for r in good[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    assign = lambda: [[min((dist(r[1][p], c), j) for j, c in enumerate(books[p])) for p in range(parts)] for r in good]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [r[1][p] for r, f in zip(good, found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(good, error):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted(((str(r[0]), "".join(f"{j:02x}" for _, j in f), e, by[r[2]]) for r, f, e in zip(good, found, error))), sha


def vectors(rng, n, dims, spread=1.0):
    return [(k * 7 % n, [float(np.float32(rng.gauss(0, spread))) for _ in range(dims)], rng.choice([1, 1, 1, 2, 3, None])) for k in range(n)]


def rows(spark, data):
    frame = spark.createDataFrame([(i, e, lab, "x", 5, 6, 7) for i, e, lab in data], SCHEMA).repartition(3)
    coded, books = vc.compress(frame)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in coded.collect()), books


def test_against_plain_loops_with_odd_rows(spark):
    rng = random.Random(1)
    data = vectors(rng, 300, 12)
    data += [(1000, None, 1), (1001, [1.0] * 11 + [None], 2), (1002, [float("nan")] * 12, 1), (1003, [float("-inf")] + [0.0] * 11, 2), (None, [0.5] * 12, None), (None, [0.25] * 12, None)]
    data += [(1004, [0.1, -0.0], 5), (1005, [], 5), (1006, [3000.0] * 12, 7), *[(2000 + k, data[5][1], 9) for k in range(60)], data[3], data[3]]
    got, books = rows(spark, data)
    assert (got, books.sha256()) == brute(data)
    assert {i for i, *_ in got}.isdisjoint({"1000", "1001", "1002", "1003"}) and len({e for *_, e in got}) == 7


def test_few_vectors_ties_and_none(spark):
    few = [(k, [float(k % 3), 0.0, 1.0, 2.0], 1) for k in range(20)]
    got, books = rows(spark, few)
    assert (got, books.sha256()) == brute(few) and {c[:2] for _, c, *_ in got} == {"00", "01", "02"}
    got, books = rows(spark, [(1, None, 1)])
    assert got == [] and books.entries.size == 0
    assert rows(spark, [])[0] == []


def test_transform_keeps_distances_in_sequency_order():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 5, 16, 24):
        x = rng.integers(-vc.limit_of(width), vc.limit_of(width) + 1, (40, width))
        t = vc.transform(x)
        exact = lambda a, b: sum((int(s) - int(u)) ** 2 for s, u in zip(a, b, strict=True))
        assert all(exact(t[k], t[k + 1]) == t.shape[1] * exact(x[k], x[k + 1]) for k in range(39))
    matrix = vc.transform(np.eye(16, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in matrix] == list(range(16))


def test_elimination_drops_entries_and_never_the_nearest():
    rng = np.random.default_rng(3)
    entries = rng.integers(-500, 500, (256, 16))
    x = np.concatenate([entries[rng.integers(0, 256, 300)] + rng.integers(-40, 40, (300, 16)), entries[:20], (entries[:10] + entries[10:20]) // 2])
    which, least, work = vc.nearest(vc.transform(x), vc.transform(entries))
    all_ = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (which == all_.argmin(axis=1)).all() and (least == all_.min(axis=1)).all()
    assert work < 0.5 * len(x) * 256 * 16


def test_largest_components_are_exact():
    for width in (3, 16, 1024):
        m = vc.limit_of(width)
        x, entries = np.full((1, width), m), np.stack([np.full(width, -m), np.full(width, -m + 1)])
        which, least, _ = vc.nearest(vc.transform(x), vc.transform(entries))
        assert which[0] == 1 and int(least[0]) == width * (2 * m - 1) ** 2


def test_codes_can_be_read_back(spark):
    data = vectors(random.Random(4), 100, 8)
    coded, books = vc.compress(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    own = {i: [math.floor(1024 * v) for v in e] for i, e, _ in data}
    for r in vc.decode(coded, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(own[r.vec_id], r.vector, strict=True)) == r.error


def test_query_on_given_table(spark):
    folder = "/root/testdata/sf0.001"
    data = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").limit(500).collect()]
    got = queries.queries()["op12_vector_codes"](spark, folder).collect()
    assert len(got) == len(data) and len({r.codebooks_sha256 for r in got}) == 1
