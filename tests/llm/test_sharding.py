from collections import Counter

import cases
import pytest
import xxhash
from sightline.llm import queries, sharding

FOLDER = "/root/testdata/sf0.001"


def brute_table(names, size):
    """One full preference list for each shard, then turns."""
    prefer = []
    for x in names:
        start, stride = sharding._number(f"start:{x}") % size, sharding._number(f"stride:{x}") % (size - 1) + 1
        prefer.append(iter([(start + k * stride) % size for k in range(size)]))
    table = {}
    while len(table) < size:
        for shard, wish in enumerate(prefer):
            if len(table) < size:
                table[next(s for s in wish if s not in table)] = shard
    return [table[k] for k in range(size)]


def test_table_is_filled_by_turns():
    for n, size in ((1, 2), (3, 7), (8, 251), (10, 1009)):
        table = sharding.lookup_table(sharding.shard_names(n), size).tolist()
        assert table == brute_table(sharding.shard_names(n), size)
        assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 9)


def test_few_slots_move_with_one_shard_less():
    names = sharding.shard_names(20)
    a, b = sharding.lookup_table(names, 10007), sharding.lookup_table(names[:-1], 10007)
    assert ((a != b) & (a != 19)).mean() < 0.2


def slot(key, size=sharding.TABLE_SIZE):
    h = xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % size


def test_placement(spark):
    data = cases.rows()
    docs = cases.frame(spark, data)
    got = sharding.place(docs, names=sharding.shard_names(4), table_size=251).collect()
    assert len(got) == len(data)
    table = brute_table(sharding.shard_names(4), 251)
    for r in got:
        assert r.shard == table[r.slot]
        if r.doc_id is not None:
            assert r.slot == slot(r.doc_id, 251)
    assert sharding.place(docs.limit(0)).count() == 0
    assert sharding.place(docs).columns == [c for c in docs.columns if c != "slot"] + ["slot", "shard"]


def test_hot_and_null_keys_are_spread(spark):
    data = [(7 if k % 3 else None, f"text {k}", "en", "a", 1, 0, 0, 0, 0, "", 0) for k in range(3000)]
    docs = cases.frame(spark, data)
    got = Counter(r.shard for r in sharding.place(docs, names=sharding.shard_names(8), spread=True).collect())
    assert len(got) == 8 and max(got.values()) < 600
    nulls = Counter(r.shard for r in sharding.place(docs, names=sharding.shard_names(8)).filter("doc_id is null").collect())
    assert len(nulls) == 8 and max(nulls.values()) < 200


def test_rows_stay_when_the_table_grows(spark):
    data = cases.rows()
    more = data + [(k, f"text {k}", "en", "a", 1, 0, 0, 0, 0, "", 0) for k in range(2000, 4000)] + [data[0]] * 50
    for spread in (False, True):
        few = {(r.doc_id, r.text): (r.slot, r.shard) for r in sharding.place(cases.frame(spark, data), spread=spread).collect()}
        many = {(r.doc_id, r.text): (r.slot, r.shard) for r in sharding.place(cases.frame(spark, more), spread=spread).collect()}
        assert all(many[k] == v for k, v in few.items())


def test_query_places_each_row_by_id_and_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    table = sharding.lookup_table(sharding.shard_names(sharding.SHARDS))

    def place(r):
        h = xxhash.xxh64(r.doc_id.to_bytes(8, "little", signed=True), seed=42).intdigest()
        h = xxhash.xxh64(r.text.encode(), seed=h).intdigest() if r.text is not None else h
        s = (h - (1 << 64) if h >> 63 else h) % sharding.TABLE_SIZE
        return r.doc_id, s, int(table[s])

    got = queries.queries()["op4_sharding"](spark, FOLDER).collect()
    assert Counter(map(tuple, got)) == Counter(map(place, docs))
