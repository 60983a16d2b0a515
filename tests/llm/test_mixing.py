from collections import Counter

import cases
from pyspark.sql import functions as F
from sightline.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: unit * w[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(spark, data, **options):
    slots, placed = mixing.mix(cases.frame(spark, data), **options)
    got = mixing.taken_words(slots, placed, options.get("block_words", 512)).collect()
    size = {}
    for r in data:
        size[r[3]] = size.get(r[3], 0) + len(cases.WORD.findall(r[1] or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, len(cases.WORD.findall(r[1] or ""))) for r in data)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    want = brute_targets(size) if size else {}
    by_target = {}
    for r in got:
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s, n in size.items():
        assert (n, round(want[s], 6)) in by_target
    assert abs(sum(r.taken for r in got) - sum(int(t) for t in want.values())) <= 0
    return sorted(got, key=str), slots


def test_taken_words_meet_targets_and_reruns_agree(spark):
    data = cases.rows()
    first, slots = check(spark, data, block_words=32, slots_per_shard=16)
    assert first == check(spark, data, block_words=32, slots_per_shard=16)[0]
    per_shard = Counter(r.shard for r in slots.collect())
    assert all(per_shard[k] == 16 for k in range(max(per_shard))) and set(per_shard) == set(range(max(per_shard) + 1))


def _sources(spark, blocks):
    """Sources of whole blocks of 10 words, taken once each."""
    rows = [(k, 10 * n, float(10 * n)) for k, n in enumerate(blocks)]
    return spark.createDataFrame(rows, "source_rank long, source_size long, target double")


def test_shard_counts_are_multinomial_draws(spark):
    blocks, per_shard = [6000, 3000, 900, 100], 50
    counts = mixing.shard_counts(_sources(spark, blocks), 10, per_shard, 3).collect()
    drawn = {(r.shard, r.source.source_rank): r.drawn for r in counts}
    shards = sum(blocks) // per_shard
    for k, n in enumerate(blocks):
        p, own = n / sum(blocks), [drawn.get((s, k), 0) for s in range(shards)]
        mean = sum(own) / shards
        spread = sum((x - mean) ** 2 for x in own) / shards
        assert abs(mean - per_shard * p) < 5 * (per_shard * p * (1 - p) / shards) ** 0.5
        assert 0.6 < spread / (per_shard * p * (1 - p)) < 1.5
    assert all(sum(drawn.get((s, k), 0) for k in range(4)) == per_shard for s in range(shards))


def test_slots_follow_the_draws_until_a_source_is_used_up(spark):
    blocks, per_shard = [600, 300, 95, 5], 50
    sources = _sources(spark, blocks)
    drawn = {(r.shard, r.source.source_rank): r.drawn for r in mixing.shard_counts(sources, 10, per_shard, 5).collect()}
    slots = mixing.slot_table(sources, 10, per_shard, 5).collect()
    got = Counter((r.shard, r.source_rank) for r in slots)
    assert Counter(r.source_rank for r in slots) == {k: n for k, n in enumerate(blocks)}
    assert len({(r.source_rank, r.block) for r in slots}) == sum(blocks)  # one pass uses each block once
    used, over = Counter(), 0
    for (shard, k), n in sorted(drawn.items()):
        kept = max(0, min(n, blocks[k] - used[k]))
        used[k] += n
        over += n - kept
        assert got[shard, k] >= kept
    assert over == sum(got.values()) - sum(min(got[x], drawn.get(x, 0)) for x in got) > 0
    other = Counter((r.shard, r.source_rank) for r in mixing.slot_table(sources, 10, per_shard, 6).collect())
    assert other != got


def test_streams_keep_their_order_as_a_table_grows(spark):
    data = cases.rows()

    def order(rows):
        placed = mixing.mix(cases.frame(spark, rows))[1].filter("doc_id is not null and size > 0").collect()
        return [r.doc_id for r in sorted(placed, key=lambda r: (r.source_rank, r.start)) if r.doc_id <= 1100]

    more = data + [(5000 + k, f"more words {k}", "en", r[3], 1, 0, 0, 0, 0, "", 0) for k, r in enumerate(data)]
    assert order(data) == order(more)


def test_odd_tables(spark):
    check(spark, [])
    check(spark, [(1, None, None, None, 0, 0, 0, 0, 0, "", 0)])
    check(spark, [(k, "w " * k, None, "only", 0, 0, 0, 0, 0, "", 0) for k in range(40)], block_words=16, slots_per_shard=4)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 37, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long"))).collect()]
        assert sorted(got) == list(range(n))


def test_mixed_documents_repeat_whole_rows(spark):
    data = [(k, "w " * (10 + k % 7), "en", "abc"[k % 3], k, 0, 0, 0, 0, "", 0) for k in range(300)]
    docs = cases.frame(spark, data)
    out = mixing.mixed_documents(docs, block_words=64)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(data) and max(got.count(x) for x in set(got)) <= 2
    words = {s: sum(len(r[1].split()) for r in got if r[3] == s) for s in "abc"}
    want = brute_targets({s: sum(len(r[1].split()) for r in data if r[3] == s) for s in "abc"})
    assert all(abs(words[s] - want[s]) < 0.12 * want[s] + 64 for s in "abc")


def test_long_documents_keep_their_share_in_a_skewed_source(spark):
    """Nine sources with weights 5, 2, 1 in turn share 1.5 * 1920000 words: 120000 a unit. Source c (weight 1) has 540000, so that
    2 of 9 are taken; most of them are in documents of 20 blocks, of which 2 of 9 are to stay. The others are taken twice."""
    data = [(k, "w " * (1280 if k < 400 else 14), "en", "c", k, 0, 0, 0, 0, "", 0) for k in range(2400)]
    size = {"a": 300000, "d": 300000, "g": 300000, "b": 120000, "e": 120000, "h": 120000, "f": 60000, "i": 60000}
    for s, n in size.items():
        data += [(10000 + len(data) + k, "w " * 240, "en", s, k, 0, 0, 0, 0, "", 0) for k in range(n // 240)]
    got = mixing.mixed_documents(cases.frame(spark, data), block_words=64).collect()
    words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in "abcdefghi"}
    assert 60 < sum(r.source == "c" and r.doc_id < 400 for r in got) < 120
    assert abs(words.pop("c") - 120000) < 0.15 * 120000
    assert words == {s: 2 * n for s, n in size.items()}


def test_thousands_of_sources(spark):
    """Each slot meets the sources of its cell only; every source gets its target to the word."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 40 AS int)) AS text", "concat('s', id % 3000) AS source")
    slots, placed = mixing.mix(docs, block_words=8, slots_per_shard=64)
    taken = mixing.taken_words(slots, placed, 8)
    totals = taken.join(placed.select("doc_id", "source_rank"), "doc_id").groupBy("source_rank").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(totals) == 3000 and all(r.taken == int(r.target) for r in totals)
