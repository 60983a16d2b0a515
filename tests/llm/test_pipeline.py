import random
from collections import Counter

import cases
import corpus_pipeline
from sightline.llm import language_id, sharding
from test_decontaminate import brute as brute_leaks
from test_language_id import brute_grams
from test_near_dedup import brute as brute_near


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    bench = [(k, cases.prose(rng, "en", 25)) for k in range(4)]
    data = []
    for k in range(150):
        lang = rng.choice(["en", "de", "fr"])
        text = cases.prose(rng, lang, rng.choice([30, 60, 120]))
        if data and k % 6 == 0:
            text = cases.edited(rng, rng.choice(data)[1], rng.choice([0, 1]))
        elif k % 11 == 0:
            text += bench[k % 4][1]
        data.append((k, text, lang, f"s{k % 4}", len(text)))
    data += [(500, None, "en", "s1", 0), (501, "Привет мир как дела сегодня вечером", None, None, 9), (502, "123 456", None, "s0", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())

    langs = {r[0] for r in data if r[1] and any(c.isalpha() for c in r[1]) and r[0] != 501}
    assert {r.doc_id for r in kept[0]} == langs and all(brute_grams(r.text) for r in kept[0])
    after = [r for r in data if r[0] in langs]
    unique = {int(d) for d, _, _, keep in brute_near(after, 5) if keep}
    assert sorted(r.doc_id for r in kept[1]) == sorted(unique) and len(unique) < len(langs)
    rest = [r for r in after if r[0] in unique]
    leaks = {d for d, _ in brute_leaks(rest, bench)}
    assert sorted(r.doc_id for r in kept[2]) == sorted(unique - leaks) and leaks
    times = Counter(r.doc_id for r in kept[3])
    assert set(times) <= unique - leaks and max(times.values()) == 2
    words = Counter()
    for r in kept[3]:
        words[r.source] += len(r.text.split())
    assert words["s0"] > words["s1"] > 0  # weights 5 and 2
    table = sharding.lookup_table(sharding.shard_names(sharding.SHARDS))
    assert Counter(r.doc_id for r in kept[4]) == times and all(r.shard == table[r.slot] for r in kept[4])
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(tuple(r) for r in kept[4])
    assert language_id.TOP == 300


def test_rows_are_judged_by_their_text_and_not_their_id(spark, tmp_path):
    rng = random.Random(3)
    text = [cases.prose(rng, "en", 60) for _ in range(8)]
    passage = cases.prose(rng, "en", 30)
    data = [(1, text[0]), (1, text[1]), (2, text[1]), (None, text[2]), (None, text[0]), (3, text[3]), (3, text[3])]
    data += [(None, text[4] + passage), (4, text[5]), (4, text[6] + passage)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got == Counter([(1, text[0]), (1, text[1]), (None, text[2]), (3, text[3]), *data[7:]])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.decontaminate_documents(spark, docs, str(tmp_path)).collect())
    assert got == Counter([*data[:7], data[8]])
    # one source of weight 5 and 1.5 times its words: each row stays once or twice, with or without an id
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect())
    assert set(got) == set(data)


def test_odd_tables_pass_all_stages(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, a long text and columns with the names that stages use inside; then no rows at all."""
    rng = random.Random(4)
    spark.createDataFrame([(1, cases.prose(rng, "en", 30)), (2, None), (None, "tiny item of text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, group string, first int, mixed string, times int, turn int, slot int, shard int, size long"
    rows = [(k if k % 7 else None, cases.prose(rng, "en" if k % 2 else "de", 40), ("en" if k % 2 else "de") if k % 5 else None, f"s{k % 3}" if k % 4 else None, k, *[None if k % 6 == 0 else v for v in (1, "g", 2, "m", 3, 4, 5, 6, 7)]) for k in range(40)]
    rows += [(100, None, *[None] * 12), (101, "", *[None] * 12), (None, None, *[None] * 12), rows[3], rows[3], rows[0], (102, cases.prose(rng, "en", 6000), "en", "s1", *[None] * 10)]
    for data in (rows, []):
        docs = first = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert sorted(out.columns) == sorted(docs.columns) and out.columns[: len(docs.columns) - 2 * (name == "sharding")] == [c for c in docs.columns if name != "sharding" or c not in ("slot", "shard")]
            folder = f"{tmp_path}/odd-{len(data)}-{name}"
            out.write.parquet(folder)
            docs = spark.read.parquet(folder)
        got = docs.collect()
        assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in first.collect()} and bool(got) == bool(data)
        assert not data or {r.doc_id for r in got} > {None, 102}
