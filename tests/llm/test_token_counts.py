import random

import cases
from pyspark.sql import functions as F
from sightline.llm import queries, token_counts as tc

PARTS = ["the", "a", " ", "  ", "\n", "\n\n", " \t", "'s", "'ll", "é", "ß", "12", "!?", "x", "...", "日本", " ", "🙂"]


def apply(text, edits):
    for start, stop, insert in edits:
        start = min(max(start, 0), len(text))
        text = text[:start] + insert + text[max(min(stop, len(text)), start) :]
    return text


def test_tree_equals_full_encoding_after_edits():
    rng, count = random.Random(1), tc.counter(tc.read_vocabulary(tc.VOCABULARY))
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 30, 300])))
        tree = tc.TokenTree(text, count, leaf=rng.choice([1, 2, 4, 16]))
        for _ in range(6):
            start = rng.randrange(len(text) + 3)
            edit = (start, start + rng.choice([0, 0, 1, 3, 20, 200]), "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 2, 5, 40]))))
            tree.edit(*edit)
            text = apply(text, [edit])
            assert tree.text == text and tree.chars[1] == len(text)
            assert tree.n_tokens() == sum(map(count, tc.SPLIT.findall(text)))


def test_only_regions_near_edits_are_encoded_again():
    count = tc.counter(tc.read_vocabulary(tc.VOCABULARY))
    tree = tc.TokenTree(cases.prose(random.Random(2), "en", 20000), count)
    tree.reencoded = 0
    tree.edit(60000, 60003, "new words")
    assert 0 < tree.reencoded < 2000


def test_table(spark):
    rng = random.Random(6)
    data = cases.rows()
    edits = [(r[0], k, rng.randrange(50), rng.randrange(80), rng.choice(["", "put in", None])) for r in data if r[0] is not None for k in range(rng.randrange(3))]
    edits += [(None, 0, 1, 2, "x"), (1000, 5, None, None, "from null"), (5555, 0, 0, 0, "no such document")]
    docs = tc.attach_edits(cases.frame(spark, data), spark.createDataFrame(edits, "doc_id long, seq int, start long, stop long, insert string"))
    count = tc.counter(tc.read_vocabulary(tc.VOCABULARY))
    full = lambda t: sum(map(count, tc.SPLIT.findall(t)))
    by = {}
    for d, s, a, b, t in edits:
        by.setdefault(d, []).append((s, a is not None, a or 0, b is not None, b or 0, t is not None, t or ""))
    want = []
    for r in data:
        own = [(a, b if has else a, t) for _, _, a, has, b, _, t in sorted(by.get(r[0], []))] if r[0] is not None else []
        want.append((str(r[0]), full(r[1] or ""), full(apply(r[1] or "", own))))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_tokens_edited) for r in tc.count_tokens(docs).collect()) == sorted(want)
    none = cases.frame(spark, []).withColumn("edits", F.lit(None).cast("array<struct<start:long,stop:long,insert:string>>"))
    assert tc.count_tokens(none).count() == 0


def test_edits_work_on_kept_leaves(spark):
    """A leaf far from the edit that is kept wrongly stays wrong: only the leaves by the edit are counted again."""
    text = cases.prose(random.Random(3), "en", 5000)
    docs = cases.frame(spark, [(1, text, "en", "a", 1, 0, 0, 0, 0, "", 0), (2, text, "en", "a", 1, 0, 0, 0, 0, "", 0)])
    edits = spark.createDataFrame([(1, 0, 900, 905, "put in"), (1, 1, 40, 41, " x"), (2, 0, 900, 905, "put in")], "doc_id long, seq int, start long, stop long, insert string")
    trees = tc.token_trees(tc.attach_edits(docs, edits))
    count = tc.counter(tc.read_vocabulary(tc.VOCABULARY))
    full = lambda t: sum(map(count, tc.SPLIT.findall(t)))
    once, twice = apply(text, [(900, 905, "put in")]), apply(text, [(900, 905, "put in"), (40, 41, " x")])
    got = {r.doc_id: r for r in tc.edit_trees(trees).collect()}
    assert [got[k].n_tokens for k in (1, 2)] == [full(text)] * 2 and [got[k].n_tokens_edited for k in (1, 2)] == [full(twice), full(once)]
    assert got[1].text == twice and sum(got[1].leaf_chars) == len(twice) and all(0 < got[k].n_chars_reencoded < 2000 for k in (1, 2))
    wrong = trees.withColumn("leaf_tokens", F.concat(F.slice("leaf_tokens", 1, F.size("leaf_tokens") - 1), F.array(F.element_at("leaf_tokens", -1) + 1000)))
    assert [r.n_tokens_edited for r in tc.edit_trees(wrong).orderBy("doc_id").collect()] == [full(twice) + 1000, full(once) + 1000]
    again = tc.edit_trees(tc.edit_trees(trees.filter("doc_id = 2")).join(edits.filter("seq = 1").select(F.array(F.struct("start", "stop", "insert")).alias("edits"))))
    assert [(r.n_tokens, r.n_tokens_edited) for r in again.collect()] == [(full(once), full(twice))]


def test_giant_pre_token():
    count = tc.counter(tc.read_vocabulary(tc.VOCABULARY))
    tree = tc.TokenTree("x" * 60000 + " end", count)
    tree.edit(60001, 60002, "E")
    assert tree.n_tokens() == sum(map(count, tc.SPLIT.findall(tree.text)))


def test_query_equals_full_encoding(spark):
    """The edits of the query, made again by hand, and every text encoded in full."""
    folder = "/root/testdata/sf0.001"
    count = tc.counter(tc.read_vocabulary(tc.VOCABULARY))
    full = lambda t: sum(map(count, tc.SPLIT.findall(t)))
    place = F.pmod(F.xxhash64("doc_id"), F.length("text") + 1)
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").withColumns({"place": place, "cut": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(13))}).collect():
        text, edited = r.text or "", r.text or ""
        edited = apply(edited, [(r.place or 0, (r.place or 0) + (r.cut if r.place is not None else 0), " a revised phrase,")])
        want.append((r.doc_id, full(text), full(edited + "\n" + (r.source or ""))))
    got = queries.queries()["op7_token_counts"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in got) == sorted(want)
