import random

import cases
from sightline.llm import decontaminate as dec, queries


def distance(segment, text):
    """Least edits of an occurrence of segment anywhere in text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def norm(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join(cases.WORD.findall(text or "")))


def brute(docs, items, q=12, length=100, error=0.06):
    out = set()
    for item, text in items:
        x = norm(text)
        if not x:
            continue
        starts = sorted({*range(0, max(len(x) - length, 0) + 1, length // 2), max(len(x) - length, 0)})
        parts = [x[a : a + length] for a in starts]
        for r in docs:
            t = norm(r[1])
            for p in parts:
                if distance(p, t) <= (min(int(error * len(p)), (len(p) - q) // q) if len(x) >= q else 0):
                    out.add((r[0], item))
                    break
    return out


def noise(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([[], ["q"], [chars[k], "x"]])
    return "".join(chars)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    items = [(k, cases.prose(rng, rng.choice(["en", "de", "fr"]), rng.choice([4, 10, 30, 45]))) for k in range(8)]
    items += [(100, None), (101, ""), (102, "tiny"), (103, items[0][1])]
    data = []
    for k in range(36):
        text = cases.prose(rng, "en", 15)
        if k % 2:
            leak = items[k % 8][1]
            text += (noise(rng, leak, rng.choice([0, 1, 3, 6, 12])) if k % 4 == 1 else leak.upper().replace(" ", "\n\n")) + cases.prose(rng, "de", 10)
        data.append((k, text, "en", "a", 1, 0, 0, 0, 0, "", 0))
    data += [(90, None, "en", "a", 1, 0, 0, 0, 0, "", 0), (91, "", "en", "a", 1, 0, 0, 0, 0, "", 0), (92, "this is tiny", "en", "a", 1, 0, 0, 0, 0, "", 0), data[1], (None, "tiny", "en", "a", 1, 0, 0, 0, 0, "", 0)]
    docs, bench = cases.frame(spark, data), spark.createDataFrame(items, "item_id long, text string")
    got = dec.leaks(docs, bench, block_chars=400).collect()
    want = brute(data, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 12
    by = {r[0]: r[1] for r in data}
    for r in got:
        if r.edits == 0 and r.item_id == 102:
            assert norm(by[r.doc_id][r.start : r.stop]) == "tiny"
    kept = dec.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in data if r[0] is None or not any(d == r[0] for d, _ in want))


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a passage that is long enough to be found")], "item_id long, text string")
    assert dec.leaks(cases.frame(spark, []), bench).count() == 0
    assert dec.leaks(cases.frame(spark, cases.rows()), bench.limit(0)).count() == 0


def test_alignment_equals_full_table():
    import numpy as np

    rng = random.Random(1)
    for _ in range(400):
        segment = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 16)))
        region = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 24)))
        most = rng.randrange(5)
        codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (segment, region)]
        got, want = dec.band_align(*codes, most), distance(segment, region)
        assert (got is None) == (want > most) and (got is None or got[0] == want)


def test_upper_case_beyond_ascii(spark):
    """Each passage has more than six letters beyond ASCII in any 100 characters; all are in the text in upper case."""
    items = [
        (1, "l'élève a préféré répéter la leçon où être très zélé à l'école était la clé révélée"),
        (2, "el niño soñó que mañana el señor español añadía más leña, así él también podrá irse"),
        (3, "die große straße heißt müßig, weiß und süß; äußerst böse grüße aus der schönen größe"),
        (4, "привет мир как дела сегодня вечером мы пойдем гулять в старый парк у большой реки"),
    ]
    data = [(k, "Before it: " + t.upper() + " and then more", "en", "a", 1, 0, 0, 0, 0, "", 0) for k, t in items]
    data.append((9, "nothing of the sort is in this text, which is long enough to be one of the documents", "en", "a", 1, 0, 0, 0, 0, "", 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in dec.leaks(cases.frame(spark, data), bench).collect())
    assert got == [(k, k, 11, 11 + len(t.upper()), 0) for k, t in items]


def test_excerpts_of_long_items_at_any_place(spark):
    """Excerpts of 60 to 140 characters from anywhere in items of several hundred, each in a document of its own; 3 edits are spread
    over the longer ones. What is copied is known, so segments play no part in the expected result."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(90))) for k in range(6)]
    data, want = [], set()
    for k in range(120):
        item, text = items[k % 6]
        n = (60, 80, 100, 120, 140)[k % 5]
        a = rng.randrange(len(text) - n)
        part = text[a : a + n]
        if n >= 100:
            part = "".join("#" if c in (n // 5, n // 2, n - n // 5) else d for c, d in enumerate(part))
        around = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(2)]
        data.append((k, around[0] + " " + part + " " + around[1], "en", "a", 1, 0, 0, 0, 0, "", 0))
        want.add((k, item))
    data += [(200 + k, " ".join(rng.choice(words) for _ in range(90)), "en", "a", 1, 0, 0, 0, 0, "", 0) for k in range(40)]
    got = dec.leaks(cases.frame(spark, data), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_short_items_are_found_as_they_are(spark):
    items = [(1, "ab"), (2, "a b"), (3, "AB"), (4, "xyzw"), (5, "b"), (6, "\u00e9t\u00e9")]
    texts = ["ab", "a  B", "cab", "no", None, "", "x yzw", "XYZW ab", "l'\u00c9T\u00c9", "yab b xyzw"]
    docs = cases.frame(spark, [(k, t, "en", "a", 1, 0, 0, 0, 0, "", 0) for k, t in enumerate(texts)])
    want = {(k, i) for k, t in enumerate(texts) for i, x in items if " ".join(x.split()).lower() in " ".join((t or "").split()).lower()}
    for block_chars in (3, 1000):
        got = [(r.doc_id, r.item_id) for r in dec.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_query_finds_every_whole_item_and_nothing_unlike(spark):
    """Whole items by plain search; each leak of the query is aligned again in full."""
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: norm(r.text).casefold() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in queries.queries()["op1_decontamination"](spark, folder).collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x and x in norm(t).casefold()}
    assert whole and whole <= set(got)
    for (d, i), r in got.items():
        found = norm(docs[d][r.start : r.stop]).casefold().strip()
        parts = [items[i][a : a + 50] for a in range(0, max(len(items[i]) - 50, 0) + 1)]
        assert any(p in found or found in p for p in parts) or min(distance(p, found) for p in parts) <= 3
