import random

import cases
import numpy as np
import pandas as pd
from sightline.llm import quality_rules as q, queries


def brute(text):
    text = text or ""
    words = cases.WORD.findall(text)
    lines = [x for x in text.split("\n") if cases.WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_upper": sum("A" <= c <= "Z" for c in text), "n_marks": sum(c in "!?" for c in text), "n_distinct_words": len(set(words)), "n_lines": len(lines),
    }


def test_statistics(spark):
    extra = ["a\nb\na\n\na\nb", "x y z x y z x", "a|b #$ <é>", "\n\n", "a\r\nb\r\na\r\nb", "é é é é", "l\n l\nl ", "🙂 🙂 🙂 🙂", "one two\none two"]
    data = [(k, t, None, None, 0, 0, 0, 0, 0, "", 0) for k, t in enumerate(extra)] + [r for r in cases.rows() if r[0] != 1004]
    got = q.statistics(cases.frame(spark, data)).collect()
    want = sorted((str(r[0]), *brute(r[1]).values()) for r in data)
    assert sorted((str(r.doc_id), *[r[c] for c in brute("")]) for r in got) == want
    assert q.statistics(cases.frame(spark, [])).count() == 0


def test_learned_list_tells_held_out_rows(spark):
    rng = random.Random(5)
    data, labels = [], []
    for k in range(900):
        text = cases.prose(rng, rng.choice(["en", "de", "fr"]), rng.choice([60, 120]))
        bad = k % 3 == 0
        if bad:
            text = text.upper().replace(" ", "!! ") if k % 2 else " ".join(w + "###" for w in text.split())
        data.append((k, text, "en", "a", 1, 0, 0, 0, 0, "", 0))
        labels.append((k, None if k % 50 == 7 else int(not bad)))
    stats = q.statistics(cases.frame(spark, data))
    rules = q.learn(stats, spark.createDataFrame(labels[:600], "doc_id long, quality int"))
    judged = q.judge(stats, rules).filter("doc_id >= 600").toPandas()
    assert 1 <= len(rules) <= 6
    assert (judged["kept"] == (judged["doc_id"] % 3 != 0)).mean() > 0.97
    x = pd.DataFrame({f: np.where(judged[b] > 0, judged[a] / np.maximum(judged[b], 1), 0.0) for f, (a, b) in q.FEATURES.items()})
    hit = np.any([q._covers(r, x) for r in rules], axis=0)
    assert ((~hit & ~judged["base_failed"]) == judged["kept"]).all()


def test_without_labels_nothing_is_learned(spark):
    stats = q.statistics(cases.frame(spark, cases.rows()))
    for rows in ([], [(1000, None), (None, 0)], [(k, 1) for k in range(50)]):
        assert q.learn(stats, spark.createDataFrame(rows, "doc_id long, quality int")) == []
    judged = q.judge(stats, []).collect()
    assert all(r.kept == (not r.base_failed) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in judged)


def test_implied_tests_are_dropped():
    a, b, c = q.Test("mark_share", True, 0.1), q.Test("mark_share", True, 0.3), q.Test("mark_share", False, 0.9)
    assert q.simplified((a, c, b)) == (b, c) or q.simplified((a, c, b)) == (c, b)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = queries.queries()["op8_quality_rules"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert [r[c] for c in columns] == [want[c] for c in columns]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert any(r.kept for r in got)
