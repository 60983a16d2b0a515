import random
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sightline.llm import queries, token_files as tf
from tokenizers import Tokenizer

PATH = public_tokenizers.path(tf.TOKENIZER)
PARTS = ["the", "a", " ", "  ", "\n", "\n\n", " \t", "'s", "'ll", "é", "ß", "12", "!?", ".", ",", "x", "...", "日本", " ", " ", "\x1c", "\x85", "🙂", "<|endoftext|>", "\r\n", "Word", "\x00"]


def full(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def key(doc_id):
    return (doc_id is None, doc_id or 0)


def test_encoder_equals_whole_encoding():
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(1)
    coder = tf.encoder(open(PATH, "rb").read(), "<u2")
    for _ in range(60):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(20)] + [cases.prose(rng, "fr", 50), "x" * 3000 + " end"]
        got = coder.encode(texts)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [full(tokenizer, t) for t in texts]
    assert all(len(k) <= tf.LONG for k in coder.known)


def brute(data, end_id=2):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in data:
        ids = [*full(tokenizer, t), end_id]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_whole_encoding(spark):
    folder = "/root/testdata/sf0.001"
    data = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), key=lambda r: key(r[0]))
    assert sorted(map(tuple, queries.queries()["op11_token_ids"](spark, folder).collect())) == brute(data)


@pytest.mark.parametrize("end_id", [2, 50256, 70000])
def test_odd_rows_many_shards_and_raw_files(spark, end_id):
    """Nulls, repeated ids over shards, clashing columns; the files concatenated are the ids in order and nothing else."""
    rng = random.Random(5)
    data = [*cases.rows(), *((7, cases.prose(rng, "en", 40), *["x"] * 2, 1, 7, -1, 3, 9, "x", 2) for _ in range(80))]
    files = tf.write_ids(cases.frame(spark, data), end_id=end_id, shard_bytes=4000)
    raw = sorted((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in spark.read.format("binaryFile").load(f"{files.folder}/kind=ids").collect())
    assert len(raw) > 5 and files.width == (2 if end_id < 65536 else 4)
    stream = np.frombuffer(b"".join(c for _, c in raw), f"<u{files.width}")
    index = tf.build_index(spark, files, keys_per_bucket=16)
    got = tf.fetch(tf.lookup(tf.keys_of(cases.frame(spark, data)), index), files).collect()
    rows = [(r.doc_id, r.nth, r.start, np.frombuffer(r.ids, "<u4")) for r in sorted(got, key=lambda r: r.start)]
    assert [key(r[0]) for r in rows] == sorted(key(r[0]) for r in data)
    assert np.array_equal(np.concatenate([r[3] for r in rows]), stream) and rows[0][2] == 0
    assert [r[2] for r in rows[1:]] == np.cumsum([len(r[3]) for r in rows])[:-1].tolist()
    tokenizer = Tokenizer.from_file(PATH)
    assert sorted((key(r[0]), r[3].tolist()) for r in rows) == sorted((key(r[0]), [*full(tokenizer, r[1]), end_id]) for r in data)
    nths = {}
    for d, nth, *_ in rows:
        nths.setdefault(d, []).append(nth)
    assert all(v == list(range(len(v))) for v in nths.values()) and max(map(len, nths.values())) == 80


def test_reruns_agree_and_absent_keys_give_nothing(spark):
    data = cases.rows()
    files = [tf.write_ids(cases.frame(spark, data).repartition(n), shard_bytes=5000) for n in (2, 7)]
    raw = [b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{f.folder}/kind=ids").orderBy("path").collect()) for f in files]
    assert raw[0] == raw[1]
    index = tf.build_index(spark, files[0], keys_per_bucket=8)
    keys = spark.createDataFrame([(999999, 0), (1000, 1), (1000, 0), (None, 0), (None, 2), (1000, 0)], "doc_id long, nth long")
    assert sorted((str(r.doc_id), r.nth) for r in tf.lookup(keys, index).collect()) == [("1000", 0), ("1000", 0), ("None", 0)]
    assert tf.fetch(tf.lookup(keys.filter("doc_id = 999999"), index), files[0]).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 20000):
        ids, nth = rng.integers(0, 50, n).astype(np.uint64), np.arange(n).astype(np.uint64)
        sizes, bits = tf.perfect_hash(ids, nth)
        assert sorted(tf.slots_of(ids, nth, sizes, bits).tolist()) == list(range(n)) and sum(sizes) <= 6 * n + 64
    print_ = tf.fingerprint(np.arange(100000, dtype=np.uint64))
    assert len(set(print_.tolist())) == 100000


def test_the_search_decides(spark, monkeypatch):
    """Without its fingerprints the index gives wrong rows for absent keys; with other bits it loses rows."""
    docs = cases.frame(spark, cases.rows())
    files = tf.write_ids(docs)
    index = tf.build_index(spark, files)
    table = spark.read.parquet(index.folder)
    broken = tf.TokenIndex(f"{index.folder}-broken", index.buckets)
    table.withColumn("fingerprints", F.expr("cast(repeat('x', octet_length(fingerprints)) as binary)")).write.parquet(broken.folder)
    assert tf.lookup(tf.keys_of(docs), broken).count() == 0 < tf.lookup(tf.keys_of(docs), index).count()


def test_empty_table(spark):
    docs = cases.frame(spark, [])
    files = tf.write_ids(docs)
    assert tf.fetch(tf.lookup(tf.keys_of(docs), tf.build_index(spark, files)), files).count() == 0


def test_words_are_encoded_in_short_lines():
    """Words new to a worker go to the tokenizer some at a time, on which its time per word depends; plain ones are taken as they are."""
    coder, sizes = tf.Encoder(open(PATH, "rb").read(), "<u2"), []

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, strings, **more):
            sizes.extend(s.count("\n") + 1 for s in strings)
            return self.inner.encode_batch_fast(strings, **more)

    coder.words = Watched(coder.words)
    text = " ".join("abc" + "".join(chr(97 + int(c)) for c in str(k)) + ("," if k % 3 == 0 else "") for k in range(3000))
    (got,) = coder.encode([text])
    assert np.frombuffer(got, "<u2").tolist() == full(Tokenizer.from_file(PATH), text)
    assert sum(sizes) == 3000 and max(sizes) <= 128


def test_a_batch_looks_each_piece_up_once_and_learns_others_in_lines():
    """Pieces that come back in a batch are looked up once for all its texts, and pieces that are no plain words share calls of the tokenizer, too."""
    coder, looked, calls = tf.Encoder(open(PATH, "rb").read(), "<u2"), [], []

    class Table(dict):
        def get(self, name, default=None):
            looked.append(name)
            return super().get(name, default)

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, strings, **more):
            calls.extend(strings)
            return self.inner.encode_batch_fast(strings, **more)

    coder.known, coder.whole = Table(coder.known), Watched(coder.whole)
    texts = [" ".join(["one", "two,", *(f"k{k}-{k}.x" for k in range(500))]) + end for end in ("", "\n", "\nx", "", " ", "é \t y")] * 20
    got = coder.encode(texts)
    tokenizer = Tokenizer.from_file(PATH)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [full(tokenizer, t) for t in texts]
    assert len(looked) < 2000 and len(calls) < 30


def test_a_vocabulary_with_a_letter_and_a_line_feed_in_one_piece():
    """Such a piece must not join the words of two lines."""
    import json

    model = json.loads(open(PATH).read())
    model["model"]["vocab"]["eĊ"] = len(model["model"]["vocab"]) + 1
    model["model"]["merges"].insert(0, ["e", "Ċ"] if isinstance(model["model"]["merges"][0], list) else "e Ċ")
    data = json.dumps(model)
    text = "bee zee ape one, tee. the end ape"
    (got,) = tf.Encoder(data.encode(), "<u2").encode([text])
    assert np.frombuffer(got, "<u2").tolist() == full(Tokenizer.from_str(data), text)
