"""Token ids in raw files, with keyed access through a minimal perfect hash index.

``write_ids`` sorts the documents by doc_id and writes two files a shard, through Spark's own writers, so that any store works and
lost tasks are written again: ``kind=ids`` holds the ids of the shard's documents and nothing else, as little-endian integers of two
bytes (four for larger vocabularies), each document ended by the end id; ``kind=docs`` holds HEADER, then the doc_ids (int64), null flags
(a byte each) and lengths with the end id (uint32) of the same documents, and one more end id. A row of Spark's text writer ends with a
separator; the separator here is the end id, which makes the text file a raw one.

``build_index`` reads only the small files. Keys are (doc_id, nth), nth counting the documents of one doc_id from 0. They are hashed
to buckets of a bounded size, and each bucket gets a minimal perfect hash of levels of bits: a key sits at the first level where no
other key of the bucket has its bit, and the number of set bits before it is its slot. Slots hold a fingerprint (doc_id through a
bijection, and nth, so that no absent key is taken for another), the shard and the place in it. ``lookup`` finds keys in constant time each,
``fetch`` reads their ids from the raw files.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sightline.llm.common import MIX1, MIX2, mix64, release, shared_folder, slices, text_buffers

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SHARD_BYTES = 16 << 20  # of text
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20  # of text, encoded at once
KEYS_PER_BUCKET = 1 << 14
CACHE, LONG = 1 << 19, 48
HEADER = "<8sIIQQ"  # magic, bytes of an id, shard, documents, ids
MAGIC = b"TOKIDS01"
GAMMA = 2  # bits of a level by keys that reach it

# A pre-token of byte-level vocabularies never holds white space after another character, so texts can be cut here.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
PUNCTUATION = ".,;:!?"
LINE = "\x00"
FEED = "\u010a"  # a line feed, as byte-level vocabularies write it


class Encoder:
    """Ids of whole texts as bytes. A text is cut before white space, where no pre-token can go on; plain words are told apart from what follows
    them, and their ids are kept, in two generations of a bounded size of which the older is dropped.

    Pieces are named so that most are parts of the text as they are: " " and a string is that string, LINE and a string is that string after a
    line feed, any other name is that string after a space."""

    def __init__(self, model: bytes, width: str):
        import tokenizers

        self.width, self.known, self.older, self.tails = width, {" ": b""}, {}, {}
        self.whole = tokenizers.Tokenizer.from_buffer(model)
        # a plain word is one pre-token, so many of them, one a line, need no pattern; a line feed stays with the word before it, and the model has no piece of both
        self.words = tokenizers.Tokenizer(self.whole.model)
        self.words.normalizer = tokenizers.normalizers.ByteLevel()
        self.words.pre_tokenizer = tokenizers.pre_tokenizers.Split(FEED, "merged_with_previous")
        (self.line,) = self.whole.encode("\n", add_special_tokens=False).ids
        self.feed = self._ids(["\n"])[0]

    def _ids(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.width).tobytes() for e in self.whole.encode_batch_fast(strings, add_special_tokens=False)]

    def _line_ids(self, tokenizer, strings: list[str]) -> list[bytes]:
        """Ids of strings without white space, but for a space before them; many go to the tokenizer at once, one a line."""
        size, out = int(self.width[2]), []
        for k in range(0, len(strings), 128):
            some = strings[k : k + 128]
            ids = np.array(tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, dtype=self.width)
            data, ends = ids.tobytes(), [*(size * np.flatnonzero(ids == self.line)).tolist(), size * len(ids)]
            if len(ends) == len(some):
                out += [data[begin:end] for begin, end in zip([0, *(e + size for e in ends[:-1])], ends, strict=True)]
            else:  # a vocabulary with pieces of a letter and a line feed
                out += self._ids(some)
        return out

    def _word_ids(self, strings: list[str]) -> list[bytes]:
        """Ids of plain words, each with or without a space before it."""
        return self._line_ids(self.words, strings)

    def _other_ids(self, strings: list[str]) -> list[bytes]:
        lines = [k for k, s in enumerate(strings) if len(s) <= LONG and s.split() == [s.removeprefix(" ")]]
        out = dict(zip(lines, self._line_ids(self.whole, [strings[k] for k in lines]), strict=True))
        alone = [k for k in range(len(strings)) if k not in out]
        out.update(zip(alone, self._ids([strings[k] for k in alone]), strict=True))
        return [out[k] for k in range(len(strings))]

    def _learn(self, names: set[str]) -> list[str]:
        """Puts the ids of the pieces into ``known``; gives the long ones among them."""
        known, older, tailed, lines, words, rest = self.known, self.older, [], [], [], []
        for name in names:
            if name in older:
                known[name] = older[name]
                continue
            if name.isalpha() and len(name) < LONG:  # most are plain words, or such with punctuation
                words.append(name)
                continue
            word = name.rstrip(PUNCTUATION)
            if len(word) < len(name) and word[word[:1] in (" ", LINE) :].isalpha():
                tailed.append((name, word))
            else:
                word = name
            if word[0] == LINE:
                lines.append(word)
                word = " " + word[1:]
            if word not in known:
                string = word[1:] if word[0] == " " else " " + word
                (words if len(string) <= LONG and string[string[0] == " " :].isalpha() else rest).append(word)
        for names_, ids in ((words, self._word_ids), (rest, self._other_ids)):
            names_ = list(dict.fromkeys(names_))
            known.update(zip(names_, ids([n[1:] if n[0] == " " else " " + n for n in names_]), strict=True))
        for name in lines:
            known[name] = self.feed + known[" " + name[1:]]
        for name, word in tailed:
            tail = name[len(word) :]
            if tail not in self.tails:
                if len(self.tails) > CACHE >> 4:
                    self.tails.clear()
                self.tails[tail] = self._ids([tail])[0]
            known[name] = known[word] + self.tails[tail]
        return [n for n in (*names, *rest, *lines) if len(n) > LONG]

    def _slow(self, text: str) -> list[str]:
        """The pieces of any text."""
        name = lambda p: p[1:] if p[0] == " " and p[1:2] not in ("", " ", LINE) and not p[1].isspace() else " " + p
        return [name(p) for p in CUT.split(text) if p]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The distinct pieces of all texts are looked up, and new ones learned; Arrow splits the texts, numbers the pieces and puts their ids in place."""
        if not len(texts):
            return []
        if len(self.known) > CACHE:
            self.known, self.older = {" ": b""}, self.known
        known, column = self.known, pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        rows = pc.split_pattern(pc.replace_substring(column, "\n", " " + LINE), " ")
        ends = rows.offsets.to_numpy().astype(np.int64)
        pieces, ends = rows.values.dictionary_encode(), ends - ends[0]
        names, codes = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy().copy()
        named: dict[str, int] = {}
        for begin, end in zip(ends[:-1].tolist(), (ends[1:] - 1).tolist(), strict=True):
            if not (first := names[codes[begin]]).startswith(LINE):
                codes[begin] = named.setdefault(" " + first, len(names) + len(named))
            if codes[end] < len(names) and names[codes[end]] == LINE:
                codes[end] = named.setdefault(" \n", len(names) + len(named))
        names += named
        ids = list(map(known.get, names))
        used = np.zeros(len(names), dtype=bool)
        used[codes] = True
        gaps = [k for k, (found, asked) in enumerate(zip(ids, used.tolist(), strict=True)) if found is None and asked]
        # a part that is empty, or ends with white space, does not end where a pre-token ends
        odd = [k for k in gaps if not (p := names[k]) or p == LINE or (p[-1].isspace() and p != " \n")]
        new = {names[k] for k in gaps}.difference(names[k] for k in odd)
        slow = pc.match_substring(column, LINE).to_numpy(zero_copy_only=False)
        if odd:
            strange = np.zeros(len(names), dtype=bool)
            strange[odd] = True
            slow[np.searchsorted(ends, np.flatnonzero(strange[codes]), side="right") - 1] = True
        others = {k: self._slow(column[k].as_py()) for k in np.flatnonzero(slow).tolist()}
        new.update(p for row in others.values() for p in row if p not in known)
        long = self._learn(new)
        for k in gaps:
            ids[k] = known.get(names[k])
        data = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        stops = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset + ends]
        joined = memoryview(data.buffers()[2] or b"")
        out = [bytes(joined[begin:end]) for begin, end in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        for k, row in others.items():
            out[k] = b"".join(map(known.__getitem__, row))
        for name in long:
            known.pop(name, None)
        return out


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder(model: bytes, width: str) -> Encoder:
    """The encoder of this Python worker, which lives for many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    key = (hash(model), width)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, width)
    return _ENCODERS[key]


@dataclass(frozen=True)
class TokenFiles:
    """The folder of the files (there is none for an empty table), the bytes of one id in them, the end id, and the number of documents."""

    folder: str
    width: int
    end_id: int
    n_docs: int


def write_ids(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> TokenFiles:
    """Encodes every whole text without special tokens, adds ``end_id``, and writes the files in ascending doc_id order.

    Null and empty texts give the end id alone; null doc_ids come last; equal doc_ids are ordered by two hashes of the text, so that reruns agree
    and one id of very many rows is spread over shards; long texts are encoded whole; extra columns are ignored; an empty table gives no shards.
    The tokenizer is a file of fixed size, which is broadcast.
    """
    import tokenizers

    spark = docs.sparkSession
    with open(tokenizer_path or public_tokenizers.path(TOKENIZER), "rb") as f:
        model = f.read()
    size = max(tokenizers.Tokenizer.from_buffer(model).get_vocab_size(), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, n_docs = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.crc32(F.col("text").cast("binary"))]
    sorted_rows = rows.repartitionByRange(max(1, -(-total // shard_bytes)), *order).sortWithinPartitions(*order)
    shared, code = spark.sparkContext.broadcast(model), f"<u{width}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(shared.value, code), end_id.to_bytes(width, "little")
        ids, nulls, counts, block, blocks, held = [], [], [], [], 0, 0
        row = lambda kind, n, data: pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["kind", "block", "value"])
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for start, stop in slices(text_buffers(texts)[1], SLICE_BYTES):
                gc.disable()  # a batch makes many lists and no cycles
                encoded = coder.encode(texts.slice(start, stop - start).fill_null(""))
                gc.enable()
                ids.append(keys.slice(start, stop - start).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(keys.slice(start, stop - start).is_null().to_numpy(zero_copy_only=False).astype("u1"))
                counts.append(np.array([len(e) // width + 1 for e in encoded], dtype="<u4"))
                for e in encoded:
                    block.append(e)
                    held += len(e) + width
                    if held >= BLOCK_BYTES:
                        yield row("ids", blocks, end.join(block))
                        block, blocks, held = [], blocks + 1, 0
        if block:
            yield row("ids", blocks, end.join(block))
        if ids:
            n = np.concatenate(counts)
            head = struct.pack(HEADER, MAGIC, width, TaskContext.get().partitionId(), len(n), int(n.sum(dtype=np.int64)))
            yield row("docs", 0, head + np.concatenate(ids).tobytes() + np.concatenate(nulls).tobytes() + n.tobytes())
        release()

    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    files = sorted_rows.mapInArrow(encode, "kind string, block long, value binary").sortWithinPartitions("kind", "block")
    separator = {"lineSep": end_id.to_bytes(width, "little").decode("latin-1"), "encoding": "ISO-8859-1"}
    files.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").options(**separator).text(folder)
    return TokenFiles(folder, width, end_id, n_docs)


def _shard() -> F.Column:
    return F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int")


def _files(spark: SparkSession, files: TokenFiles, kind: str) -> DataFrame:
    """shard, content. A shard's two files come from one task and have its number in their names."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.read.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    return reader.load(f"{files.folder}/kind={kind}").filter("length > 0").select(_shard().alias("shard"), "content")


DOCS = "doc_id long, shard int, seq long, offset long, n_tokens long"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, doc_ids, null flags, lengths, seq) of each docs file; seq counts the documents of one id in the shard."""
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_buffer()
            magic, width, written, n, total = struct.unpack_from(HEADER, data)
            at = struct.calcsize(HEADER)
            ids, nulls = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "u1", n, at + 8 * n).astype(bool)
            counts = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
            if magic != MAGIC or written != shard or at + 13 * n + width != data.size or counts.sum() != total:
                raise ValueError(f"shard {shard} has a damaged table of documents")
            new = np.ones(n, dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])
            first = np.flatnonzero(new)
            yield shard, ids, nulls, counts, np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, ids, nulls, counts, seq in _tables(batches):
        columns = [pa.array(ids, mask=nulls), pa.array(np.full(len(ids), shard, dtype=np.int32)), pa.array(seq), pa.array(np.cumsum(counts) - counts), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "seq", "offset", "n_tokens"])


SHARDS = "shard int, n_docs long, n_ids long, first_id long, last_id long, n_last long"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, ids, nulls, counts, seq in _tables(batches):
        end = lambda k, nulls=nulls, ids=ids: None if nulls[k] else int(ids[k])
        values = [shard, len(ids), int(counts.sum()), end(0), end(-1), int(seq[-1]) + 1]
        types = [pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["shard", "n_docs", "n_ids", "first_id", "last_id", "n_last"])


def shard_table(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row a shard: shard, n_docs, first_start (ids in the shards before), first_id, carry (documents of first_id in them)."""
    shards = _files(spark, files, "docs").mapInArrow(_shards, SHARDS)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ends = shards.select("shard", F.col("last_id").alias("id"), F.col("n_last").alias("n"), F.lit(1).alias("order"))
    begins = shards.select("shard", F.col("first_id").alias("id"), F.lit(0).alias("n"), F.lit(0).alias("order"))
    by_id = Window.partitionBy("id").orderBy("shard", "order").rowsBetween(Window.unboundedPreceding, -1)
    carry = begins.unionByName(ends).withColumn("carry", F.coalesce(F.sum("n").over(by_id), F.lit(0))).filter("order = 0").select("shard", "carry")
    starts = shards.select("shard", "n_docs", "first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_start"))
    return starts.join(carry, "shard")


def documents_of(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, nth, shard, offset (ids before it in the shard), start (ids before it in all shards), n_tokens of each document, from the small files."""
    docs = _files(spark, files, "docs").mapInArrow(_documents, DOCS)
    found = docs.join(shard_table(spark, files), "shard")
    nth = F.col("seq") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("carry")).otherwise(0)
    return found.select("doc_id", nth.alias("nth"), "shard", "offset", (F.col("first_start") + F.col("offset")).alias("start"), "n_tokens")


def _words(doc_id: pa.Array, nth: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys as two unsigned words: the id, and nth with a bit for a null id."""
    null = doc_id.is_null().to_numpy(zero_copy_only=False)
    return doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), (nth.to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(1)) | null.astype(np.uint64)


def fingerprint(ids: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    return mix64(ids ^ MIX1)


def _places(ids: np.ndarray, nth: np.ndarray, level: int, bits: int) -> np.ndarray:
    step = np.uint64((level + 1) * int(MIX2) & 0xFFFFFFFFFFFFFFFF)
    return (mix64(mix64(ids + step) ^ (nth * MIX1 + step)) % np.uint64(bits)).astype(np.int64)


def perfect_hash(ids: np.ndarray, nth: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of each level, all bits) of a minimal perfect hash over distinct keys."""
    sizes, levels = [], []
    while len(ids):
        n = max(8, GAMMA * len(ids))
        at = _places(ids, nth, len(sizes), n)
        alone = np.bincount(at, minlength=n) == 1
        sizes.append(n)
        levels.append(alone)
        left = ~alone[at]
        ids, nth = ids[left], nth[left]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=bool)


def slots_of(ids: np.ndarray, nth: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; keys that are not in the hash get -1 or any slot."""
    ranks, out, open_, begin = np.cumsum(bits) - bits, np.full(len(ids), -1), np.arange(len(ids)), 0
    for level, n in enumerate(sizes):
        at = begin + _places(ids[open_], nth[open_], level, n)
        hit = bits[at]
        out[open_[hit]] = ranks[at[hit]]
        open_, begin = open_[~hit], begin + n
    return out


INDEX = "bucket long, sizes array<int>, bits binary, fingerprints binary, nths binary, places binary"
SLOT = np.dtype([("shard", "<i4"), ("offset", "<i8"), ("start", "<i8"), ("n_tokens", "<u4")])


def _build(table: pa.Table) -> pa.Table:
    """The index of one bucket."""
    table = table.combine_chunks()
    column = lambda c: table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c]
    ids, nth = _words(column("doc_id"), column("nth"))
    sizes, bits = perfect_hash(ids, nth)
    order = np.empty(len(ids), dtype=np.int64)
    order[slots_of(ids, nth, sizes, bits)] = np.arange(len(ids))
    places = np.empty(len(ids), dtype=SLOT)
    for c in SLOT.names:
        places[c] = column(c).to_numpy(zero_copy_only=False)[order]
    blobs = [np.packbits(bits), fingerprint(ids)[order].astype("<u8"), nth[order].astype("<u8"), places]
    return pa.table([pa.array([column("bucket")[0].as_py()], pa.int64()), pa.array([sizes], pa.list_(pa.int32())), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["bucket", "sizes", "bits", "fingerprints", "nths", "places"])


@dataclass(frozen=True)
class TokenIndex:
    """The folder of the index and its number of buckets."""

    folder: str
    buckets: int


def build_index(spark: SparkSession, files: TokenFiles, keys_per_bucket: int = KEYS_PER_BUCKET) -> TokenIndex:
    """Hashes all documents of the files, one row of the index a bucket of about ``keys_per_bucket`` documents; the documents of one doc_id are
    spread over buckets like others. Files of an empty table give an index without rows."""
    folder = f"{files.folder}-index"
    if not files.n_docs:
        spark.createDataFrame([], INDEX).write.parquet(folder)
        return TokenIndex(folder, 1)
    buckets = -(-files.n_docs // keys_per_bucket)
    keyed = documents_of(spark, files).withColumn("bucket", bucket_of(buckets))
    keyed.groupBy("bucket").applyInArrow(_build, INDEX).write.parquet(folder)
    return TokenIndex(folder, buckets)


def bucket_of(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.col("nth").cast("long")), F.lit(buckets))


PLACES = "doc_id long, nth long, shard int, offset long, start long, n_tokens long"


def _probe(key: tuple, keys: pa.Table, index: pa.Table) -> pa.Table:
    names = ["doc_id", "nth", *SLOT.names]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    if not index.num_rows or not keys.num_rows:
        return pa.table([pa.array([], t) for t in types], names=names)
    keys = keys.combine_chunks()
    one = lambda c, kind: np.frombuffer(index[c][0].as_buffer(), dtype=kind)
    doc_id, wanted = (keys[c].combine_chunks() if isinstance(keys[c], pa.ChunkedArray) else keys[c] for c in ("doc_id", "nth"))
    ids, nth = _words(doc_id, wanted)
    sizes = index["sizes"][0].as_py()
    slots = slots_of(ids, nth, sizes, np.unpackbits(one("bits", "u1"), count=sum(sizes)).astype(bool))
    found = np.flatnonzero(slots >= 0)
    found = found[(one("fingerprints", "<u8")[slots[found]] == fingerprint(ids[found])) & (one("nths", "<u8")[slots[found]] == nth[found])]
    places = one("places", SLOT)[slots[found]]
    return pa.table([doc_id.take(pa.array(found)), wanted.take(pa.array(found)).cast(pa.int64()), *(pa.array(places[c].copy()).cast(t) for c, t in zip(SLOT.names, types[2:], strict=True))], names=names)


def lookup(keys: DataFrame, index: TokenIndex) -> DataFrame:
    """PLACES of the keys (doc_id, nth) that are in the index, one row for each row of ``keys``; absent keys give none, a null doc_id is a key."""
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("nth").cast("long").alias("nth")).withColumn("bucket", bucket_of(index.buckets))
    table = keys.sparkSession.read.schema(INDEX).parquet(index.folder)
    return wanted.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_probe, PLACES)


def fetch(places: DataFrame, files: TokenFiles) -> DataFrame:
    """doc_id, nth, start, ids (little-endian uint32, the end id last) of the places that ``lookup`` found, read from the raw files. A shard's places and
    its file meet in one task; files without any are not sent."""
    spark = places.sparkSession
    width, end_id = files.width, files.end_id

    def cut(key: tuple, wanted: pa.Table, content: pa.Table) -> pa.Table:
        wanted, got = wanted.combine_chunks(), []
        if wanted.num_rows and content.num_rows:
            ids = np.frombuffer(content["content"][0].as_buffer(), dtype=f"<u{width}")
            got = [ids[o : o + n].astype("<u4") for o, n in zip(wanted["offset"].to_numpy(), wanted["n_tokens"].to_numpy(), strict=True)]
            if any(g[-1] != end_id for g in got):
                raise ValueError("a document of the files does not end with the end id")
        columns = [wanted[c].slice(0, len(got)) for c in ("doc_id", "nth", "start")]
        return pa.table([*columns, pa.array([g.tobytes() for g in got], pa.binary())], names=["doc_id", "nth", "start", "ids"])

    schema = "doc_id long, nth long, start long, ids binary"
    if not files.n_docs:
        return spark.createDataFrame([], schema)
    return places.groupBy("shard").cogroup(_files(spark, files, "ids").groupBy("shard")).applyInArrow(cut, schema)


def keys_of(docs: DataFrame) -> DataFrame:
    """The keys (doc_id, nth) of a table's rows; the rows of one doc_id are counted first and dealt out in parts of 4096."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    parts = counts.select("doc_id", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(4096).cast("long"))).alias("part")).repartition("doc_id", "part")
    return parts.select("doc_id", F.explode(F.sequence("part", F.least(F.col("part") + 4095, F.col("count") - 1))).alias("nth"))
