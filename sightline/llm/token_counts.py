"""Edit-aware token counts: a segment tree over each document's pre-tokens.

``token_trees`` encodes each text once and keeps the leaves of its tree, characters and tokens of each, as two columns of the
document's row; written as a table, they are all that later edits need. ``edit_trees`` reads them, never the whole text's tokens.
A leaf covers up to LEAF pre-tokens; a node holds the characters and tokens below it. An edit walks down by characters to the leaves that it
touches, re-splits from the first one (whose matches may have looked ahead into the edit) until a
pre-token ends where an untouched leaf begins, re-encodes only that region, and updates the sums on the way up. Pre-tokens
match left to right and depend on what follows only, so all after such a meeting point is unchanged.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from sightline.llm.common import fresh, materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)
LEAF = 64
LOOK_AHEAD = 2  # a run of white space before a word gives back one character after it has seen the word
CACHE = 1 << 18
LONG = 64  # longer pre-tokens are not kept in the cache, which bounds its bytes
TREE = ["leaf_chars", "leaf_tokens"]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class _Known(dict):
    """Tokens of the pre-tokens seen so far, up to CACHE short ones."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = n
        return n


def counter(vocabulary: bytes) -> Callable[[str], int]:
    """Tokens of one pre-token."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return _Known(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary).__getitem__


def leaves_of(text: str, count: Callable[[str], int], leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(characters, tokens) of the leaves of a text's tree."""
    pieces = SPLIT.findall(text)
    first = np.arange(0, len(pieces), leaf)
    sums = lambda f: np.add.reduceat(np.fromiter(map(f, pieces), dtype=np.int64, count=len(pieces)), first) if pieces else np.zeros(0, dtype=np.int64)
    return sums(len), sums(count)


class TokenTree:
    """Leaves of pre-tokens under a binary tree of (characters, tokens) sums; node k has the children 2k and 2k + 1."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        """The tree over ``leaves``, as ``leaves_of`` gives them; without any, the text is encoded."""
        self.text, self.count, self.leaf, self.reencoded = text, count, leaf, 0
        self._build(*(leaves_of(text, count, leaf) if leaves is None else leaves))

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        chars, tokens = self.chars[self.width :], self.tokens[self.width :]
        return chars[chars > 0], tokens[chars > 0]

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << max(0, (max(len(chars), 1) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.width, dtype=np.int64), np.zeros(2 * self.width, dtype=np.int64)
        self.chars[self.width : self.width + len(chars)], self.tokens[self.width : self.width + len(tokens)] = chars, tokens
        level = self.width
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2

    def _encode(self, text: str, start: int, stop: int, meets: Callable[[int], bool]) -> tuple[list[int], list[int], int]:
        """(characters, tokens) of new leaves from ``start`` until a pre-token ends at ``stop`` or where ``meets`` says so, and that end."""
        chars, tokens, at, leaf_start, n, total = [], [], start, start, 0, 0
        for m in SPLIT.finditer(text, start):
            at = m.end()
            total += self.count(m.group())
            n += 1
            self.reencoded += at - m.start()
            done = at >= stop or meets(at)
            if n == self.leaf or done:
                chars.append(at - leaf_start)
                tokens.append(total)
                leaf_start, n, total = at, 0, 0
            if done:
                break
        return chars, tokens, at

    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``place``."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def _put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more, most = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += most
            node //= 2

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replaces the characters [start, stop) by ``insert``; places beyond the text are its end."""
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        self.text = self.text[:start] + insert + self.text[stop:]
        shift = len(insert) - (stop - start)
        if not size or not self.text:
            self._build(*self._encode(self.text, 0, len(self.text), lambda _: False)[:2])
            return
        first, begin = self._leaf_at(max(start - LOOK_AHEAD, 0))
        # the match that ends at begin may have looked at the edit, so a leaf that begins there hands over to the one before
        while first and begin > start - LOOK_AHEAD:
            first, begin = self._leaf_at(begin - 1)
        leaf, at = first, begin
        while leaf < self.width and at < stop:
            at += int(self.chars[self.width + leaf])
            leaf += 1
        pending = [leaf, at]  # first leaf that begins at or after stop, and where it begins in the old text

        def meets(place: int) -> bool:
            while pending[0] < self.width and pending[1] + shift < place:
                pending[1] += int(self.chars[self.width + pending[0]])
                pending[0] += 1
            return place >= start + len(insert) and pending[1] >= stop and pending[1] + shift == place

        chars, tokens, _ = self._encode(self.text, begin, len(self.text), meets)
        after = pending[0] if self.text and begin + sum(chars) < len(self.text) else self.width
        room = after - first
        if len(chars) > 2 * room:
            old = list(range(self.width))
            c = [int(self.chars[self.width + k]) for k in old[:first]] + chars + [int(self.chars[self.width + k]) for k in old[after:]]
            t = [int(self.tokens[self.width + k]) for k in old[:first]] + tokens + [int(self.tokens[self.width + k]) for k in old[after:]]
            full = [k for k in range(len(c)) if c[k]]
            self._build([c[k] for k in full], [t[k] for k in full])
            return
        if len(chars) > room:  # at most two new leaves share an old one's place
            chars = [sum(chars[k : k + 2]) for k in range(0, len(chars), 2)]
            tokens = [sum(tokens[k : k + 2]) for k in range(0, len(tokens), 2)]
        for k in range(room):
            self._put(first + k, *((chars[k], tokens[k]) if k < len(chars) else (0, 0)))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], pa.int32()))


def token_trees(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """``docs`` with leaf_chars and leaf_tokens, array<int>: the leaves of each whole text's tree (columns of those names are replaced).

    Null and empty texts have no leaves; a pre-token is encoded whole, however long; repeated rows stay; an empty table stays empty. The
    vocabulary is a file of fixed size, which is broadcast.
    """
    docs, shared = docs.drop(*TREE), docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    at, names = docs.columns.index("text"), [*docs.columns, *TREE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for batch in batches:
            leaves = [leaves_of(t or "", count) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists([x[0] for x in leaves]), _lists([x[1] for x in leaves])], names=names)

    schema = StructType([*docs.schema.fields, *(StructField(c, ArrayType(IntegerType())) for c in TREE)])
    return docs.mapInArrow(run, schema)


EDITED = "doc_id long, n_tokens long, n_tokens_edited long, n_chars_reencoded long, text string, leaf_chars array<int>, leaf_tokens array<int>"


def edit_trees(trees: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """EDITED: tokens of each document before and after its edits, how many characters were encoded for them, and the edited text
    with its leaves, to which further edits apply.

    ``trees`` has doc_id, text, leaf_chars, leaf_tokens and edits, array<struct<start long, stop long, insert string>>, applied in
    order, in code points; places beyond the text are its end. Null text or insert is empty, a null start is 0, a null stop is the
    start, a null edit or list changes nothing, null leaves are those of an empty text. Repeated rows stay; other columns are ignored;
    an empty table gives none.
    """
    shared = trees.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, edits, chars, tokens in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                leaves = np.array(chars or [], dtype=np.int64), np.array(tokens or [], dtype=np.int64)
                before, after, encoded = int(leaves[1].sum()), None, 0
                if edits:
                    tree = TokenTree(text or "", count, leaves=leaves)
                    for e in edits:
                        if e is not None:
                            tree.edit(e["start"] or 0, e["stop"] if e["stop"] is not None else e["start"] or 0, e["insert"] or "")
                    text, leaves, after, encoded = tree.text, tree.leaves(), tree.n_tokens(), tree.reencoded
                for column, v in zip(out, (before, before if after is None else after, encoded, text, *leaves), strict=True):
                    column.append(v)
            counts = [pa.array(x, pa.int64()) for x in out[:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(out[3], pa.string()), _lists(out[4]), _lists(out[5])], names=["doc_id", "n_tokens", "n_tokens_edited", "n_chars_reencoded", "text", *TREE])

    return trees.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits", *TREE).mapInArrow(run, EDITED)


def count_tokens(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_reencoded of each whole text and its edits: trees are built and written once, then
    edited. ``docs`` has doc_id, text and edits; for odd input see ``token_trees`` and ``edit_trees``."""
    kept = materialize(token_trees(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits"), vocabulary_path), "token-trees")
    return edit_trees(kept, vocabulary_path).select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_reencoded")


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the column edits, from rows of doc_id, seq, start, stop, insert ordered by seq (then start, stop, insert)."""
    own = fresh(docs.columns, "edited")
    one = F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "insert")
    lists = edits.filter("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("e")))).alias("list"))
    lists = lists.select(F.col("doc_id").alias(own), F.col("list.e").alias("edits"))
    return docs.drop("edits").join(lists, F.col("doc_id") == F.col(own), "left").drop(own)
