"""Near-duplicate detection by a chosen-path set similarity join.

Each document is a set of hashed word shingles. In each of ``TREES`` independent trees a document walks down a path: at each node
it takes its minwise shingle under the hash of that node. Two documents stay together at a node with the
probability of their similarity, so a pair of similarity s shares a node at depth d with probability s ** d; trees are
repeated until 1 - (1 - s ** d) ** TREES is the recall wanted at the threshold. Nodes are looked at from depth ``LEVELS[0]`` on,
where unrelated documents hardly meet: all pairs of a node there are compared, whatever its size. A node of more than ``LEAF``
documents also branches on to the next level, whose smaller nodes link most of its near copies beforehand.

Documents with the same set are one class before all this. Each member of a node is first confirmed against the node's
least member; the components of these links then leave only pairs between different components to compare, pair by pair in small
nodes and in blocks of members in large ones, so no link between two components is lost in a node. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from sightline.llm.common import MIX1, MIX2, fresh, materialize, mix64, row_key, slices, text_buffers, window_hashes, words_of
from sightline.llm.components import components

TREES = 32
LEVELS = (5, 7)
LEAF = 32
PER_SALT = 2000
BLOCK = 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``size``-word shingles; of the whole sequence if it has fewer words."""
    rows = len(offsets) - 1
    _, _, hashes, row = words_of(data, offsets, fold=True)
    first = np.searchsorted(row, np.arange(rows + 1))
    grams = window_hashes(hashes, size)
    out = []
    for r in range(rows):
        a, b = first[r], first[r + 1]
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(window_hashes(hashes[a:b], int(b - a)) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def chosen_paths(shingles: np.ndarray, trees: int, levels: tuple[int, ...]) -> np.ndarray:
    """Node keys (trees x levels) on a document's way down each tree."""
    keys = mix64(np.arange(1, trees + 1, dtype=np.uint64) * MIX2)
    out = np.empty((trees, len(levels)), dtype=np.uint64)
    for depth in range(1, levels[-1] + 1):
        least = ((shingles[None, :] ^ keys[:, None]) * MIX1).argmin(axis=1)
        keys = mix64(keys ^ mix64(shingles[least]))
        if depth in levels:
            out[:, levels.index(depth)] = keys
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _summarize(size: int, trees: int, levels: tuple[int, ...]):
    width = trees * len(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            n, keys, ends, paths = [], [], [0], []
            for a, b in slices(offsets):
                for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size):
                    n.append(len(s))
                    keys.append((mix64(s).sum(dtype=np.uint64), mix64(s ^ MIX2).sum(dtype=np.uint64)))
                    if len(s):
                        paths.append(chosen_paths(s, trees, levels).ravel())
                    ends.append(ends[-1] + (width if len(s) else 0))
            both = _signed(np.array(keys, dtype=np.uint64).reshape(-1, 2))
            flat = _signed(np.concatenate(paths)) if paths else np.zeros(0, dtype=np.int64)
            path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), path], names=["doc_id", "n_shingles", "k1", "k2", "paths"])

    return run


def summaries(docs: DataFrame, size: int, trees: int = TREES, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    fields = "doc_id long, n_shingles long, k1 long, k2 long, paths array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_summarize(size, trees, levels), fields)


def _nodes(classes: DataFrame, trees: int, levels: tuple[int, ...], leaf: int) -> DataFrame:
    """(node, rep, n, compared): the nodes with company that each class passes on its way down; those of the first level, which
    hold all pairs of the later ones, are to be compared in full."""
    width = len(levels)
    path = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("paths", t * width + 1, width))).alias("path")
    live, out = classes.select("rep", "n", path), []
    for k in range(width):
        here = live.withColumn("node", F.col("path")[k])
        sizes = here.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        here = here.join(sizes, "node")
        if k < width - 1:
            here = materialize(here.select("node", "rep", "n", "path", "size"), "near-level")
            live = here.filter(F.col("size") > leaf).select("rep", "n", "path")
        out.append(here.select("node", "rep", "n", F.lit(k == 0).alias("compared")))
    return reduce(DataFrame.unionByName, out)


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of their union; empty sets share nothing."""
    small, large = (s, t) if len(s) < len(t) else (t, s)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def _compare(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bases = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            groups, salts, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            later = batch.column(4).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(3))
            for a, b in slices(offsets):
                for r, s in enumerate(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size), a):
                    if (groups[r], salts[r]) != group:
                        group, bases = (groups[r], salts[r]), []
                    if not later[r]:  # the group's own text, or texts, come first
                        bases.append(s)
                    elif any(similar(s, base, percent) for base in bases):
                        found.append((int(groups[r]), int(ids[r])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. All b of one a meet its text in sorted order; an a with more
    than PER_SALT of them is split into as many salted groups as it needs."""
    own = pairs.groupBy("a").agg(F.count("*").alias("size"))
    salts = F.floor(F.col("size") / PER_SALT).cast("int")
    members = pairs.join(own.select("a", salts.alias("salts")), "a")
    members = members.select("a", F.pmod(F.xxhash64("b"), F.col("salts") + 1).cast("int").alias("salt"), F.col("b").alias("doc"))
    bases = own.select("a", F.explode(F.sequence(F.lit(0), salts)).alias("salt"), F.col("a").alias("doc"))
    both = members.withColumn("later", F.lit(1)).unionByName(bases.withColumn("later", F.lit(0)))
    rows = both.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("a", "salt", "doc", "text", "later")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "later", "doc").select("a", "salt", "doc", "text", "later")
    return rows.mapInArrow(_compare(size, percent), "a long, b long")


def _open_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, rep, n, c, size): members, with component, of the first-level nodes that hold several components."""
    placed = nodes.filter("compared").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", "n", F.coalesce("component", "rep").alias("c"))
    split = placed.groupBy("node").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).filter("c0 < c1")
    return placed.join(split.select("node", "size"), "node")


class _Block:
    """Sets of the members of one block, found by shingle."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.reps: list[int] = []
        self.components: list[int] = []
        self.ready = False

    def add(self, s: np.ndarray, rep: int, component: int) -> None:
        self.sets.append(s)
        self.reps.append(rep)
        self.components.append(component)

    def similar(self, s: np.ndarray, component: int, percent: int) -> list[int]:
        """Members of other components whose sets are similar enough to ``s``."""
        if not self.ready:
            every = np.concatenate(self.sets) if self.sets else s[:0]
            owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
            order = np.argsort(every, kind="stable")
            self.owner, self.ready = owner[order], True
            self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
            self.n, self.c = np.array([len(x) for x in self.sets], dtype=np.int64), np.array(self.components, dtype=np.int64)
        if not len(self.keys):
            return []
        k = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        k = k[self.keys[k] == s]
        n = self.count[k]
        post = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(k) else k
        shared = np.bincount(self.owner[post], minlength=len(self.sets))
        hit = (100 * shared >= percent * (self.n + len(s) - shared)) & (shared > 0) & (self.c != component)
        return [self.reps[i] for i in np.flatnonzero(hit)]


def _compare_blocks(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, _Block()
        for batch in batches:
            found: list[tuple[int, int]] = []
            nodes, parts, sides, reps, components_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            data, offsets = text_buffers(batch.column(5))
            for a, b in slices(offsets):
                for r, s in enumerate(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size), a):
                    if (nodes[r], parts[r]) != group:
                        group, block = (nodes[r], parts[r]), _Block()
                    if sides[r] == 0:  # the block comes first
                        block.add(s, int(reps[r]), int(components_[r]))
                    else:
                        found += [(rep, int(reps[r])) for rep in block.similar(s, components_[r], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def _confirm_in_blocks(placed: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of large nodes, without a row for each pair: the members outside a node's largest component are dealt
    to blocks of about BLOCK, and all members of the node pass by each block."""
    main = placed.groupBy("node", "c").agg(F.count("*").alias("k")).groupBy("node").agg(F.max(F.struct("k", F.col("c").alias("main"))).alias("m"), F.sum("k").alias("all"))
    main = main.select("node", F.col("m.main").alias("main"), F.floor((F.col("all") - F.col("m.k")) / BLOCK).cast("int").alias("last"))
    placed = placed.join(main, "node")
    own = placed.filter("c <> main").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("last") + 1).cast("int")).withColumn("side", F.lit(0))
    passing = placed.withColumn("part", F.explode(F.sequence(F.lit(0), "last"))).withColumn("side", F.lit(1))
    rows = own.unionByName(passing).select("node", "part", "side", "rep", "c")
    rows = rows.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("node", "part", "side", "rep", "c", "text")
    rows = rows.repartition("node", "part").sortWithinPartitions("node", "part", "side", "rep")
    return rows.mapInArrow(_compare_blocks(size, percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = TREES, levels: tuple[int, ...] = LEVELS, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked if 100 * shared >= percent * united shingles; component_id is the least doc_id reachable, kept whether
    that is the document itself. Null and empty texts have no shingles and no links. Rows of one doc_id are one document of
    the graph; a null doc_id stands alone, with a null component, and is kept. Long texts are read whole; ties do not arise, since
    all links count. Other columns are ignored; empty tables give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = materialize(summaries(rows, size, trees, levels), "near-summaries")
    real = known.filter("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("k1", "k2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.any_value("paths").alias("paths"))
    classes = materialize(classes, "near-classes")
    nodes = materialize(_nodes(classes, trees, levels, leaf), "near-nodes")
    # repeated ids with different sets: their classes are linked by the id itself
    several = real.select("doc_id", "k1", "k2", F.col("n_shingles").alias("n")).distinct().join(real.groupBy("doc_id").count().filter("count > 1"), "doc_id")
    same_id = several.join(classes.drop("paths"), ["k1", "k2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    wanted = nodes.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(rows.join(wanted, "doc_id"), "near-texts")
    least = nodes.groupBy("node").agg(F.min(F.struct("rep", "n")).alias("p"))
    close = lambda x, y: (100 * x >= percent * y) & (100 * y >= percent * x)
    first = nodes.join(least, "node").filter((F.col("rep") != F.col("p.rep")) & close(F.col("n"), F.col("p.n")))
    first = materialize(first.select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct(), "near-pairs")
    links = materialize(confirm(first, texts, size, percent), "near-links")
    found = components(links.unionByName(same_id))
    # pairs between components that still share a node
    placed = materialize(_open_nodes(nodes, found), "near-open")
    small = placed.filter(F.col("size") <= leaf)
    x, y = (small.select("node", *[F.col(c).alias(f"{c}{k}") for c in ("rep", "n", "c")]) for k in (0, 1))
    rest = x.join(y, "node").filter((F.col("c0") < F.col("c1")) & close(F.col("n0"), F.col("n1")))
    rest = rest.select(F.least("rep0", "rep1").alias("a"), F.greatest("rep0", "rep1").alias("b")).distinct()
    rest = materialize(rest.join(first, ["a", "b"], "left_anti"), "near-pairs")
    more = confirm(rest, texts, size, percent).unionByName(_confirm_in_blocks(placed.filter(F.col("size") > leaf), texts, size, percent))
    found = components(links.unionByName(same_id).unionByName(more))

    by_class = classes.select("k1", "k2", "n", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = by_class.select("k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("c"))
    alone = known.filter("n_shingles = 0").withColumn("c", F.lit(None).cast("long"))  # they would all meet at one key
    out = known.filter("n_shingles > 0").join(by_class, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", "c").unionByName(alone.select("doc_id", "n_shingles", "c"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, by_row: bool = False, **options) -> DataFrame:
    """``docs`` with the least document of each group of near-duplicates; of a repeated doc_id one row stays (the least text),
    rows with a null doc_id all stay.

    With ``by_row``, each row is a document of its own, whatever its doc_id is: different texts of one doc_id are only compared, null
    doc_ids are, too (they come last in a group), and rows without words all stay.
    """
    rest = [c for c, t in docs.dtypes if c not in ("doc_id", "text") and t[:3] != "map"]
    row, group, nth = (fresh(docs.columns, c) for c in ("row", "group", "first"))
    if by_row:
        keyed = docs.withColumn(row, row_key("doc_id", "text"))
        found = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), **options)
        found = found.select(F.col("doc_id").alias(row), F.col("n_shingles").alias(nth), F.col("component_id").alias(group)).distinct()
        found = materialize(found, "near-rows")
        ids = keyed.select(row, "doc_id").distinct().join(found.filter(F.col(nth) > 0), row)
        least = ids.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("least")).select(f"least.{row}")
        first = F.row_number().over(W.partitionBy(row).orderBy(*[F.col(c) for c in ["text", *rest]]))
        some = keyed.join(least, row, "left_semi").withColumn(nth, first).filter(F.col(nth) == 1)
        none = keyed.join(found.filter(F.col(nth) == 0), row, "left_semi")
        return some.select(docs.columns).unionByName(none.select(docs.columns))
    kept = near_duplicates(docs, **options).filter("kept and doc_id is not null").select("doc_id").distinct()
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(*[F.col(c) for c in ["text", *rest]]))
    real = docs.join(kept, "doc_id", "left_semi").withColumn(nth, first).filter(F.col(nth) == 1).drop(nth)
    return real.select(docs.columns).unionByName(docs.filter("doc_id is null"))
