"""Mix sources to target weights: fixed-length blocks, per-shard source draws, permuted block indices.

All of it is DataFrame code. A source's documents form one stream of words, cut into blocks of ``block_words``; the
last block may be short. Each output shard has ``slots_per_shard`` slots, and each slot takes one block. How many slots of a shard
a source gets is drawn from the multinomial distribution of the sources' shares: each slot draws its source by a seeded hash. A
source's slots are numbered through all shards, so that a shard takes consecutive ranks; rank ``i`` belongs to pass ``i div n``
over the source's ``n`` blocks and takes block ``perm(i mod n)``, a swap-or-not permutation keyed by source and pass, so a pass uses each
block once. The last rank takes only the words that are still missing from the target.

Draws that find their source used up, which happens in the last shards only, go to the sources that have ranks left, so that
taken words meet the targets instead of scattering around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sightline.llm.common import fresh, materialize, row_key

WORD = r"[^\x20\x09-\x0D]+"
PRIME = 2147483647
ROUNDS = 12
CHUNK = 1024
BUCKET_DIGITS = 3  # 4096 buckets of a source's stream, whatever its size
SLOTS_PER_SHARD = 4096
DRAW_CELLS = 1 << 16  # a power of two, so that cells of doubles are exact


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mod_hash(value: Column, factor: int) -> Column:
    return (F.pmod(value, F.lit(PRIME)) * F.lit(factor)) % F.lit(PRIME)


def permute(x: Column, n: Column, key: Column) -> Column:
    """Swap-or-not permutation of [0, n) under an integer key; n and x are long."""

    def step(state: Column, r: Column) -> Column:
        mirror = F.pmod(_mod_hash(key + r * F.lit(15485863), 48271) - state, n)
        top = F.greatest(state, mirror)
        bit = _mod_hash(top + key * F.lit(31) + r * F.lit(104729), 69621).bitwiseAND(F.lit(1 << 14))
        return F.when(bit == 0, state).otherwise(mirror)

    rounds = F.array(*[F.lit(r).cast("long") for r in range(1, ROUNDS + 1)])
    return F.aggregate(rounds, x, step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """One row per source: rank by code point (null last), weight, size and target in words.

    Targets are ``share`` of all words split by weight; no target is above ``cap`` times its source, and the excess goes
    to the others by weight. Sorting by cap/weight finds the capped sources in one pass. The windows run over one row
    per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", (F.row_number().over(order) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap_words", F.col("source_size") * F.lit(cap))
    fill = W.orderBy(F.col("cap_words") / F.col("weight"), "source_rank")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy(F.lit(0))).cast("double") * F.lit(share)
    left = total - F.coalesce(F.sum("cap_words").over(before), F.lit(0)).cast("double")
    level = left / F.sum("weight").over(after).cast("double")
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("cap_words") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap_words") / F.col("weight"), "source_rank", "level")))
    ranked = ranked.withColumn("final", free.over(everything)["level"])
    target = F.when(F.col("capped"), F.col("cap_words").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return ranked.select("source", "source_rank", "source_size", "weight", target.alias("target"))


def draw(shard: Column, place: Column, seed: int) -> Column:
    """A number in [0, 1) for a slot of a shard."""
    x = (F.pmod(shard, F.lit(PRIME)) * F.lit(7919) + place * F.lit(104729) + F.lit(seed)) % F.lit(PRIME)
    x = (x * F.lit(48271)) % F.lit(PRIME)
    x = (x.bitwiseXOR(F.shiftright(x, 13)) * F.lit(69621)) % F.lit(PRIME)
    x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(48271)) % F.lit(PRIME)
    return x.cast("double") / F.lit(float(PRIME))


def _sources_with_slots(sources: DataFrame, block_words: int) -> DataFrame:
    n = F.ceil(F.col("source_size") / block_words).cast("long")
    s = sources.filter(F.col("source_size") > 0).withColumn("n", n).withColumn("want", F.floor("target").cast("long"))
    rest = F.col("want") % F.col("source_size")
    slots = F.floor(F.col("want") / F.col("source_size")) * F.col("n") + F.ceil(rest / block_words)
    return s.select("source_rank", "source_size", "n", "want", slots.cast("long").alias("slots")).filter("slots > 0")


def shard_counts(sources: DataFrame, block_words: int, slots_per_shard: int, seed: int) -> DataFrame:
    """shard, source (struct of source_rank, source_size, n, want, slots), drawn: how many slots of each shard drew each source.

    Every source has an interval of [0, 1), and a slot's draw falls into one. Both are cut into DRAW_CELLS equal cells and joined by cell, so a slot meets the sources of
    one cell only, however many there are.
    """
    own, order = _sources_with_slots(sources, block_words), W.orderBy("source_rank")
    upto = F.sum("slots").over(order).cast("double") / F.sum("slots").over(W.partitionBy(F.lit(0))).cast("double")
    edges = own.select(F.struct("source_rank", "source_size", "n", "want", "slots").alias("source"), "source_rank", upto.alias("hi"))
    edges = edges.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    last = F.least(F.floor(F.col("hi") * DRAW_CELLS), F.lit(DRAW_CELLS - 1).cast("long"))
    cells = edges.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * DRAW_CELLS), last)).alias("cell"))
    one = own.agg(F.sum("slots").alias("all")).filter("all > 0")
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that small rows are not drawn together
    shards = F.floor((F.col("all") - 1) / slots_per_shard).cast("long")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(shards / CHUNK).cast("long")))
    rows = one.select("*", chunk.alias("chunk")).repartition(parts, "chunk")
    rows = rows.select("all", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(shards, F.col("chunk") * CHUNK + (CHUNK - 1)))).alias("shard")).repartition(parts, "shard")
    places = F.sequence(F.lit(0).cast("long"), F.least(F.lit(slots_per_shard).cast("long"), F.col("all") - F.col("shard") * slots_per_shard) - 1)
    rows = rows.select("shard", F.explode(places).alias("place")).withColumn("u", draw(F.col("shard"), F.col("place"), seed))
    rows = rows.select("shard", "u", F.floor(F.col("u") * DRAW_CELLS).alias("cell"))
    drawn = rows.join(cells, (rows["cell"] == cells["cell"]) & (rows["u"] >= cells["lo"]) & (rows["u"] < cells["hi"]))
    return drawn.groupBy("shard", "source").agg(F.count("*").alias("drawn"))


def slot_table(sources: DataFrame, block_words: int, slots_per_shard: int, seed: int) -> DataFrame:
    """One row per slot of the mix: shard, source_rank, block, take (words from the block's start)."""
    counts = materialize(shard_counts(sources, block_words, slots_per_shard, seed), "mix-counts")
    before = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    ranked = ranked.withColumn("kept", F.greatest(F.least("drawn", F.col("source.slots") - F.col("first")), F.lit(0)))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = ranked.filter("kept > 0").repartition(parts, "shard", "source")
    own = own.select("shard", "source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("kept") - 1)).alias("i"))
    # draws beyond a source's ranks, by number, meet the ranks that no draw reached, by number
    over = ranked.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("kept")).alias("more")).filter("more > 0")
    over = over.withColumn("from", F.coalesce(F.sum("more").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    over = over.select("shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("more") - 1)).alias("j"))
    every = _sources_with_slots(sources, block_words).select(F.struct("source_rank", "source_size", "n", "want", "slots").alias("source"))
    lack = every.join(counts.groupBy("source").agg(F.sum("drawn").alias("drawn")), "source", "left").withColumn("lack", F.greatest(F.col("source.slots") - F.coalesce("drawn", F.lit(0)), F.lit(0))).filter("lack > 0")
    lack = lack.withColumn("from", F.coalesce(F.sum("lack").over(W.orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    lack = lack.select("source", "from", F.explode(F.sequence(F.col("source.slots") - F.col("lack"), F.col("source.slots") - 1)).alias("i"), "lack")
    lack = lack.select("source", "i", (F.col("from") + F.col("i") - F.col("source.slots") + F.col("lack")).alias("j"))
    s = own.unionByName(over.join(lack, "j").select("shard", "source", "i")).select("shard", "i", "source.*")
    turn, at, short = F.floor(F.col("i") / F.col("n")).cast("long"), F.col("i") % F.col("n"), F.col("n") - 1
    key = F.lit(seed) + F.col("source_rank") * F.lit(7919) + turn * F.lit(1299709)
    block = F.when(at == short, short).otherwise(permute(at, F.greatest(short, F.lit(1).cast("long")), key))
    length = F.when(at == short, F.col("source_size") - short * block_words).otherwise(F.lit(block_words))
    take = F.least(length, F.col("want") - turn * F.col("source_size") - at * block_words)
    return s.select("shard", "source_rank", block.alias("block"), take.cast("long").alias("take"))


def stream_hash(doc_id: Column, text: Column) -> Column:
    """A row's place in its source's stream: it depends on the row alone, so that a stream keeps its order as a table grows."""
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))), 1, 16)


def source_streams(docs: DataFrame) -> DataFrame:
    """Adds ``start``: the word offset of a document in its source's stream, which is in order of ``hash``.

    Offsets add a bucket's own running sum to the words of the buckets before it, so that a source with a third of all rows
    is not summed by one task. Equal rows follow each other.
    """
    docs = docs.withColumn("bucket", F.conv(F.substring("hash", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    totals = docs.groupBy("source_rank", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source_rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("source_rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    own = W.partitionBy("source_rank", "bucket").orderBy("hash", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return docs.join(totals, ["source_rank", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop("inner", "base", "bucket", "hash")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, block_words: int = 512,
    slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(slots, placed): the output slots of ``slot_table`` and one row per document with doc_id, size, source_rank,
    source_size, target, start. ``docs`` needs doc_id (integer), text and source; other columns are ignored.

    Null text has size 0 and takes nothing; a null source is a source of its own, ranked last; a null doc_id is a
    document like others; repeated doc_ids are separate documents; a long text spans as many blocks as it needs; an empty table
    gives two empty tables.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), stream_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    sized = materialize(sized, "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, share, cap)
    by = sources.select(F.col("source").alias("_source"), "source_rank", "source_size", "target")
    placed = source_streams(sized.join(by, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))
    return slot_table(sources, block_words, slots_per_shard, seed), placed


def taken_words(slots: DataFrame, placed: DataFrame, block_words: int = 512) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard, last_shard (of those that take words of the document): joins each slot's
    block, by index, to the documents in that block."""
    placed = materialize(placed, "mix-placed")
    first = F.floor(F.col("start") / block_words).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    used = F.greatest(F.least(end, F.coalesce("take", F.lit(0))) - begin, F.lit(0))
    # the size of exploded slots is not known to the planner, which must not broadcast them
    joined = pieces.join(slots.hint("merge"), ["source_rank", "block"], "left").withColumn("used", used)
    where = F.when(F.col("used") > 0, F.col("shard"))
    sums = [F.coalesce(F.sum("used"), F.lit(0)).cast("long").alias("taken"), F.min(where).alias("first_shard"), F.max(where).alias("last_shard")]
    counted = joined.groupBy("doc_id", "size", "source_size", "target", "source_rank", "start").agg(*sums)
    out = ["doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard"]
    none = {"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long"), "last_shard": F.lit(None).cast("long")}
    return counted.select(out).unionByName(placed.filter("size = 0").withColumns(none).select(out))


def mixed_documents(docs: DataFrame, block_words: int = 512, seed: int = 17, **options) -> DataFrame:
    """The mix as whole rows of ``docs``: each document as often as the mix takes its words.

    A fraction is rounded up as often as it is large, by a seeded hash of the document, so that documents of many blocks, which all
    have about their source's ratio taken, keep their share. Documents without words, and those that the mix passes over, have no rows.
    Each row is a document of its own, whatever its doc_id is, null or repeated; rows with the same doc_id, text and source share their
    count. Other columns, whatever their names, are kept; an empty table stays empty.
    """
    mark, count, turn = (fresh(docs.columns, c) for c in ("mixed", "times", "turn"))
    keyed = docs.withColumn(mark, row_key("doc_id", "text", "source"))
    slots, placed = mix(keyed.select(F.col(mark).alias("doc_id"), "text", "source"), block_words=block_words, seed=seed, **options)
    taken = taken_words(slots, placed, block_words).filter("size > 0")
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(1 << 30)
    times = taken.groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias("ratio"))
    whole = F.floor("ratio")
    times = times.select(F.col("doc_id").alias(mark), (whole + (part < F.col("ratio") - whole).cast("int")).cast("int").alias(count)).filter(F.col(count) > 0)
    again = keyed.join(times, mark).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(count))))
    return again.select(docs.columns)
