"""Similarity of pairs: sets, token counts, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What each component of a comparison counts for, and below what a page says too little.
WEIGHTS = {"entity": 0.30, "text": 0.20, "dom": 0.20, "visual": 0.20, "asset": 0.10}
MIN_TOKENS, MIN_FEATURES, MIN_VARIANCE = 6, 3, 0.0001


def set_similarity(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """left, right, shared, united, similarity: Jaccard of the items (id, item) of each pair; 0 where both are empty."""
    one = items.select("id", "item").distinct()
    size = one.groupBy("id").agg(F.count("*").alias("n"))
    both = pairs.join(one.withColumnRenamed("id", "left"), "left").join(one.withColumnRenamed("id", "right"), ["right", "item"]).groupBy("left", "right").agg(F.count("*").alias("shared"))
    rows = pairs.join(size.select(F.col("id").alias("left"), F.col("n").alias("a")), "left", "left").join(size.select(F.col("id").alias("right"), F.col("n").alias("b")), "right", "left").join(both, ["left", "right"], "left")
    rows = rows.na.fill(0, ["a", "b", "shared"]).withColumn("united", F.col("a") + F.col("b") - F.col("shared"))
    return rows.select("left", "right", "shared", "united", F.when(F.col("united") > 0, F.col("shared") / F.col("united")).otherwise(0.0).alias("similarity"))


def entity_similarity(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """left, right, n_types, similarity: Jaccard of the items (id, type, item) of each type that either has, and the mean of these; 0 without any."""
    one = items.select("id", "type", "item").distinct()
    left = pairs.join(one.withColumnRenamed("id", "left"), "left").withColumn("a", F.lit(1))
    right = pairs.join(one.withColumnRenamed("id", "right"), "right").withColumn("b", F.lit(1))
    both = left.join(right, ["left", "right", "type", "item"], "full_outer")
    by_type = both.groupBy("left", "right", "type").agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("jaccard"))
    mean = by_type.groupBy("left", "right").agg(F.count("*").alias("n_types"), F.avg("jaccard").alias("similarity"))
    return pairs.join(mean, ["left", "right"], "left").select("left", "right", F.coalesce("n_types", F.lit(0)).alias("n_types"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def dom_similarity(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """left, right, shared, united, similarity, status of the feature pairs (id, item, k = which occurrence) of two pages: a page with fewer than
    MIN_FEATURES features has low information and scores 0; a page that is not there makes it not applicable."""
    rows = set_similarity(pairs, features)
    size = features.groupBy("id").agg((F.count("*") + 1).alias("n"))
    rows = rows.join(size.select(F.col("id").alias("left"), F.col("n").alias("m")), "left", "left").join(size.select(F.col("id").alias("right"), F.col("n").alias("n")), "right", "left")
    status = F.when(F.col("m").isNull() | F.col("n").isNull(), "not_applicable").when(F.least("m", "n") < MIN_FEATURES, "low_information").otherwise("scored")
    rows = rows.withColumn("status", status)
    return rows.select("left", "right", "shared", "united", F.when(F.col("status") == "scored", F.col("similarity")).otherwise(0.0).alias("similarity"), "status")


def _dot(x: Column, y: Column) -> Column:
    """The product of two lists of (token, n), each with a token once: in the sorted list of both, equal tokens stand side by side."""
    zero = F.lit(0).cast("long")
    step = lambda a, e: F.struct(e["token"].alias("token"), e["n"].alias("n"), (a["dot"] + F.when(a["token"] == e["token"], a["n"] * e["n"]).otherwise(zero)).alias("dot"))
    start = F.struct(F.lit("").alias("token"), zero.alias("n"), zero.alias("dot"))
    return F.aggregate(F.array_sort(F.concat(x, y)), start, step, lambda a: a["dot"])


def text_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """left, right, similarity, low_information: cosine of the token counts (``observations.text_vectors``) of each pair. A pair's vectors meet in its row, after two joins of a row
    a text each."""
    side = lambda name: vectors.select(F.col("id").alias(name), F.struct("counts", "sq", "total").alias(f"{name}_vector"))
    rows = pairs.join(side("left"), "left", "left").join(side("right"), "right", "left")
    x, y = F.col("left_vector"), F.col("right_vector")
    value = F.when(x.isNotNull() & y.isNotNull(), _dot(x["counts"], y["counts"]) / (F.sqrt(x["sq"]) * F.sqrt(y["sq"]))).otherwise(0.0)
    low = F.least(F.coalesce(x["total"], F.lit(0)), F.coalesce(y["total"], F.lit(0))) < MIN_TOKENS
    return rows.select("left", "right", value.alias("similarity"), low.alias("low_information"))


def average_hash(vectors: DataFrame) -> DataFrame:
    """id, words (array of 64-bit words, first value in the highest bit), n_bits, variance of the numeric array ``v``: a bit is set where the
    value reaches the mean."""
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = vectors.withColumn("mean", total / F.size("v")).withColumn("n_bits", F.size("v"))
    bits = F.transform("v", lambda x: (x.cast("double") >= F.col("mean")).cast("long"))
    word = lambda k: F.aggregate(F.slice(bits, k * 64 + 1, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))
    words = F.when(F.col("n_bits") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.col("n_bits") - 1) / 64).cast("int")), word))
    spread = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x.cast("double") - F.col("mean")) * (x.cast("double") - F.col("mean"))) / F.size("v")
    return rows.select("id", words.alias("words"), "n_bits", spread.alias("variance"))


def hash_similarity(pairs: DataFrame, hashes: DataFrame, least_variance: float = MIN_VARIANCE) -> DataFrame:
    """left, right, similarity, status: one less the share of bits that differ; 0 where sizes don't match (not_applicable) or a side hardly
    varies (low_information)."""
    side = lambda name: hashes.select(F.col("id").alias(name), F.struct("words", "n_bits", "variance").alias(f"{name}_hash"))
    rows = pairs.join(side("left"), "left", "left").join(side("right"), "right", "left")
    x, y = F.col("left_hash"), F.col("right_hash")
    status = F.when(x.isNull() | y.isNull() | (x["n_bits"] != y["n_bits"]), "not_applicable").when(F.least(x["variance"], y["variance"]) < least_variance, "low_information").otherwise("scored")
    differ = F.aggregate(F.zip_with(x["words"], y["words"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, k: a + k)
    rows = rows.withColumn("status", status)
    return rows.select("left", "right", F.when(F.col("status") == "scored", 1 - differ / x["n_bits"]).otherwise(0.0).alias("similarity"), "status")


def mirror_score(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """left, right, score, warnings: weighted sum of the components (left, right, name, similarity, status) of each pair in percent. Components
    that are missing or not scored add nothing and are named in the warnings, in order of WEIGHTS."""
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("name"), F.lit(w).alias("weight")) for k, (n, w) in enumerate(WEIGHTS.items())])).alias("c")
    rows = pairs.select("left", "right", names).select("left", "right", "c.*").join(components, ["left", "right", "name"], "left")
    status = F.coalesce("status", F.lit("not_applicable"))
    rows = rows.withColumn("warning", F.when(status != "scored", F.struct("place", F.concat_ws(" ", "name", status).alias("text"))))
    value = F.when(status == "scored", F.col("similarity") * F.col("weight")).otherwise(0.0)
    out = rows.groupBy("left", "right").agg(F.round(100 * F.sum(value), 2).alias("score"), F.array_sort(F.collect_list("warning")).alias("w"))
    return out.select("left", "right", "score", F.array_join(F.transform("w", lambda x: x["text"]), "; ").alias("warnings"))
