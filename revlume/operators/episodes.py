"""Few-shot episodes by weighted sampling without replacement.

Every choice takes the least exponential keys: ``-ln(u) / weight``, with u a hash of the seed, the
episode and what is chosen, so that the same seed gives the same rows wherever they lie, and the
least keys of parts are those of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.plans.shared import discard, materialize

#: fixed values: what rarity, hardness and domains count for in a label's weight, and the least weight
RARITY, HARDNESS, DOMAINS, LEAST = 0.55, 0.30, 0.15, 1e-6
#: Examples of a label that episodes draw from: a weighted sample of it.
POOL = 2000
#: Episodes tried for each one wanted.
TRIES = 12


def uniform(seed: int, *what: Column | str) -> Column:
    """A number between 0 and 1 by a hash of the seed and what is named."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in what))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def draw_key(weight: Column, seed: int, *what: Column | str) -> Column:
    return -F.ln(uniform(seed, *what)) / weight


def label_weights(rows: DataFrame) -> DataFrame:
    """(label, parents, weight) of rows (label, parent, hardness 0 to 1, domain): rare, hard and widespread labels weigh more."""
    found = rows.groupBy("label").agg(F.countDistinct("parent").alias("parents"), F.avg("hardness").alias("hard"), F.countDistinct(F.coalesce("domain", F.lit("unknown"))).alias("domains"))
    most = found.agg(F.greatest(F.max("domains"), F.lit(1)).alias("most"))
    weight = RARITY / F.greatest(F.col("parents"), F.lit(1)) + HARDNESS * F.coalesce("hard", F.lit(0.0)) + DOMAINS * F.col("domains") / F.col("most")
    return found.crossJoin(F.broadcast(most)).select("label", "parents", F.greatest(F.lit(LEAST), weight).alias("weight"))


def choose_labels(labels: DataFrame, episodes: DataFrame, n_way: int, seed: int, similar: DataFrame | None = None, hard_ratio: float = 0.5, top: int = 5) -> DataFrame:
    """(episode, label): ``n_way`` labels for each episode, by weight. The first one is the pivot; in about ``hard_ratio`` of the
    episodes its ``top`` most similar labels (rows (a, b, cosine), a < b) come before all others."""
    keyed = episodes.join(F.broadcast(labels)).withColumn("draw", draw_key(F.col("weight"), seed, F.lit("label"), "episode", "label"))
    order = Window.partitionBy("episode").orderBy("draw", "label")
    placed = keyed.withColumn("place", F.row_number().over(order))
    if similar is not None:
        both = similar.select(F.col("a").alias("pivot"), F.col("b").alias("label"), "cosine").union(similar.select("b", "a", "cosine"))
        near = both.withColumn("rank", F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("cosine"), "label"))).where(F.col("rank") <= top).select("pivot", "label", F.lit(True).alias("near"))
        pivot = F.first("label").over(order)
        hard = uniform(seed, F.lit("hard"), "episode") < hard_ratio
        placed = placed.withColumn("pivot", pivot).join(F.broadcast(near), ["pivot", "label"], "left").withColumn("after", F.when(F.col("place") == 1, 0).when(hard & F.col("near"), 1).otherwise(2))
        placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("episode").orderBy("after", "draw", "label")))
    return placed.where(F.col("place") <= n_way).select("episode", "label")


def build(rows: DataFrame, n_way: int, k_shot: int, q_query: int, count: int, seed: int = 42, similar: DataFrame | None = None, pool: int = POOL) -> DataFrame:
    """(episode, label, role, id) of ``count`` episodes with ``k_shot`` support and ``q_query`` query rows of each of ``n_way`` labels.

    ``rows``: id, label, parent, group (may be null), weight, hardness, domain; ids are distinct. Rows of one group, or of one
    parent where there is no group, have one role in an episode, whatever their label, so that support and query share
    neither; of a parent one row at most is taken for a label and role. Labels with fewer than k_shot + q_query parents
    take no part. Of ``TRIES`` times as many drafts the first that are whole are kept and numbered from 1; if there are
    fewer labels or whole drafts than asked for, so many episodes come out. Rows without label or id are left out.
    """
    spark = rows.sparkSession
    own = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("parent", F.coalesce(F.col("parent").cast("string"), F.col("id").cast("string")))
    labels = materialize(label_weights(own).where(F.col("parents") >= k_shot + q_query), "labels")
    drafts = spark.range(1, max(count * TRIES, 24) + 1).select(F.col("id").alias("episode"))
    chosen = choose_labels(labels, drafts, n_way, seed, similar)
    drawn = Window.partitionBy("label").orderBy("pooled", "id")
    weight = F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(LEAST))
    pooled = own.join(F.broadcast(labels.select("label")), "label").withColumn("pooled", draw_key(weight, seed, F.lit("pool"), "id")).withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= pool)
    examples = materialize(pooled.select("id", "label", "parent", F.coalesce(F.col("group").cast("string"), "parent").alias("unit"), weight.alias("weight")), "pool")
    met = chosen.join(examples, "label").withColumn("role", F.when(uniform(seed, F.lit("role"), "episode", "unit") < k_shot / (k_shot + q_query), "support").otherwise("query"))
    keyed = met.withColumn("draw", draw_key(F.col("weight"), seed, F.lit("row"), "episode", "id"))
    once = keyed.withColumn("own", F.row_number().over(Window.partitionBy("episode", "label", "role", "parent").orderBy("draw", "id"))).where("own = 1")
    taken = once.withColumn("place", F.row_number().over(Window.partitionBy("episode", "label", "role").orderBy("draw", "id"))).where(F.col("place") <= F.when(F.col("role") == "support", k_shot).otherwise(q_query))
    picked = materialize(taken.select("episode", "label", "role", "id"), "picked")
    whole = picked.groupBy("episode").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_way * (k_shot + q_query))
    # at most ``count`` numbers, of a number of drafts that is a parameter
    kept = [r["episode"] for r in whole.select("episode").orderBy("episode").limit(count).collect()]
    numbers = spark.createDataFrame([(e, i + 1) for i, e in enumerate(kept)], "episode long, number long")
    out = materialize(picked.join(F.broadcast(numbers), "episode").select(F.col("number").alias("episode"), "label", "role", "id"), "episodes")
    discard(labels, examples, picked)
    return out
