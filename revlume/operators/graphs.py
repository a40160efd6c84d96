"""Aspect graphs: pairs, nodes, components, PageRank, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.operators import published
from revlume.operators.ranked import running_sum
from revlume.plans.shared import discard, materialize


def pairs_per_review(mentions: DataFrame, key: str = "review_id", name: str = "aspect") -> DataFrame:
    """(key, a, b): unordered pairs of distinct names of a review, a < b. A review's names are one sorted array; each name
    meets those after it, a name at a time, so that no array of all pairs is built."""
    sets = mentions.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names")).where("size(names) > 1")
    first = sets.select(key, "names", F.posexplode("names").alias("at", "a"))
    return first.select(key, "a", F.explode(F.slice("names", F.col("at") + 2, F.size("names"))).alias("b"))


def cooccurrence(mentions: DataFrame, key: str = "review_id", name: str = "aspect", least: int = 1) -> DataFrame:
    return pairs_per_review(mentions, key, name).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def score(sentiment: Column) -> Column:
    return F.when(sentiment == "positive", 1).when(sentiment == "negative", -1).otherwise(0)


def nodes(rows: DataFrame, name: str = "aspect") -> DataFrame:
    n = F.count(F.lit(1))
    counted = rows.groupBy(name).agg(
        F.countDistinct("review_id").alias("frequency"), n.alias("mentions"), (F.sum(score(F.col("sentiment"))).cast("double") / n).alias("avg_sentiment"), (F.count_if(F.col("sentiment") == "negative").cast("double") / n).alias("negative_ratio"),
        F.count_if(F.col("source") == "explicit").cast("long").alias("explicit_count"), F.count_if(F.col("source") == "implicit").cast("long").alias("implicit_count"))
    by = rows.groupBy(name, "sentiment").agg(n.alias("n"))
    place = Window.partitionBy(name).orderBy(F.desc("n"), "sentiment")
    mode = by.withColumn("place", F.row_number().over(place)).where("place = 1").select(name, F.col("sentiment").alias("dominant"))
    return counted.join(mode, name)


def idf(rows: DataFrame, reviews: DataFrame, name: str = "aspect") -> DataFrame:
    total = reviews.agg(F.count(F.lit(1)).alias("total"))
    df = rows.groupBy(name).agg(F.countDistinct("review_id").alias("df"))
    return df.crossJoin(F.broadcast(total)).select(name, "df", F.round(F.log((F.col("total") + 1) / (F.col("df") + 1)), 6).alias("idf"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the shortest node it is connected with, of equally short ones the least.

    Each round takes the first root around a node, and that root's root, until nothing changes. A round's table is deleted
    when the next one is written.
    """
    name = lambda c: F.struct(F.length(F.col(c).cast("string")).alias("size"), F.col(c).alias("name"))
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "component-edges")
    roots = materialize(both.groupBy("node").agg(F.least(F.min(name("other")), F.min(name("node"))).alias("root")), "roots")
    written = roots
    while True:
        around = both.join(roots.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        closer = roots.join(around, "node").select("node", "root", F.least("root", "near").alias("new"))
        step = materialize(closer.join(closer.select(F.col("node").alias("via"), F.col("new").alias("next")), F.col("new.name") == F.col("via")).select("node", "root", F.least("new", "next").alias("new")), "roots")
        discard(written)
        written = step
        if step.where("new < root").isEmpty():
            discard(both)
            return step.select("node", F.col("new.name").alias("root"))
        roots = step.select("node", F.col("new").alias("root"))


def communities(edges: DataFrame, least: float = 2) -> DataFrame:
    """(community, size, member): components of the heavier edges, numbered by size, then by their first member; a row for each member."""
    found = components(edges.where(F.col("weight") >= least))
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    numbered = running_sum(sizes, F.lit(1), "community", F.desc("size"), F.asc("root"))
    return found.join(numbered, "root").select(F.col("community").cast("int"), "size", F.col("node").alias("member"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Weighted PageRank of an undirected graph: until a round moves all nodes together by less than the tolerance for each
    node, or so many rounds. A round's table is deleted when the next one is written."""
    both = edges.select("a", "b", "weight").union(edges.select("b", "a", "weight")).toDF("node", "other", "weight")
    out = both.groupBy("node").agg(F.sum("weight").alias("total"))
    shares = materialize(both.join(out, "node").select("node", "other", (F.col("weight") / F.col("total")).alias("share")), "shares")
    n = shares.select("node").distinct().count()
    ranks = materialize(shares.select("node").distinct().withColumn("rank", F.lit(1.0 / max(n, 1))).withColumn("moved", F.lit(0.0)), "ranks")
    for _ in range(rounds):
        given = shares.join(ranks.select("node", "rank"), "node").groupBy("other").agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        new = given.select(F.col("other").alias("node"), (F.lit((1 - damping) / max(n, 1)) + damping * F.col("given")).alias("rank"))
        step = materialize(new.join(ranks.select("node", F.col("rank").alias("before")), "node").select("node", "rank", F.abs(F.col("rank") - F.col("before")).alias("moved")), "ranks")
        discard(ranks)
        ranks = step
        if (step.agg(F.sum("moved")).first()[0] or 0.0) < n * tolerance:
            break
    discard(shares)
    return ranks.select("node", "rank")


def overall_sentiment(rows: DataFrame, ranks: DataFrame, idfs: DataFrame, tau: float = 2.5, edge: float = 0.15) -> DataFrame:
    """Of each review, the sentiment weighted by a softmax of evidence, rank and rarity of its aspects."""
    scored = rows.join(ranks.select(F.col("node").alias("aspect"), "rank"), "aspect", "left").join(idfs.select("aspect", "idf"), "aspect", "left").na.fill(0.0, ["rank", "idf"])
    s = 0.55 * F.col("evidence") + 0.25 * F.col("rank") + 0.2 * F.col("idf") / (F.col("idf") + 5)
    # a review's largest score is taken out of the exponent, so that none overflows
    own = Window.partitionBy("review_id")
    weighed = scored.withColumn("s", tau * s).withColumn("w", F.exp(F.col("s") - F.max("s").over(own)))
    total = F.sum(F.col("w") * score(F.col("sentiment")) * F.col("conf") / 100) / F.sum("w")
    out = weighed.groupBy("review_id").agg(total.alias("score"))
    return out.select("review_id", (F.round("score", 5) + 0.0).alias("overall_score"), F.when(F.col("score") > edge, "positive").when(F.col("score") < -edge, "negative").otherwise("neutral").alias("overall"))


def transitions(mentions: DataFrame) -> DataFrame:
    """Moves between consecutive different aspects of a review, by place and aspect."""
    order = Window.partitionBy("review_id").orderBy("position", "aspect")
    step = mentions.withColumn("next", F.lead("aspect").over(order)).where("next is not null and next <> aspect")
    return step.groupBy("review_id", F.col("aspect").alias("a"), F.col("next").alias("b")).agg(F.count(F.lit(1)).alias("moves"))


def odd_nodes(found: DataFrame) -> DataFrame:
    """Nodes with one-sided origin or with sentiment and negative share at odds, against the median frequency."""
    median = found.agg(F.expr("percentile(frequency, 0.5)").alias("median"))
    share = F.col("implicit_count").cast("double") / F.col("mentions")
    flags = F.array_compact(F.array(
        F.when((F.col("mentions") >= 20) & (share >= 0.95), "mostly_implicit"), F.when((F.col("mentions") >= 20) & (share <= 0.05), "mostly_explicit"),
        F.when((F.col("dominant") == "positive") & (F.col("negative_ratio") > 0.34), "inconsistent"), F.when(F.col("frequency") >= F.greatest(F.lit(10), 1.05 * F.col("median")), "frequent")))
    return found.crossJoin(F.broadcast(median)).withColumn("flags", F.array_join(flags, ",")).where("flags <> ''")


def rebuild(rows: DataFrame, alike: DataFrame, name: str = "aspect_raw") -> tuple[DataFrame, DataFrame]:
    """The graph of a corpus anew: nodes (cluster, frequency, mentions) and edges (a, b, weight) between clusters.

    Aspects that similar or heavy edges (a, b) bind are one cluster, named by its shortest; edges inside a cluster go,
    those between two clusters are summed. Rows that may not enter a graph are left out before.
    """
    roots = components(alike).select(F.col("node").alias(name), F.col("root"))
    placed = rows.join(roots, name, "left").withColumn("cluster", F.coalesce("root", name))
    found = placed.groupBy("cluster").agg(F.countDistinct("review_id").alias("frequency"), F.count(F.lit(1)).alias("mentions"))
    to = roots.toDF("from", "to")
    both = cooccurrence(rows, name=name).join(to.toDF("a", "x"), "a", "left").join(to.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "weight").where("x <> y")
    return found, both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight"))


def publish(rows: DataFrame, alike: DataFrame, reviews: DataFrame, scope: str, root: str, number: int, name: str = "aspect_raw") -> bool:
    """The graph of one scope (a domain, or all) anew, published as the tables ``nodes`` (scope, cluster, frequency, mentions, idf, rank)
    and ``edges`` (scope, a, b, weight) together, in place of what they held of that scope; other scopes stay.

    ``reviews`` are those of the scope, with or without a row; a cluster without an edge has rank null. A scope without rows loses its graph.
    The same number again does nothing and gives False.
    """
    found, edges = rebuild(rows, alike, name)
    edges = materialize(edges, "scope-edges")
    total = reviews.agg(F.count(F.lit(1)).alias("total"))
    rare = found.crossJoin(F.broadcast(total)).withColumn("idf", F.round(F.log((F.col("total") + 1) / (F.col("frequency") + 1)), 6))
    nodes = rare.join(pagerank(edges).withColumnRenamed("node", "cluster"), "cluster", "left").select(F.lit(scope).alias("scope"), "cluster", "frequency", "mentions", "idf", "rank")
    keys = rows.sparkSession.createDataFrame([(scope,)], "scope string")
    done = published.replace(keys, "scope", root, number, {"nodes": nodes, "edges": edges.select(F.lit(scope).alias("scope"), "a", "b", "weight")})
    discard(edges)
    return done
