"""The staged builder: reviews to benchmark rows, one DataFrame after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlume.functions import text as X
from revlume.operators import etl as E
from revlume.operators import gates as G
from revlume.operators import records as C

Stage = Callable[[DataFrame], DataFrame]


def extraction(reviews: DataFrame, most: int = 6) -> DataFrame:
    """Candidates of each review (id, text, split): its most frequent word pairs, as explicit aspects. Reviews without one go."""
    found = C.top_bigrams(reviews, most).select("id", F.col("bigram").alias("aspect_raw"))
    return reviews.join(found, "id").withColumn("source", F.lit("explicit"))


def evidence(rows: DataFrame) -> DataFrame:
    """The place of the aspect in its text, and whether it stands there as it is."""
    span = X.phrase_span(F.col("text"), F.col("aspect_raw"))
    return rows.withColumn("span", span).withColumn("support", F.when(F.col("span")[0] >= 0, "exact").otherwise("none")).withColumn("evidence", F.col("text"))


def canonical_names(rows: DataFrame) -> DataFrame:
    """By the fallbacks for what no dictionary names."""
    none = rows.select("aspect_raw", F.lit(None).cast("string").alias("canonical")).limit(0)
    return G.canonicalize(rows, [("map", 1.0, none, ["aspect_raw"])])


def sentiment(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sentiment", X.keyword_polarity(F.col("text")))


def benchmark(rows: DataFrame) -> DataFrame:
    """One row for each review: its items, ambiguity, hardness, and where it goes with the reasons."""
    reasons = E.gate_reasons(F.col("confidence"), F.col("support"), F.col("evidence"))
    item = F.struct("canonical", "source", "sentiment", "confidence")
    of_review = rows.withColumn("reasons", reasons).groupBy("id", "split").agg(F.collect_list(item).alias("found"), F.collect_set("reasons").alias("reasons"))
    scored = of_review.withColumn("ambiguity", F.round(C.ambiguity(F.col("found")), 6)).withColumn("route", G.export_route(F.col("reasons"), F.col("split")))
    return scored.select(
        "id", "split", F.size("found").cast("long").alias("items"), "ambiguity", C.hardness(F.col("found"), F.col("ambiguity"), F.lit("known")).alias("hardness"), F.col("route.destination").alias("destination"), F.array_join("route.reasons", ",").alias("reasons"))


# the sentiment is that of the text: found once for a review, before its candidates
STAGES: list[tuple[str, Stage]] = [("sentiment", sentiment), ("extraction", extraction), ("evidence", evidence), ("canonical names", canonical_names), ("benchmark", benchmark)]


def build(reviews: DataFrame, stages: list[tuple[str, Stage]] | None = None) -> DataFrame:
    """All stages in order; Spark sees them as one plan."""
    out = reviews
    for _, stage in stages or STAGES:
        out = stage(out)
    return out


def merge_settings(base: DataFrame, over: DataFrame) -> DataFrame:
    """(domain, settings: map<string, array<string>>) of both: an override wins key by key, its lists replace whole ones."""
    both = base.toDF("domain", "low").join(over.toDF("domain", "high"), "domain", "full_outer")
    none = F.create_map().cast("map<string,array<string>>")
    low, high = F.coalesce("low", none), F.coalesce("high", none)
    return both.select("domain", F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high).alias("settings"))


def upload_status(rows: DataFrame, text: str = "text", broken: str | None = None) -> DataFrame:
    """Rows of an uploaded file with a status and an error each; a bad row fails alone."""
    error = F.when(F.col(broken).isNotNull(), "broken_line") if broken else F.when(F.lit(False), "")
    error = error.when(X.blank_to_null(F.col(text)).isNull(), "empty_text")
    return rows.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("failed"))
