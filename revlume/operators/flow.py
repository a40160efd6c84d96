"""The flow of a review: implicit predictions of its clauses, routing, the merge with explicit ones, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.functions import text as X
from revlume.operators import gates as G
from revlume.operators import published

SPAN = "struct<start:int,stop:int,snippet:string>"
#: Tables that a review's flow fills.
TABLES = ("predictions", "abstained", "novel")


def _low(c: str, default: str) -> Column:
    return F.lower(F.coalesce(X.blank_to_null(F.col(c)), F.lit(default)))


def predict(clauses: DataFrame, top_k: int = 5) -> DataFrame:
    """Implicit predictions of reviews from their scored clauses.

    ``clauses``: review_id, place, span, decision, confidence, ambiguity_score, novelty_score, accepted (array<struct<aspect, sentiment,
    confidence, raw_score, routing>>, best first) and novel (array<struct<aspect, novelty_score>>). A clause that abstains gives one
    boundary row named by its first accepted aspect; others give their first max(2 top_k, 8) candidates, of which the surest of each
    aspect stays (ties: first clause, first candidate, then by content). A review without any candidate has its first top_k boundary rows and no
    novel ones; of others all boundary rows and novel candidates stay, the latter as rows with routing ``novel``.

    Null lists count as empty, candidates without a name go, a null decision doesn't abstain.
    """
    abstains = _low("decision", "single_label") == "abstain"
    row = ["review_id", "place", "aspect", "sentiment", "confidence", "raw_score", "routing", "abstain", "reason", "ambiguity_score", "novelty_score", "span"]
    said = clauses.where(~abstains)
    each = said.select("*", F.posexplode(F.slice("accepted", 1, max(2 * top_k, 8))).alias("i", "c")).withColumn("aspect", X.blank_to_null(F.col("c.aspect"))).where("aspect is not null")
    shown = F.struct(
        "place", F.lower(F.coalesce(X.blank_to_null(F.col("c.sentiment")), F.lit("neutral"))).alias("sentiment"), F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("c.raw_score", F.lit(0.0)).alias("raw_score"),
        F.coalesce("c.routing", F.lit("known")).alias("routing"), F.lit(False).alias("abstain"), F.lit(None).cast("string").alias("reason"), "ambiguity_score", "novelty_score", "span",
    )
    best = each.groupBy("review_id", "aspect").agg(F.max_by(shown, F.struct(F.coalesce("c.confidence", F.lit(0.0)), -F.col("place"), -F.col("i"), "c.sentiment", "span")).alias("b")).select("review_id", "aspect", "b.*").select(*row)
    named = F.exists(F.slice("accepted", 1, max(2 * top_k, 8)), lambda c: X.blank_to_null(c["aspect"]).isNotNull())
    with_any = said.where(named).select("review_id").distinct().withColumn("any", F.lit(True))

    first = F.get("accepted", F.lit(0))
    held = clauses.where(abstains).select(
        "review_id", "place", F.trim(F.coalesce(first["aspect"], F.lit(""))).alias("aspect"), F.lower(F.coalesce(X.blank_to_null(first["sentiment"]), F.lit("neutral"))).alias("sentiment"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.lit(0.0).alias("raw_score"), F.lit("boundary").alias("routing"), F.lit(True).alias("abstain"), F.lit("low_selective_confidence").alias("reason"), "ambiguity_score", "novelty_score", "span",
    )
    order = Window.partitionBy("review_id").orderBy("place", "aspect", "sentiment", "confidence", "span")
    held = held.withColumn("turn", F.row_number().over(order)).join(with_any, "review_id", "left").where(F.col("any") | (F.col("turn") <= top_k)).select(*row)

    named = said.select("review_id", "place", "ambiguity_score", F.explode("novel").alias("n")).join(with_any, "review_id", "left_semi")
    novel = named.select(
        "review_id", "place", F.col("n.aspect").alias("aspect"), F.lit("neutral").alias("sentiment"), F.lit(None).cast("double").alias("confidence"), F.lit(0.0).alias("raw_score"), F.lit("novel").alias("routing"), F.lit(False).alias("abstain"),
        F.lit(None).cast("string").alias("reason"), "ambiguity_score", F.col("n.novelty_score").alias("novelty_score"), F.lit(None).cast(SPAN).alias("span"),
    )
    return best.unionByName(held).unionByName(novel)


def hybrid(explicit: DataFrame, implicit: DataFrame, allowed: Column) -> dict[str, DataFrame]:
    """The tables of a flow: predictions, abstained, novel.

    ``explicit``: review_id, place, aspect, sentiment, confidence, span. ``implicit``: as ``predict`` returns, with the columns that
    ``allowed`` reads. Known implicit rows that are not allowed abstain for ``domain_mismatch``. Rows that abstain or are on the boundary
    are kept as such, equal ones once; novel ones once for an aspect, score (six digits) and snippet, named ones only. The known ones are
    merged with the explicit ones by normalized aspect and sentiment: the surer stays, of equally sure ones the explicit one, then the
    first. A routing that is none of these is lost, rows without a name as well.
    """
    gated = G.gate_implicit(implicit.withColumn("decision", F.when(F.col("abstain"), "abstain").otherwise("single_label")), allowed)
    routing = _low("routing", "known")
    apart = F.coalesce("abstain", F.lit(False)) | (routing == "boundary")
    abstained = gated.where(apart).select("review_id", "aspect", "sentiment", F.coalesce("reason", F.lit("low_selective_confidence")).alias("reason"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("ambiguity_score", F.lit(0.0)).alias("ambiguity_score"), "span").distinct()
    named = gated.where(~apart & (routing == "novel")).select("review_id", "place", F.trim("aspect").alias("aspect"), F.coalesce("novelty_score", F.lit(0.0)).alias("novelty_score"), "confidence", "span").where("aspect <> ''")
    shown = F.struct("place", "novelty_score", "confidence", "span")
    novel = named.groupBy("review_id", "aspect", F.round("novelty_score", 6).alias("near"), F.coalesce("span.snippet", F.lit("")).alias("evidence")).agg(F.min(shown).alias("first"))
    novel = novel.select("review_id", "aspect", "first.novelty_score", "first.confidence", "evidence", "first.span.start", "first.span.stop")

    columns = ["review_id", "place", "aspect", "sentiment", "confidence", "span"]
    both = explicit.select(*columns, F.lit("explicit").alias("source")).unionByName(gated.where(~apart & (routing == "known")).select(*columns, F.lit("implicit").alias("source")))
    # a name is made once for each row: a filter of a generated column is not moved before it
    ready = both.select("review_id", F.explode(F.array(X.normalize(F.coalesce("aspect", F.lit(""))))).alias("aspect_normalized"), _low("sentiment", "neutral").alias("sentiment"), "place", F.trim("aspect").alias("aspect"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "span", "source").where("aspect_normalized <> ''")
    rank = F.struct("confidence", F.col("source") == "explicit", -F.col("place"), "aspect", "span")
    won = ready.groupBy("review_id", "aspect_normalized", "sentiment").agg(F.max_by(F.struct("aspect", "confidence", "source", "span"), rank).alias("w"))
    return {"predictions": won.select("review_id", "aspect_normalized", "sentiment", "w.*"), "abstained": abstained, "novel": novel}


def persist(reviews: DataFrame, tables: dict[str, DataFrame], root: str, number: int) -> bool:
    """Replace all that the three tables hold of ``reviews`` (review_id), together; a number that was published does nothing again."""
    return published.replace(reviews, "review_id", root, number, tables)
