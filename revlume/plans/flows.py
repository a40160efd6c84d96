"""The flow of reviews and the parser of generated lines over the binding views."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlume.functions import text as X
from revlume.operators import flow as W
from revlume.operators import gates as G
from revlume.operators import lines as N
from revlume.operators import published as P
from revlume.plans import views as V
from revlume.plans.records import words
from revlume.plans.registry import Registry
from revlume.plans.shared import discard, materialize, shared_folder

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add("C22_parsed_lines", f"""WITH {V.SQL.strip()}, w AS (SELECT review_id, position, review_id % 5 AS form, upper(aspect_raw[1]) || substr(aspect_raw, 2) AS name, CASE WHEN conf = 95 THEN NULL ELSE sentiment END AS sentiment FROM predictions)
SELECT review_id, CASE form WHEN 3 THEN 'sentiment' ELSE lower(name) END AS aspect, sentiment FROM w WHERE sentiment IS NOT NULL GROUP BY ALL""")
def c22(spark, d):
    """The mentions of each review written in one of five forms, and read again; mentions of one confidence name no sentiment.

    The listed form shows its sentiments as quoted pairs, which come first."""
    p = V.predictions(spark, d)
    name, form = F.concat(F.upper(F.substring("aspect_raw", 1, 1)), F.substring("aspect_raw", 2, 1000)), F.col("review_id") % 5
    short = F.when(F.col("conf") == 95, "unsure").when(F.col("sentiment") == "positive", F.when(F.col("position") % 2 == 0, "POS.").otherwise("great")).when(F.col("sentiment") == "negative", "Terrible!").otherwise("mixed")
    quoted = lambda a, b: F.concat(F.lit('"'), a, F.lit('" : "'), b, F.lit('"'))
    one = (
        F.when(form == 0, quoted(name, short)).when(form == 1, F.concat(name, F.lit(" : "), short)).when(form == 2, F.concat(F.lit("- "), name, F.lit("  | "), short))
        .when(form == 3, F.concat(F.lit("{"), quoted(F.lit("aspect"), name), F.lit(", "), quoted(F.lit("sentiment"), short), F.lit("}"))).otherwise(F.concat("position", F.lit(") *"), name, F.lit("* - "), short))
    )
    texts = p.select("review_id", one.alias("one")).groupBy("review_id").agg(F.array_join(F.collect_list("one"), "\x01").alias("all"))
    joined = F.when(form.isin(0, 1), F.replace("all", F.lit("\x01"), F.lit(" , "))).when(form == 3, F.concat(F.lit('{"pairs": ['), F.replace("all", F.lit("\x01"), F.lit(", ")), F.lit("]}"))).otherwise(F.replace("all", F.lit("\x01"), F.lit("\r\n")))
    found = N.parsed(texts.select("review_id", joined.alias("text")), "review_id")
    return found.select("review_id", F.lower("aspect").alias("aspect"), "sentiment")


def scored_clauses(spark, d):
    """Implicit mentions as scored clauses: those of some confidences abstain, some name no aspect, some bring novel ones."""
    p = V.by_review(spark, d).where("source = 'implicit'")
    score, none = F.col("conf") / 100, F.col("conf") == 97
    one = lambda name, less: F.struct(name.alias("aspect"), F.col("sentiment").alias("sentiment"), (score - less).alias("confidence"), (score - less).alias("raw_score"), F.lit("known").alias("routing"))
    novel = F.when(F.col("conf") % 4 == 1, F.array(F.struct(F.concat(F.lit("new "), "aspect_raw").alias("aspect"), (F.lit(1.0) - score).alias("novelty_score"))))
    return p.select(
        "review_id", F.col("position").alias("place"), F.struct(F.lit(0).alias("start"), F.length("aspect_raw").alias("stop"), F.col("aspect_raw").alias("snippet")).alias("span"), F.when(F.col("conf") % 3 == 0, "abstain").otherwise("single_label").alias("decision"),
        score.alias("confidence"), (F.lit(1.0) - score).alias("ambiguity_score"), (F.lit(1.0) - score).alias("novelty_score"), F.array(one(F.when(none, " ").otherwise(F.col("aspect_raw")), 0.0), one(F.when(~none, F.col("aspect_cluster")), 0.25)).alias("accepted"), novel.alias("novel"),
    )


IMPLICIT = f"""WITH {V.SQL.strip()}, im AS (SELECT * FROM predictions WHERE source = 'implicit'), said AS (SELECT * FROM im WHERE conf % 3 <> 0),
cand AS (SELECT review_id, position, aspect_raw AS raw, 0 AS i, aspect_raw AS aspect, sentiment, conf::DOUBLE / 100 AS confidence FROM said WHERE conf <> 97 UNION ALL SELECT review_id, position, aspect_raw, 1, aspect_cluster, sentiment, conf::DOUBLE / 100 - 0.25::DOUBLE FROM said WHERE conf <> 97),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, aspect ORDER BY confidence DESC, position, i, sentiment DESC, length(raw) DESC, raw DESC) AS turn FROM cand) WHERE turn = 1),
shy AS (SELECT review_id, position, aspect_raw AS raw, CASE WHEN conf = 97 THEN '' ELSE aspect_raw END AS aspect, sentiment, conf::DOUBLE / 100 AS confidence FROM im WHERE conf % 3 = 0),
held AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY position, aspect, sentiment, confidence, length(raw), raw) AS turn FROM shy),
kept AS (SELECT * FROM held WHERE turn <= 2 OR review_id IN (SELECT review_id FROM best)),
nov AS (SELECT review_id, position, 'new ' || aspect_raw AS aspect, 1 - conf::DOUBLE / 100 AS novelty FROM said WHERE conf % 4 = 1 AND review_id IN (SELECT review_id FROM best))"""


@R.add("X14_implicit_predictions", IMPLICIT + """ SELECT review_id, position AS place, aspect, sentiment, round(confidence, 6) AS confidence, 'known' AS routing FROM best
UNION ALL SELECT review_id, position, aspect, sentiment, round(confidence, 6), 'boundary' FROM kept UNION ALL SELECT review_id, position, aspect, 'neutral', NULL, 'novel' FROM nov""")
def x14(spark, d):
    return W.predict(scored_clauses(spark, d), top_k=2).select("review_id", "place", "aspect", "sentiment", F.round("confidence", 6).alias("confidence"), "routing")


MERGED = IMPLICIT + """, ruled AS (SELECT *, review_id % 3 = 0 OR aspect NOT LIKE 'cold%' AS allowed FROM best), ex AS (SELECT review_id, position, aspect_raw AS aspect, sentiment, conf::DOUBLE / 100 AS confidence, 'explicit' AS source FROM predictions WHERE source = 'explicit'),
both_kinds AS (SELECT * FROM ex UNION ALL SELECT review_id, position, aspect, sentiment, confidence, 'implicit' FROM ruled WHERE allowed),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, lower(aspect), sentiment ORDER BY confidence DESC, source, position) AS turn FROM both_kinds) WHERE turn = 1),
flows AS (SELECT 'predictions' AS kind, review_id, lower(aspect) AS aspect, sentiment, source AS note, round(confidence, 6) AS score FROM won
UNION ALL SELECT 'abstained', review_id, aspect, sentiment, reason, round(confidence, 6) FROM (SELECT DISTINCT review_id, aspect, sentiment, confidence, 'low_selective_confidence' AS reason, raw FROM kept UNION ALL SELECT DISTINCT review_id, aspect, sentiment, confidence, 'domain_mismatch', raw FROM ruled WHERE NOT allowed)
UNION ALL SELECT 'novel', review_id, aspect, NULL, '', round(novelty, 6) FROM (SELECT DISTINCT review_id, aspect, novelty FROM nov))"""


def gated_clauses(spark, d):
    """The implicit predictions, and whether each is allowed: found once for all tables of the flow."""
    allowed = G.implicit_allowed(F.col("aspect"), F.when(F.col("review_id") % 3 > 0, "laptop"), words("one"), words("small", "large", "green", "red", "blue", "hot", "new", "old", "economy", "promo", "standard", "medium"), words("price"))
    return materialize(W.predict(scored_clauses(spark, d), top_k=2).withColumn("allowed", allowed), "implicit")


def flow_tables(spark, d, implicit):
    p = V.by_review(spark, d)
    span = F.struct(F.lit(0).alias("start"), F.length("aspect_raw").alias("stop"), F.col("aspect_raw").alias("snippet")).alias("span")
    explicit = p.where("source = 'explicit'").select("review_id", F.col("position").alias("place"), F.col("aspect_raw").alias("aspect"), "sentiment", (F.col("conf") / 100).alias("confidence"), span)
    return W.hybrid(explicit, implicit, F.col("allowed"))


def shown(spark, root):
    """The three published tables as one."""
    parts = {name: P.read(spark, root, name) for name in W.TABLES}
    row = lambda name, aspect, sentiment, note, score: parts[name].select(F.lit(name).alias("kind"), "review_id", F.col(aspect).alias("aspect"), sentiment.alias("sentiment"), F.col(note).alias("note"), F.round(score, 6).alias("score"))
    return row("predictions", "aspect_normalized", F.col("sentiment"), "source", "confidence").union(row("abstained", "aspect", F.col("sentiment"), "reason", "confidence")).union(row("novel", "aspect", F.lit(None).cast("string"), "evidence", "novelty_score"))


@R.add("X13_review_flow", MERGED + " SELECT * FROM flows")
def x13(spark, d):
    """The flow of all reviews, stored twice: first with nothing of theirs but a stale row each, then anew; the second run again changes nothing."""
    root, implicit = shared_folder(spark, "flow"), gated_clauses(spark, d)
    tables, reviews = flow_tables(spark, d, implicit), materialize(V.predictions(spark, d).select("review_id").distinct(), "reviews")
    stale = {name: rows.limit(0) for name, rows in tables.items()}
    stale["novel"] = reviews.select("review_id", F.lit("stale").alias("aspect"), F.lit(0.0).alias("novelty_score"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence"), F.lit(0).alias("start"), F.lit(0).alias("stop"))
    W.persist(reviews, stale, root, 0)
    W.persist(reviews, tables, root, 1)
    if W.persist(reviews, stale, root, 1):
        raise AssertionError("a published number was published again")
    discard(implicit, reviews)
    return shown(spark, root)
