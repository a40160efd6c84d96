"""Analytics queries over the binding views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlume.operators import analytics as A
from revlume.plans import views as V
from revlume.plans.registry import Registry
from revlume.plans.views import with_views

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
#: The period of the leaderboard on the test tables, where seven days hold few reviews.
DAYS = 60


def rows(spark: SparkSession, d: str, domain: bool = True) -> DataFrame:
    """Predictions with their reviews; without the domain where a query does not read it, which spares a join."""
    return A.scan(V.predictions(spark, d), V.reviews(spark, d, domain))


@R.add("A01_overview", with_views("""SELECT (SELECT count(*) FROM reviews) AS reviews, count(*) AS mentions, count(DISTINCT aspect_raw) AS unique_aspects,
 CAST(CAST(sum(conf) AS BIGINT) AS DOUBLE) / count(conf) / 100 AS avg_confidence, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral,
 count(*) FILTER (sentiment = 'negative') AS negative FROM predictions"""))
def a01(spark, d):
    return A.overview(V.predictions(spark, d), V.reviews(spark, d, domain=False))


@R.add("A02_dashboard_kpis", with_views("""per AS (SELECT aspect, count(*) AS total, count(*) FILTER (sentiment = 'negative') AS negative FROM joined GROUP BY 1 ORDER BY total DESC, aspect LIMIT 100)
SELECT count(*) AS mentions, 100.0::DOUBLE * count(*) FILTER (sentiment = 'negative') / count(*) AS negative_pct,
 (SELECT aspect FROM per ORDER BY negative::DOUBLE / total DESC, negative DESC, aspect LIMIT 1) AS worst_aspect FROM joined"""))
def a02(spark, d):
    return A.dashboard(rows(spark, d, False))


@R.add("A03_top_aspects", with_views("SELECT aspect, count(*) AS mentions FROM joined GROUP BY 1 ORDER BY mentions DESC, aspect LIMIT 10"))
def a03(spark, d):
    return A.top_aspects(rows(spark, d, False), 10)


COUNTS = "count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative"


@R.add("A04_sentiment_distribution", with_views(f"SELECT aspect, count(*) AS total, {COUNTS} FROM joined GROUP BY 1"))
def a04(spark, d):
    return A.distribution(rows(spark, d, False))


BOARD = f"""base AS (SELECT count(*) AS base FROM reviews, clock WHERE created_at >= now - INTERVAL {DAYS} DAY AND created_at < now),
counted AS (SELECT aspect, count(*) FILTER (created_at >= now - INTERVAL {DAYS} DAY) AS frequency, count(*) FILTER (created_at <= now - INTERVAL {DAYS} DAY) AS previous,
 count(*) FILTER (created_at >= now - INTERVAL {DAYS} DAY AND sentiment = 'positive') AS positive, count(*) FILTER (created_at >= now - INTERVAL {DAYS} DAY AND sentiment = 'negative') AS negative,
 count(*) FILTER (created_at >= now - INTERVAL {DAYS} DAY AND source = 'implicit') AS implicit FROM joined, clock WHERE created_at >= now - INTERVAL {2 * DAYS} DAY GROUP BY 1),
shares AS (SELECT *, negative::DOUBLE / frequency AS p, frequency::DOUBLE AS n, CASE WHEN previous > 0 THEN 100.0::DOUBLE * (frequency - previous) / previous ELSE 100.0::DOUBLE END AS change_pct FROM counted, base WHERE frequency > 0),
board AS (SELECT aspect, frequency, CASE WHEN base > 0 THEN 100.0::DOUBLE * frequency / base ELSE 0.0::DOUBLE END AS per_100_reviews, 100.0::DOUBLE * positive / frequency AS positive_pct, 100.0::DOUBLE * negative / frequency AS negative_pct,
 100.0::DOUBLE * (positive - negative) / frequency AS net_sentiment, change_pct,
 round(greatest(0, least(1, (p + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n))), 6) AS ci_low,
 round(greatest(0, least(1, (p + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n))), 6) AS ci_high,
 100.0::DOUBLE * implicit / frequency AS implicit_pct FROM shares ORDER BY frequency DESC, aspect LIMIT 25)"""


def board(spark, d, limit=25):
    return A.leaderboard(rows(spark, d, False), V.reviews(spark, d, domain=False), DAYS, limit, V.clock(spark, d))


@R.add("A05_aspect_leaderboard", with_views(BOARD + " SELECT * FROM board"))
def a05(spark, d):
    return board(spark, d)


IMPACT = BOARD + """, scored AS (SELECT aspect, frequency, frequency * negative_pct / 100.0::DOUBLE * (1 + greatest(0.0::DOUBLE, change_pct / 100.0::DOUBLE)) AS s FROM board)"""


@R.add("A07_impact_matrix", with_views(IMPACT + " SELECT aspect, frequency, round(s, 6) AS priority, CASE WHEN s >= 8 THEN 'high' WHEN s >= 3 THEN 'medium' ELSE 'low' END AS tier FROM scored ORDER BY priority DESC, aspect LIMIT 20"))
def a07(spark, d):
    return A.impact(board(spark, d), 20)


@R.add("A08_segments", with_views("""dom AS (SELECT domain AS segment, count(DISTINCT review_id) AS reviews, count(*) AS mentions, count(*) FILTER (sentiment = 'negative') AS negative FROM joined GROUP BY 1),
prod AS (SELECT product_id::VARCHAR AS segment, count(DISTINCT review_id) AS reviews, count(*) AS mentions, count(*) FILTER (sentiment = 'negative') AS negative FROM joined GROUP BY 1 ORDER BY mentions DESC, segment LIMIT 20),
worst AS (SELECT domain AS segment, aspect_raw AS top_negative FROM (SELECT domain, aspect_raw, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, aspect_raw) AS place FROM joined WHERE sentiment = 'negative' GROUP BY 1, 2) WHERE place = 1),
both_kinds AS (SELECT 'domain' AS kind, dom.*, top_negative FROM dom LEFT JOIN worst USING (segment) UNION ALL SELECT 'product', prod.*, NULL FROM prod)
SELECT kind, segment, reviews, mentions, 100.0::DOUBLE * negative / mentions AS negative_pct, top_negative FROM both_kinds ORDER BY negative_pct DESC, mentions DESC, kind, segment LIMIT 20"""))
def a08(spark, d):
    return A.segments(V.predictions(spark, d), V.reviews(spark, d), 20)


@R.add("A09_weekly_summary", with_views(IMPACT + """, top3 AS (SELECT aspect, row_number() OVER (ORDER BY round(s, 6) DESC, aspect) AS place FROM scored)
SELECT (SELECT strftime(now - INTERVAL 7 DAY, '%Y-%m-%d') || ' to ' || strftime(now, '%Y-%m-%d') FROM clock) AS period, (SELECT string_agg(aspect, ', ' ORDER BY place) FROM top3 WHERE place <= 3) AS drivers,
 (SELECT aspect FROM (SELECT * FROM board ORDER BY frequency DESC, aspect LIMIT 12) ORDER BY change_pct DESC, frequency DESC, aspect LIMIT 1) AS fastest"""))
def a09(spark, d):
    from pyspark.sql.window import Window

    b = board(spark, d)
    drivers = A.impact(b, 3).withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "aspect")))  # three rows
    drivers = drivers.agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("place", "aspect"))), lambda x: x["aspect"])).alias("drivers"))
    fastest = b.orderBy(F.desc("frequency"), "aspect").limit(12).orderBy(F.desc("change_pct"), F.desc("frequency"), "aspect").limit(1).select(F.col("aspect").alias("fastest"))
    now = spark.range(1).select(F.lit(V.clock(spark, d)).alias("now"))
    period = now.select(F.concat_ws(" to ", F.date_format(F.col("now") - F.expr("interval 7 days"), "yyyy-MM-dd"), F.date_format("now", "yyyy-MM-dd")).alias("period"))
    return period.crossJoin(drivers).crossJoin(fastest)


@R.add("A10_user_reviews_summary", with_views("""SELECT count(*) AS reviews, count(DISTINCT user_id) AS users, CAST(CAST(sum(rating) AS BIGINT) AS DOUBLE) / count(*) AS avg_rating,
 count(*) FILTER (recommendation)::DOUBLE / count(recommendation) AS recommendation_rate, count(*) FILTER (created_at >= (SELECT now FROM clock) - INTERVAL 7 DAY) AS last_7_days FROM user_reviews"""))
def a10(spark, d):
    return A.user_summary(V.user_reviews(spark, d))


EMERGING = """e_top AS (SELECT aspect FROM joined GROUP BY 1 ORDER BY count(*) DESC, aspect LIMIT 12), e_per AS (SELECT aspect, strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS mentions FROM joined JOIN e_top USING (aspect) GROUP BY 1, 2),
e_placed AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY bucket DESC) AS place FROM e_per),
e_found AS (SELECT aspect, CAST(sum(mentions) FILTER (place = 1) AS BIGINT) AS mentions, CAST(sum(mentions) FILTER (place BETWEEN 2 AND 8) AS BIGINT)::DOUBLE / count(*) FILTER (place BETWEEN 2 AND 8) AS baseline FROM e_placed WHERE place <= 8 GROUP BY 1),
rising AS (SELECT * FROM e_found WHERE mentions >= 3 AND mentions > 1.5::DOUBLE * baseline)"""


@R.add("A11_alerts", with_views(BOARD + ", " + EMERGING + """, top AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, change_pct DESC, aspect) AS place FROM board ORDER BY frequency DESC, change_pct DESC, aspect LIMIT 20),
scored AS (SELECT *, CASE WHEN stddev_pop(change_pct) OVER () > 0 THEN (change_pct - avg(change_pct) OVER ()) / stddev_pop(change_pct) OVER () ELSE 0 END AS z FROM top),
found AS (SELECT place, 1 AS kind, 'frequency_spike' AS type, aspect, 'high' AS severity, 'Frequency spike detected for ' || aspect AS message, round(greatest(change_pct, z), 2) AS value, CASE WHEN z >= 2 THEN 2.0::DOUBLE ELSE 50.0::DOUBLE END AS threshold FROM scored WHERE frequency >= 5 AND (change_pct >= 50 OR z >= 2)
 UNION ALL SELECT place, 2, 'negative_threshold', aspect, 'medium', 'Negative sentiment threshold breached for ' || aspect, round(negative_pct, 2), 45.0::DOUBLE FROM scored WHERE frequency >= 5 AND negative_pct >= 45
 UNION ALL SELECT 1000, 3, 'emerging_aspect', aspect, 'medium', 'Emerging issue detected: ' || aspect, mentions::DOUBLE, baseline FROM rising)
SELECT type, aspect, severity, message, value, threshold FROM found ORDER BY place, kind, aspect LIMIT 50"""))
def a11(spark, d):
    return A.alerts(board(spark, d), A.emerging(rows(spark, d, False), "day"))


@R.add("A12_dominant_sentiment", with_views("SELECT aspect_raw, sentiment AS dominant FROM (SELECT aspect_raw, sentiment, row_number() OVER (PARTITION BY aspect_raw ORDER BY count(*) DESC, sentiment) AS place FROM predictions GROUP BY 1, 2) WHERE place = 1"))
def a12(spark, d):
    return A.mode_sentiment(V.predictions(spark, d), "aspect_raw")


CACHE = "SELECT product_id, CAST(CAST(sum(rating) AS BIGINT) AS DOUBLE) / count(*) AS avg_rating, count(*) AS review_count, CAST(sum(helpful) AS BIGINT) AS helpful_count, max(created_at) AS latest_review_at FROM user_reviews WHERE NOT deleted GROUP BY 1"


@R.add("A15_product_cache", with_views(CACHE))
def a15(spark, d):
    return A.product_cache(V.user_reviews(spark, d))


@R.add("A16_product_cache_delta", with_views("SELECT product_id, round(CAST(CAST(sum(rating) AS BIGINT) AS DOUBLE) / count(*), 6) AS avg_rating, count(*) AS review_count, CAST(sum(helpful) AS BIGINT) AS helpful_count FROM user_reviews WHERE NOT deleted GROUP BY 1"))
def a16(spark, d):
    """The cache of older reviews, brought up to date with the newer ones alone."""
    live = V.user_reviews(spark, d).where("not deleted")
    newer = F.col("created_at") >= F.lit("2000-01-01").cast("timestamp")
    delta = live.where(newer).select("product_id", F.col("rating").alias("rating_delta"), F.lit(1).alias("review_delta"), F.col("helpful").alias("helpful_delta"))
    out = A.product_cache_delta(A.product_cache(live.where(~newer)).drop("latest_review_at"), delta)
    return out.withColumn("avg_rating", F.round("avg_rating", 6))


@R.add("A17_star_histogram", with_views("SELECT product_id, " + ", ".join(f"count(*) FILTER (rating = {k}) AS stars_{k}" for k in range(1, 6)) + " FROM user_reviews WHERE NOT deleted GROUP BY 1"))
def a17(spark, d):
    return V.user_reviews(spark, d).where("not deleted").groupBy("product_id").agg(*(A.count_if(F.col("rating") == k).alias(f"stars_{k}") for k in range(1, 6)))


for _interval, _sql in (("day", "strftime(created_at, '%Y-%m-%d')"), ("week", "strftime(created_at, '%G-W%V')")):
    MEASURES = "count(*) AS mentions, count(*) FILTER (sentiment = 'negative')::DOUBLE / count(*) AS negative_share, (count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative'))::DOUBLE / count(*) AS net_score"
    R.add(f"W01_trends_{_interval}", with_views(f"SELECT {_sql} AS bucket, {MEASURES} FROM joined GROUP BY 1"))(lambda spark, d, i=_interval: A.trends(rows(spark, d, False), i))
    R.add(f"W02_aspect_trends_{_interval}", with_views(f"top AS (SELECT aspect FROM joined GROUP BY 1 ORDER BY count(*) DESC, aspect LIMIT 12) SELECT aspect, {_sql} AS bucket, {MEASURES} FROM joined JOIN top USING (aspect) GROUP BY 1, 2"))(
        lambda spark, d, i=_interval: A.trends(rows(spark, d, False).join(F.broadcast(A.top_aspects(rows(spark, d, False), 12).select("aspect")), "aspect"), i, "aspect")
    )


@R.add("W03_emerging_aspects", with_views("""top AS (SELECT aspect FROM joined GROUP BY 1 ORDER BY count(*) DESC, aspect LIMIT 12), per AS (SELECT aspect, strftime(created_at, '%G-W%V') AS bucket, count(*) AS mentions FROM joined JOIN top USING (aspect) GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY bucket DESC) AS place FROM per),
found AS (SELECT aspect, max(bucket) FILTER (place = 1) AS bucket, CAST(sum(mentions) FILTER (place = 1) AS BIGINT) AS mentions, CAST(sum(mentions) FILTER (place BETWEEN 2 AND 8) AS BIGINT)::DOUBLE / count(*) FILTER (place BETWEEN 2 AND 8) AS baseline FROM placed WHERE place <= 8 GROUP BY 1)
SELECT *, mentions / baseline AS lift FROM found WHERE mentions >= 3 AND mentions > 1.5::DOUBLE * baseline"""))
def w03(spark, d):
    return A.emerging(rows(spark, d, False), "week")


@R.add("R05_sliding_windows", "SELECT w AS window_start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT *, unnest(range(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS w FROM events) GROUP BY 1, 2")
def r05(spark, d):
    """Seven-day windows that start every day."""
    events = V.table(spark, d, "events")
    return events.groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("window_start"), "event_type", "n", "users")
