"""Aggregates over reviews and predictions: distributions, leaderboards, trends, alerts, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SENTIMENTS = ("positive", "neutral", "negative")


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def sentiment_counts() -> list[Column]:
    return [count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS]


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part.cast("double") / whole).otherwise(0.0)


def wilson(p: Column, n: Column, upper: bool, z: float = 1.96) -> Column:
    """A bound of the Wilson interval (95 %) of a share, within [0, 1]."""
    z2 = z * z
    centre = p + z2 / (2 * n)
    margin = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    bound = (centre + margin if upper else centre - margin) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound))).otherwise(0.0)


def scan(predictions: DataFrame, reviews: DataFrame, domain: str | None = None, sentiment: str | None = None, aspect: str | None = None, start=None, end=None) -> DataFrame:
    """Predictions with their review; a filter of None is off, both time bounds are inclusive."""
    rows = predictions.join(reviews, "review_id")
    for column, value in (("domain", domain), ("sentiment", sentiment), ("aspect", aspect)):
        if value:
            rows = rows.where(F.col(column) == value)
    if start is not None:
        rows = rows.where(F.col("created_at") >= start)
    if end is not None:
        rows = rows.where(F.col("created_at") <= end)
    return rows


def overview(predictions: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: reviews (also those without predictions), mentions, raw aspects, mean confidence, sentiments."""
    own = reviews.agg(F.count(F.lit(1)).alias("reviews"))
    rows = predictions.agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("aspect_raw").alias("unique_aspects"), (F.sum("conf").cast("double") / F.count("conf") / 100).alias("avg_confidence"), *sentiment_counts())
    return own.crossJoin(rows)  # two single rows


def distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("aspect").agg(F.count(F.lit(1)).alias("total"), *sentiment_counts())


def top_aspects(rows: DataFrame, limit: int) -> DataFrame:
    return rows.groupBy("aspect").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "aspect").limit(limit)


def leaderboard(rows: DataFrame, reviews: DataFrame, days: int, limit: int, now) -> DataFrame:
    """The period up to ``now`` against the one before, both inclusive at both ends; the denominator is half-open and counts all reviews.

    ``now`` is a value, so that the period's bounds reach the scan of reviews."""
    at = F.lit(now).cast(reviews.schema["created_at"].dataType)
    span, two = F.expr(f"interval {days} days"), F.expr(f"interval {2 * days} days")
    base = reviews.where((F.col("created_at") >= at - span) & (F.col("created_at") < at)).agg(F.count(F.lit(1)).alias("base"))
    timed = rows.where(F.col("created_at") >= at - two)
    current = F.col("created_at") >= at - span
    before = F.col("created_at") <= at - span
    counted = timed.groupBy("aspect").agg(
        count_if(current).alias("frequency"), count_if(before).alias("previous"),
        *(count_if(current & (F.col("sentiment") == s)).alias(s) for s in SENTIMENTS), count_if(current & (F.col("source") == "implicit")).alias("implicit"),
    ).where("frequency > 0").crossJoin(F.broadcast(base))
    share = F.col("negative").cast("double") / F.col("frequency")
    change = F.when(F.col("previous") > 0, 100.0 * (F.col("frequency") - F.col("previous")).cast("double") / F.col("previous")).otherwise(100.0)
    top = counted.orderBy(F.desc("frequency"), "aspect").limit(limit)
    n = F.col("frequency").cast("double")
    return top.select(
        "aspect", "frequency", percent(F.col("frequency"), F.col("base")).alias("per_100_reviews"), percent(F.col("positive"), F.col("frequency")).alias("positive_pct"), percent(F.col("negative"), F.col("frequency")).alias("negative_pct"),
        percent(F.col("positive") - F.col("negative"), F.col("frequency")).alias("net_sentiment"), change.alias("change_pct"), F.round(wilson(share, n, False), 6).alias("ci_low"), F.round(wilson(share, n, True), 6).alias("ci_high"), percent(F.col("implicit"), F.col("frequency")).alias("implicit_pct"),
    )


def impact(board: DataFrame, limit: int) -> DataFrame:
    score = F.col("frequency") * F.col("negative_pct") / 100.0 * (1 + F.greatest(F.lit(0.0), F.col("change_pct") / 100.0))
    return board.select("aspect", "frequency", F.round(score, 6).alias("priority"), F.when(score >= 8, "high").when(score >= 3, "medium").otherwise("low").alias("tier")).orderBy(F.desc("priority"), "aspect").limit(limit)


def dashboard(rows: DataFrame) -> DataFrame:
    """The negative share of all mentions, and the aspect with the largest among the 100 most mentioned."""
    top = distribution(rows).orderBy(F.desc("total"), "aspect").limit(100)
    share = F.col("negative").cast("double") / F.col("total")
    worst = top.orderBy(F.desc(share), F.desc("negative"), "aspect").limit(1).select(F.col("aspect").alias("worst_aspect"))
    return rows.agg(F.count(F.lit(1)).alias("mentions"), percent(count_if(F.col("sentiment") == "negative"), F.count(F.lit(1))).alias("negative_pct")).crossJoin(worst)


def segments(predictions: DataFrame, reviews: DataFrame, limit: int) -> DataFrame:
    """Domains and the most mentioned products, most negative first; for a domain also its first negative raw aspect."""
    negative = F.col("sentiment") == "negative"
    # mentions are counted by review before they meet it, so that what is joined is a row for each review
    own = predictions.groupBy("review_id").agg(F.count(F.lit(1)).alias("own"), count_if(negative).alias("bad")).join(reviews, "review_id")

    def by(column: str) -> DataFrame:
        return own.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("segment")).agg(F.count(F.lit(1)).alias("reviews"), F.sum("own").alias("mentions"), F.sum("bad").alias("negative"))

    worst = predictions.where(negative).join(reviews.select("review_id", "domain"), "review_id").groupBy(F.coalesce("domain", F.lit("unknown")).alias("segment"), "aspect_raw").agg(F.count(F.lit(1)).alias("n"))
    worst = worst.groupBy("segment").agg(F.min_by("aspect_raw", F.struct(-F.col("n"), "aspect_raw")).alias("top_negative"))
    domains = by("domain").join(worst, "segment", "left").withColumn("kind", F.lit("domain"))
    products = by("product_id").orderBy(F.desc("mentions"), "segment").limit(limit).withColumn("kind", F.lit("product")).withColumn("top_negative", F.lit(None).cast("string"))
    both = domains.unionByName(products).withColumn("negative_pct", percent(F.col("negative"), F.col("mentions")))
    return both.select("kind", "segment", "reviews", "mentions", "negative_pct", "top_negative").orderBy(F.desc("negative_pct"), F.desc("mentions"), "kind", "segment").limit(limit)


def bucket(interval: str) -> Column:
    """The day, or the ISO week (the year of its Thursday)."""
    if interval == "day":
        return F.date_format("created_at", "yyyy-MM-dd")
    return F.format_string("%04d-W%02d", F.expr("extract(yearofweek from created_at)").cast("int"), F.weekofyear("created_at"))


def trends(rows: DataFrame, interval: str, *keys: str) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(*keys, bucket(interval).alias("bucket")).agg(
        n.alias("mentions"), (count_if(F.col("sentiment") == "negative").cast("double") / n).alias("negative_share"),
        ((count_if(F.col("sentiment") == "positive") - count_if(F.col("sentiment") == "negative")).cast("double") / n).alias("net_score"))


def emerging(rows: DataFrame, interval: str, lookback: int = 7, least: int = 3, lift: float = 1.5, among: int = 12) -> DataFrame:
    """Aspects whose last bucket has so many mentions and more than lift times the mean of the existing buckets before."""
    top = top_aspects(rows, among).select("aspect")
    counted = trends(rows.join(F.broadcast(top), "aspect"), interval, "aspect")
    last = Window.partitionBy("aspect").orderBy(F.desc("bucket"))
    placed = counted.withColumn("place", F.row_number().over(last)).where(F.col("place") <= lookback + 1)
    found = placed.groupBy("aspect").agg(
        F.max(F.when(F.col("place") == 1, F.col("bucket"))).alias("bucket"), F.sum(F.when(F.col("place") == 1, F.col("mentions"))).alias("mentions"),
        F.sum(F.when(F.col("place") > 1, F.col("mentions"))).alias("earlier"), count_if(F.col("place") > 1).alias("buckets"))
    baseline = F.col("earlier").cast("double") / F.col("buckets")
    return found.where((F.col("buckets") > 0) & (F.col("mentions") >= least) & (F.col("mentions") > lift * baseline)).select("aspect", "bucket", "mentions", baseline.alias("baseline"), (F.col("mentions") / baseline).alias("lift"))


def alerts(board: DataFrame, rising: DataFrame, limit: int = 50) -> DataFrame:
    """Of the 20 first of a leaderboard with five mentions or more: spikes (change of 50 % or a z-score of 2) and negative shares of 45 %; then the emerging aspects."""
    top = board.orderBy(F.desc("frequency"), F.desc("change_pct"), "aspect").limit(20)
    place = F.row_number().over(Window.orderBy(F.desc("frequency"), F.desc("change_pct"), "aspect"))  # 20 rows
    stats = top.agg(F.avg("change_pct").alias("mean"), F.stddev_pop("change_pct").alias("sigma"))
    z = F.when(F.col("sigma") > 0, (F.col("change_pct") - F.col("mean")) / F.col("sigma")).otherwise(0.0)
    enough = top.withColumn("place", place).crossJoin(stats).withColumn("z", z).where("frequency >= 5")

    def kind(rows: DataFrame, name: str, order: int, severity: str, message: str, value: Column, threshold: Column) -> DataFrame:
        return rows.select("place", F.lit(order).alias("kind"), F.lit(name).alias("type"), "aspect", F.lit(severity).alias("severity"), F.concat(F.lit(message), "aspect").alias("message"), F.round(value.cast("double"), 2).alias("value"), threshold.cast("double").alias("threshold"))

    found = kind(enough.where("change_pct >= 50 or z >= 2"), "frequency_spike", 1, "high", "Frequency spike detected for ", F.greatest("change_pct", "z"), F.when(F.col("z") >= 2, 2.0).otherwise(50.0))
    found = found.unionByName(kind(enough.where("negative_pct >= 45"), "negative_threshold", 2, "medium", "Negative sentiment threshold breached for ", F.col("negative_pct"), F.lit(45.0)))
    found = found.unionByName(kind(rising.withColumn("place", F.lit(1000)), "emerging_aspect", 3, "medium", "Emerging issue detected: ", F.col("mentions"), F.col("baseline")))
    return found.orderBy("place", "kind", "aspect").limit(limit).drop("place", "kind")


def user_summary(user_reviews: DataFrame) -> DataFrame:
    now = user_reviews.agg(F.max("created_at").alias("now"))
    rated = F.col("recommendation").isNotNull()
    return user_reviews.crossJoin(F.broadcast(now)).agg(
        F.count(F.lit(1)).alias("reviews"), F.countDistinct("user_id").alias("users"), (F.sum("rating").cast("double") / F.count(F.lit(1))).alias("avg_rating"),
        (count_if(F.col("recommendation")).cast("double") / count_if(rated)).alias("recommendation_rate"), count_if(F.col("created_at") >= F.col("now") - F.expr("interval 7 days")).alias("last_7_days"))


def product_cache(user_reviews: DataFrame) -> DataFrame:
    return user_reviews.where("not deleted").groupBy("product_id").agg(
        (F.sum("rating").cast("double") / F.count(F.lit(1))).alias("avg_rating"), F.count(F.lit(1)).alias("review_count"), F.sum("helpful").alias("helpful_count"), F.max("created_at").alias("latest_review_at"))


def product_cache_delta(cache: DataFrame, delta: DataFrame) -> DataFrame:
    """The cache after a batch of changes (product_id, rating_delta, review_delta, helpful_delta), without a scan of the reviews; counts do not fall below 0."""
    changes = delta.groupBy("product_id").agg(*(F.sum(c).alias(c) for c in ("rating_delta", "review_delta", "helpful_delta")))
    joined = cache.join(changes, "product_id", "full_outer").na.fill(0, ["review_count", "helpful_count", "rating_delta", "review_delta", "helpful_delta"]).na.fill(0.0, ["avg_rating"])
    count = F.greatest(F.lit(0), F.col("review_count") + F.col("review_delta"))
    total = F.col("avg_rating") * F.col("review_count") + F.col("rating_delta")
    return joined.select("product_id", F.when(count > 0, total / count).otherwise(0.0).alias("avg_rating"), count.cast("long").alias("review_count"), F.greatest(F.lit(0), F.col("helpful_count") + F.col("helpful_delta")).cast("long").alias("helpful_count"))


def mode_sentiment(rows: DataFrame, *keys: str) -> DataFrame:
    """The most frequent sentiment of each group; ties go to the first by name."""
    counted = rows.groupBy(*keys, "sentiment").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy(*keys).orderBy(F.desc("n"), "sentiment")
    return counted.withColumn("place", F.row_number().over(place)).where("place = 1").select(*keys, F.col("sentiment").alias("dominant"))
