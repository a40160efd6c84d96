"""Listings, joins, set operations and merges over the binding views."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlume.operators import analytics as A
from revlume.operators import listings as L
from revlume.plans import views as V
from revlume.plans.analytics import CACHE, rows
from revlume.plans.registry import Registry
from revlume.plans.views import with_views

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def catalog(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"))


SEARCH = f"c AS ({CACHE}), s AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS category, coalesce(avg_rating, 0.0::DOUBLE) AS avg_rating, coalesce(review_count, 0) AS review_count, coalesce(helpful_count, 0) AS helpful_count, latest_review_at FROM part LEFT JOIN c ON p_partkey = c.product_id)"
for _sort, _order in (("recent", "latest_review_at DESC NULLS LAST"), ("highest", "avg_rating DESC"), ("lowest", "avg_rating"), ("helpful", "helpful_count DESC"), ("reviews", "review_count DESC")):
    R.add(f"T01_search_products_{_sort}", with_views(f"{SEARCH} SELECT * FROM s WHERE (contains(lower(name), 'red') OR contains(lower(category), 'red')) ORDER BY {_order}, review_count DESC, product_id LIMIT 50 OFFSET 5"))(
        lambda spark, d, s=_sort: L.search_products(A.product_cache(V.user_reviews(spark, d)), catalog(spark, d), "red", 0, s, 50, 5)
    )


@R.add("T02_product_reviews", with_views("SELECT id, user_id, rating, helpful, created_at FROM user_reviews WHERE product_id = 5 AND rating >= 2 AND NOT deleted ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20"))
def t02(spark, d):
    own = V.user_reviews(spark, d).where("product_id = 5 and rating >= 2 and not deleted").select("id", "user_id", "rating", "helpful", "created_at")
    return L.page(own, [F.desc("created_at"), F.desc("id")], 20, 20)


@R.add("T03_product_suggestions", with_views("""recent AS (SELECT product_id FROM user_reviews WHERE user_id = 7 GROUP BY 1 ORDER BY max(created_at) DESC, product_id LIMIT 8),
most AS (SELECT product_id, count(*) AS n FROM user_reviews GROUP BY 1 ORDER BY n DESC, product_id LIMIT 12) SELECT * FROM most WHERE product_id NOT IN (SELECT product_id FROM recent) ORDER BY n DESC, product_id LIMIT 8"""))
def t03(spark, d):
    u = V.user_reviews(spark, d)
    recent = u.where("user_id = 7").groupBy("product_id").agg(F.max("created_at").alias("t")).orderBy(F.desc("t"), "product_id").limit(8)
    most = u.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "product_id").limit(12)
    return most.join(recent, "product_id", "left_anti").orderBy(F.desc("n"), "product_id").limit(8)


@R.add("T04_user_reviews_page", with_views("SELECT id, user_id, product_id, rating, (SELECT count(*) FROM user_reviews WHERE rating BETWEEN 2 AND 4) AS total FROM user_reviews WHERE rating BETWEEN 2 AND 4 ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100"))
def t04(spark, d):
    own = V.user_reviews(spark, d).where("rating between 2 and 4")
    return L.page(own.select("id", "user_id", "product_id", "rating", "created_at"), [F.desc("created_at"), F.desc("id")], 50, 100).drop("created_at").crossJoin(own.agg(F.count(F.lit(1)).alias("total")))


@R.add("T05_needs_review", with_views("SELECT DISTINCT review_id, domain, created_at, conf FROM joined WHERE conf < 92 ORDER BY created_at DESC, review_id DESC, conf LIMIT 100"))
def t05(spark, d):
    return L.page(rows(spark, d).where("conf < 92").select("review_id", "domain", "created_at", "conf").distinct(), [F.desc("created_at"), F.desc("review_id"), F.asc("conf")], 100)


@R.add("T06_evidence_drilldown", with_views("SELECT DISTINCT review_id, aspect_raw, conf, position, created_at FROM joined WHERE aspect = 'Promo' AND sentiment = 'negative' ORDER BY created_at DESC, review_id DESC, position, aspect_raw, conf LIMIT 50"))
def t06(spark, d):
    own = A.scan(V.predictions(spark, d), V.reviews(spark, d), aspect="Promo", sentiment="negative").select("review_id", "aspect_raw", "conf", "position", "created_at").distinct()
    return L.page(own, [F.desc("created_at"), F.desc("review_id"), F.asc("position"), F.asc("aspect_raw"), F.asc("conf")], 50)


@R.add("T07_aspect_detail", with_views("""mine AS (SELECT DISTINCT review_id FROM joined WHERE aspect = 'Promo'),
co AS (SELECT aspect, count(*) AS n FROM joined WHERE review_id IN (SELECT review_id FROM mine) AND aspect <> 'Promo' GROUP BY 1 ORDER BY n DESC, aspect LIMIT 12)
SELECT 'sentiment' AS kind, sentiment AS name, count(*) AS n FROM joined WHERE aspect = 'Promo' GROUP BY 2 UNION ALL SELECT 'origin', source, count(*) FROM joined WHERE aspect = 'Promo' GROUP BY 2 UNION ALL SELECT 'co_mentioned', aspect, n FROM co"""))
def t07(spark, d):
    all_rows = rows(spark, d)
    own = all_rows.where("aspect = 'Promo'")
    n = F.count(F.lit(1)).alias("n")
    co = all_rows.where("aspect <> 'Promo'").join(own.select("review_id").distinct(), "review_id", "left_semi").groupBy(F.col("aspect").alias("name")).agg(n).orderBy(F.desc("n"), "name").limit(12)
    parts = (("sentiment", own.groupBy(F.col("sentiment").alias("name")).agg(n)), ("origin", own.groupBy(F.col("source").alias("name")).agg(n)), ("co_mentioned", co))
    first, *rest = (p.select(F.lit(k).alias("kind"), "name", "n") for k, p in parts)
    for p in rest:
        first = first.unionByName(p)
    return first


@R.add("T10_my_reviews", with_views("SELECT id, product_id, rating, created_at FROM user_reviews WHERE user_id = 7 AND NOT deleted ORDER BY created_at DESC, id DESC LIMIT 200"))
def t10(spark, d):
    return L.page(V.user_reviews(spark, d).where("user_id = 7 and not deleted").select("id", "product_id", "rating", "created_at"), [F.desc("created_at"), F.desc("id")], 200)


@R.add("W05_first_evidence", with_views("SELECT review_id, aspect_raw, conf FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY position, aspect_raw, conf) AS place FROM predictions) WHERE place = 1"))
def w05(spark, d):
    return L.first_by(V.by_review(spark, d), ["review_id"], [F.asc("position"), F.asc("aspect_raw"), F.asc("conf")]).select("review_id", "aspect_raw", "conf")


@R.add("W06_top_six_per_review", with_views("SELECT DISTINCT review_id, aspect_raw, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY conf DESC, aspect_raw, sentiment) AS place FROM predictions) WHERE place <= 6"))
def w06(spark, d):
    return L.first_by(V.by_review(spark, d), ["review_id"], [F.desc("conf"), F.asc("aspect_raw"), F.asc("sentiment")], 6).select("review_id", "aspect_raw", "sentiment").distinct()


@R.add("W08_stable_sample", "SELECT doc_id FROM (SELECT doc_id, sha256('42|' || doc_id::VARCHAR) AS h FROM documents) ORDER BY h LIMIT 100")
def w08(spark, d):
    """A sample that a seed fixes: the first by a hash of seed and id."""
    return V.table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("42|"), F.col("doc_id").cast("string")), 256).alias("h")).orderBy("h").limit(100).select("doc_id")


@R.add("J01_predictions_with_review", with_views("SELECT review_id, aspect_raw, sentiment, conf, position, domain, product_id, created_at FROM joined"))
def j01(spark, d):
    return rows(spark, d).select("review_id", "aspect_raw", "sentiment", "conf", "position", "domain", "product_id", "created_at")


@R.add("J02_reviews_left_catalog", with_views("SELECT id, u.product_id, p_name AS name FROM user_reviews u LEFT JOIN part ON p_partkey = u.product_id AND p_size > 10"))
def j02(spark, d):
    some = V.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    return V.user_reviews(spark, d).join(some, "product_id", "left").select("id", "product_id", "name")


@R.add("J03_reviews_without_predictions", with_views("SELECT DISTINCT r.review_id FROM reviews r LEFT JOIN predictions p USING (review_id) WHERE p.aspect IS NULL ORDER BY 1 LIMIT 500"))
def j03(spark, d):
    return L.not_in_catalog(V.reviews(spark, d), V.predictions(spark, d), "review_id")


@R.add("J04_reviews_with_predictions", with_views("SELECT review_id, domain FROM reviews r WHERE EXISTS (SELECT 1 FROM predictions p WHERE p.review_id = r.review_id)"))
def j04(spark, d):
    return V.reviews(spark, d).join(V.predictions(spark, d), "review_id", "left_semi").select("review_id", "domain")


@R.add("J05_disjunctive_semi_join", with_views("SELECT product_id, name FROM (SELECT p_partkey AS product_id, p_name AS name FROM part) WHERE contains(name, 'red') OR product_id IN (SELECT product_id FROM user_reviews WHERE rating = 5)"))
def j05(spark, d):
    keys = V.user_reviews(spark, d).where("rating = 5").select("product_id", F.lit(True).alias("hit")).distinct()
    return catalog(spark, d).join(keys, "product_id", "left").where(F.contains("name", F.lit("red")) | F.col("hit")).select("product_id", "name")


@R.add("J06_reply_threads", "SELECT c.conv_id, c.turn, c.role, p.role AS parent_role, length(p.text) AS parent_chars FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def j06(spark, d):
    c = V.table(spark, d, "conversations")
    parent = c.select(F.col("conv_id"), (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"), F.length("text").cast("long").alias("parent_chars"))
    return c.select("conv_id", "turn", "role").join(parent, ["conv_id", "turn"], "left")


@R.add("J07_three_way_join", with_views("SELECT id, c_name AS username, p_name AS product FROM user_reviews JOIN customer ON c_custkey = user_id LEFT JOIN part ON p_partkey = product_id"))
def j07(spark, d):
    users = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return V.user_reviews(spark, d).join(users, "user_id").join(catalog(spark, d), "product_id", "left").select("id", "username", F.col("name").alias("product"))


@R.add("J08_nested_children", with_views("SELECT review_id, domain, n, raws FROM reviews LEFT JOIN (SELECT review_id, count(*) AS n, string_agg(aspect_raw, ',' ORDER BY position, aspect_raw) AS raws FROM predictions GROUP BY 1) USING (review_id)"))
def j08(spark, d):
    nested = L.with_children(V.reviews(spark, d).select("review_id", "domain"), V.predictions(spark, d), "review_id", ["position", "aspect_raw"], "c")
    return nested.select("review_id", "domain", F.when(F.col("c").isNotNull(), F.size("c")).cast("long").alias("n"), F.array_join(F.transform("c", lambda x: x["aspect_raw"]), ",").alias("raws"))


@R.add("J11_dictionary_lookup", with_views("SELECT aspect_raw, coalesce(m.cluster, aspect_raw) AS cluster, count(*) AS n FROM predictions LEFT JOIN (SELECT p_name AS k, min(p_type) AS cluster FROM part WHERE p_size < 25 AND p_name LIKE 'r%' GROUP BY 1) m ON k = aspect_raw GROUP BY 1, 2"))
def j11(spark, d):
    mapping = V.table(spark, d, "part").where("p_size < 25 and p_name like 'r%'").groupBy(F.col("p_name").alias("aspect_raw")).agg(F.min("p_type").alias("to"))
    return V.predictions(spark, d).groupBy("aspect_raw").agg(F.count(F.lit(1)).alias("n")).join(mapping, "aspect_raw", "left").select("aspect_raw", F.coalesce("to", "aspect_raw").alias("cluster"), "n")


@R.add("U01_union_all", with_views("SELECT 'domain' AS kind, domain AS value, count(*) AS n FROM reviews GROUP BY 2 UNION ALL SELECT 'product', product_id::VARCHAR, count(*) FROM reviews GROUP BY 2"))
def u01(spark, d):
    r = V.reviews(spark, d)
    own = lambda k, c: r.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "value", "n")
    return own("domain", "domain").unionByName(own("product", "product_id"))


@R.add("U02_filter_options", with_views("SELECT product_id, min(rank) AS first_source FROM (SELECT product_id, 1 AS rank FROM reviews UNION ALL SELECT product_id, 2 FROM user_reviews UNION ALL SELECT p_partkey, 3 FROM part) GROUP BY 1"))
def u02(spark, d):
    """Distinct product ids of three tables, each with the first that has it."""
    parts = [V.reviews(spark, d).select("product_id"), V.user_reviews(spark, d).select("product_id"), catalog(spark, d).select("product_id")]
    first, *rest = (p.withColumn("rank", F.lit(k)) for k, p in enumerate(parts, 1))
    for p in rest:
        first = first.unionByName(p)
    return first.groupBy("product_id").agg(F.min("rank").alias("first_source"))


@R.add("U03_alert_merge", with_views("""g AS (SELECT sha256('spike|' || lower(aspect_raw) || '|') AS signature FROM predictions GROUP BY aspect_raw HAVING count(*) % 2 = 0), c AS (SELECT sha256('spike|' || lower(aspect_raw) || '|') AS signature FROM predictions WHERE position = 1 GROUP BY aspect_raw HAVING count(*) % 3 <> 0),
x AS (SELECT sha256('spike|' || lower(aspect_raw) || '|') AS signature FROM predictions GROUP BY aspect_raw HAVING count(*) % 5 = 0), live AS (SELECT signature FROM g WHERE signature NOT IN (SELECT signature FROM x))
SELECT coalesce(c.signature, live.signature) AS signature, CASE WHEN c.signature IS NULL THEN 'insert' WHEN live.signature IS NULL THEN 'delete' ELSE 'update' END AS action FROM c FULL JOIN live ON c.signature = live.signature"""))
def u03(spark, d):
    p = V.predictions(spark, d)
    own = lambda rows, keep: rows.groupBy("aspect_raw").agg(F.count(F.lit(1)).alias("n")).where(keep).select(L.signature(F.lit("spike"), F.col("aspect_raw"), F.lit("")).alias("signature"))
    return L.sync(own(p.where("position = 1"), "n % 3 <> 0"), own(p, "n % 2 = 0"), own(p, "n % 5 = 0"))


@R.add("T12_merge_predictions", with_views("""e AS (SELECT review_id, aspect, sentiment, max(conf) AS e FROM predictions WHERE source = 'explicit' GROUP BY ALL), i AS (SELECT review_id, aspect, sentiment, max(conf) AS i FROM predictions WHERE source = 'implicit' GROUP BY ALL)
SELECT review_id, aspect, sentiment, CASE WHEN e IS NOT NULL AND (i IS NULL OR e >= i - 5) THEN 'explicit' ELSE 'implicit' END AS source, CASE WHEN e IS NOT NULL AND (i IS NULL OR e >= i - 5) THEN e ELSE i END AS conf FROM e FULL JOIN i USING (review_id, aspect, sentiment)"""))
def t12(spark, d):
    p = V.predictions(spark, d)
    return L.merge_predictions(p.where("source = 'explicit'"), p.where("source = 'implicit'"), ["review_id", "aspect", "sentiment"])


@R.add("U11_distinct_items", "SELECT conv_id, min(turn) AS first_turn, count(DISTINCT text) AS texts FROM conversations GROUP BY 1")
def u11(spark, d):
    c = V.table(spark, d, "conversations").dropDuplicates(["conv_id", "text"])
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("texts")).join(V.table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn")), "conv_id")


@R.add("T13_ranked_suggestions", "SELECT aspect_raw FROM (SELECT DISTINCT p_name AS aspect_raw FROM part) WHERE contains(aspect_raw, 'ge') ORDER BY CASE WHEN starts_with(aspect_raw, 'ge') THEN 0 ELSE 1 END, aspect_raw LIMIT 8")
def t13(spark, d):
    own = V.table(spark, d, "part").select(F.col("p_name").alias("aspect_raw")).distinct().where(F.contains("aspect_raw", F.lit("ge")))
    return own.orderBy(F.when(F.startswith("aspect_raw", F.lit("ge")), 0).otherwise(1), "aspect_raw").limit(8)


@R.add("F19_client_filters", with_views("SELECT review_id, aspect_raw, conf FROM predictions WHERE contains(lower(aspect_raw), 'gear') AND conf < 95 AND sentiment = 'negative'"))
def f19(spark, d):
    return V.predictions(spark, d).where(F.contains(F.lower("aspect_raw"), F.lit("gear")) & (F.col("conf") < 95) & (F.col("sentiment") == "negative")).select("review_id", "aspect_raw", "conf")


@R.add("F02_filtered_scan", with_views("SELECT DISTINCT review_id, aspect, sentiment, created_at, conf FROM joined WHERE domain = 'BUILDING' AND sentiment = 'negative' AND created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'"))
def f02(spark, d):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return A.scan(V.predictions(spark, d), V.reviews(spark, d), domain="BUILDING", sentiment="negative", start=stamp("1996-01-01"), end=stamp("1997-01-01")).select("review_id", "aspect", "sentiment", "created_at", "conf").distinct()
