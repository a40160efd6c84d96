"""The binding views: reviews, predictions and the like over the given tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlume.functions import text as X
from revlume.plans.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, domain: bool = True) -> DataFrame:
    """review_id, created_at, domain (if asked for: it takes a join), product_id. Every order has its customer."""
    orders = table(spark, sf_dir, "orders")
    own = (F.col("o_orderkey").alias("review_id"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("product_id"))
    if not domain:
        return orders.select(*own)
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(*own[:2], F.col("c_mktsegment").alias("domain"), own[2])


def clock(spark: SparkSession, sf_dir: str):
    """The time of the last review."""
    return table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, aspect_cluster, aspect_raw, sentiment, conf (hundredths), source, position; aspect is the canonical label."""
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sentiment = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "N", "neutral").otherwise("negative")
    # the label depends on the product alone: made once for each, not for each mention
    labels = part.select("p_partkey", "p_type", "p_name", X.canonical_aspect(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("p_type"), F.col("p_name")).alias("aspect"))
    return lineitem.join(labels, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("review_id"), F.col("p_type").alias("aspect_cluster"), F.col("p_name").alias("aspect_raw"), sentiment.alias("sentiment"),
        F.round((1 - F.col("l_discount")) * 100).cast("long").alias("conf"), F.when(F.col("l_linestatus") == "O", "explicit").otherwise("implicit").alias("source"), F.col("l_linenumber").alias("position"), "aspect",
    )


def by_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions dealt by review, for steps that sort them within one."""
    return spread(predictions(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "review_id")


def user_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, product_id, rating, recommendation, helpful, created_at, deleted."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 97).alias("product_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("recommendation"), (F.col("o_orderkey") % 7).alias("helpful"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 11 == 0).alias("deleted"),
    )


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits)


#: The same views for the oracle, as common table expressions.
SQL = """
reviews AS (SELECT o_orderkey AS review_id, o_orderdate AS created_at, c_mktsegment AS domain, o_custkey AS product_id FROM orders JOIN customer ON o_custkey = c_custkey),
predictions AS (SELECT l_orderkey AS review_id, p_type AS aspect_cluster, p_name AS aspect_raw,
  CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END AS sentiment,
  CAST(round((1 - l_discount) * 100) AS BIGINT) AS conf, CASE l_linestatus WHEN 'O' THEN 'explicit' ELSE 'implicit' END AS source, l_linenumber AS position,
  upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS aspect FROM lineitem JOIN part ON l_partkey = p_partkey),
user_reviews AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 97 AS product_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating,
  CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS recommendation, o_orderkey % 7 AS helpful, o_orderdate AS created_at, o_orderkey % 11 = 0 AS deleted FROM orders),
joined AS (SELECT p.*, r.created_at, r.domain, r.product_id FROM predictions p JOIN reviews r USING (review_id)),
clock AS (SELECT max(created_at) AS now FROM reviews)
"""


def with_views(sql: str) -> str:
    return f"WITH {SQL.strip()}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{sql.strip()}"
