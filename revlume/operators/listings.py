"""Listings, semi and anti joins, set operations and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SORTS = {"recent": "latest_review_at", "highest": "avg_rating", "helpful": "helpful_count", "reviews": "review_count"}


def search_products(cache: DataFrame, catalog: DataFrame, text: str = "", least_rating: float = 0, sort: str = "recent", limit: int = 50, offset: int = 0) -> DataFrame:
    """Products whose name or category holds the text, with their cached measures; 1 to 100 rows."""
    rows = catalog.join(cache, "product_id", "left").na.fill(0, ["review_count", "helpful_count"]).na.fill(0.0, ["avg_rating"])
    if text:
        rows = rows.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("category"), F.lit(text.lower())))
    order = F.asc("avg_rating") if sort == "lowest" else F.desc_nulls_last(SORTS[sort])
    return rows.where(F.col("avg_rating") >= least_rating).orderBy(order, F.desc("review_count"), "product_id").offset(offset).limit(max(1, min(100, limit)))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(max(1, min(most, limit)))


def first_by(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; the limit of the window applies before the shuffle, if one is needed."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def not_in_catalog(facts: DataFrame, catalog: DataFrame, key: str, limit: int = 500) -> DataFrame:
    return facts.join(catalog, key, "left_anti").select(key).distinct().orderBy(key).limit(limit)


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their child rows as an ordered array."""
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(nested, key, "left")


def sync(current: DataFrame, generated: DataFrame, dismissed: DataFrame, key: str = "signature") -> DataFrame:
    """What a merge of generated rows into current ones does: insert, update or delete; dismissed ones are not generated."""
    live = generated.join(dismissed.select(key), key, "left_anti").select(key, F.lit(True).alias("new"))
    both = current.select(key, F.lit(True).alias("old")).join(live, key, "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return both.select(key, action.alias("action"))


def signature(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts)), 256)


def merge_predictions(explicit: DataFrame, implicit: DataFrame, keys: list[str], score: str = "conf", margin: int = 5) -> DataFrame:
    """One row of each key: the explicit one unless an implicit one is surer by more than the margin."""
    best_e = explicit.groupBy(*keys).agg(F.max(score).alias("e"))
    best_i = implicit.groupBy(*keys).agg(F.max(score).alias("i"))
    both = best_e.join(best_i, keys, "full_outer")
    explicit_wins = F.col("i").isNull() | (F.col("e") >= F.col("i") - margin)
    wins = F.coalesce(explicit_wins & F.col("e").isNotNull(), F.lit(False))
    return both.select(*keys, F.when(wins, "explicit").otherwise("implicit").alias("source"), F.when(wins, F.col("e")).otherwise(F.col("i")).alias(score))
