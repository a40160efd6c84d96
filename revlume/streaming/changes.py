"""Structured Streaming: product aggregates from a change feed, windows over events, an aspect memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from revlume.operators import analytics as A
from revlume.operators import etl as E
from revlume.operators import published as P


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


CACHE = "product_id long, avg_rating double, review_count long, helpful_count long"


def maintain_product_cache(changes: DataFrame, folder: str, checkpoint: str, buckets: int = P.BUCKETS) -> StreamingQuery:
    """Apply batches of (product_id, rating_delta, review_delta, helpful_delta) to the table ``cache`` published below ``folder``.

    A batch rewrites the buckets of its products alone; one that runs again after a failure is applied once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        P.change(batch, "product_id", folder, number, {"cache": (CACHE, lambda before: A.product_cache_delta(before, batch))}, buckets)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "support long, reviews array<long>, domains array<string>, examples array<struct<seq:long,review_id:long,context:string>>, cue string, cued array<struct<seq:long,review_id:long,context:string>>"


def aspect_memory(mentions: DataFrame, most: int = 1000) -> DataFrame:
    """The memory of aspects (as ``operators.etl.memory`` without promotion) as evidence (aspect_raw, review_id, domain, context,
    cue_type, seq) comes in, in whatever order and batches.

    The state of an aspect holds its first examples and last cue by ``seq``, and up to ``most`` distinct review ids and
    domains: enough for the status, which asks for three reviews; a count that reached ``most`` stands for that many or
    more. The support counts all evidence.
    """

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        support, reviews, domains, examples, cue, cued = state.get if state.exists else (0, [], [], [], None, [])
        reviews, domains = set(reviews), set(domains)
        examples, last = [tuple(x) for x in examples], tuple(cued[0]) if cued else None
        for b in batches:
            support += len(b)
            for known, column in ((reviews, "review_id"), (domains, "domain")):
                for value in b[column].dropna().unique().tolist():
                    if len(known) >= most:
                        break
                    known.add(value)
            at = list(zip(b["seq"].tolist(), b["review_id"].tolist(), b["context"].tolist(), strict=True))
            examples = sorted(examples + at)[: E.EXAMPLES]
            for place, said in zip(at, b["cue_type"].tolist(), strict=True):
                if said and (last is None or (place, said) > (last, cue)):
                    last, cue = place, said
        state.update((support, sorted(reviews), sorted(domains), examples, cue, [last] if last else []))
        forms = len({c.strip().lower() for _, _, c in examples})
        yield pd.DataFrame({"aspect": [key[0]], "support": [support], "reviews": [len(reviews)], "domains": [len(domains)], "forms": [forms], "cue": [cue], "examples": [[c for _, _, c in examples]]})

    own = mentions.select(F.lower(F.trim(F.coalesce("aspect_raw", F.lit("")))).alias("aspect"), "review_id", "domain", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("cue_type", F.lit("")).alias("cue_type"), "seq")
    found = own.groupBy("aspect").applyInPandasWithState(update, "aspect string, support long, reviews long, domains long, forms long, cue string, examples array<string>", STATE, "update", GroupStateTimeout.NoTimeout)
    parent = E.generic_parent(F.col("aspect"))
    status = E.memory_status(F.col("aspect"), F.col("support"), F.col("reviews"), F.col("forms"), parent, F.col("cue"))
    return found.select("aspect", "support", "reviews", "domains", "forms", parent.alias("parent"), "cue", "examples", status.alias("status"))


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
