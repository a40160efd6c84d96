"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in doc_id order, form blocks of documents; a slot of the
mixture takes one block. A source of weight w (of the sum of weights) releases
its block j at floor(j / w) and has it due at ceil((j + 1) / w); in every slot
the released block with the earliest deadline goes first. On one sequence all
deadlines are met, so that after each slot every source stands less than one
block from its share. When a source has no block left, the shares of the others
are scaled up and a new phase begins; there are at most as many phases as
sources. All documents are kept, each once.

The driver sees counts by source and plans every slot, with exact integers: a
block has BLOCK documents, or more where there would be over SLOTS blocks, so
that the plan is bounded by SLOTS and the number of sources (MAX_SOURCES; more
are refused), whatever the number of documents. A document's rank in its source
comes from a range partitioning by source and doc_id, which parts a source of
any size, and the partitions' counts.

Nulls and edges: a null source is a source of its own; sources without a weight
or with weight 0 follow all others, with equal weights; negative and non-finite
weights are refused; null doc_ids go first; ties of doc_id are ordered by their
text's hash, and equal rows stand side by side; the last block of a source may
be short; an empty table gives no rows. Extra columns pass unchanged where their
names do not begin with ``mix_``.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import materialize

BLOCK = 16
SLOTS = 200_000
MAX_SOURCES = 50_000
#: Without given weights a source weighs its number of documents to this power.
TEMPERATURE = 0.5
#: Weights are whole multiples of the sum's share of this.
_UNITS = 1 << 50


def whole_weights(weights: list[float]) -> list[int]:
    """Weights as whole numbers, with a relative error below any block: zeros stay, others are at least 1."""
    if any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights are finite and not negative")
    total = sum(weights)
    return [max(1, round(w / total * _UNITS)) if w else 0 for w in weights]


def edf(weights: list[int], blocks: list[int]) -> list[int]:
    """The source of each slot until one of the sources has no block left, by earliest deadline among released blocks."""
    total = sum(weights)
    release = [(0, i, 0) for i, w in enumerate(weights) if w]
    due: list[tuple[int, int, int]] = []
    out: list[int] = []
    while True:
        t = len(out)
        while release and release[0][0] <= t:
            _, i, j = heapq.heappop(release)
            heapq.heappush(due, (-(-(j + 1) * total // weights[i]), i, j))
        deadline, i, j = heapq.heappop(due)
        if deadline < t + 1:
            raise AssertionError("a deadline is missed")
        out.append(i)
        if j + 1 == blocks[i]:
            return out
        heapq.heappush(release, ((j + 1) * total // weights[i], i, j + 1))


def phases(blocks: list[int], weights: list[float]) -> list[tuple[list[int], list[int]]]:
    """Phases of the mixture: weights of all sources (0: not active) and the source of each slot."""
    left, out = list(blocks), []
    while any(left):
        own = [w if n else 0.0 for w, n in zip(weights, left, strict=True)]
        if not any(own):
            own = [float(n > 0) for n in left]
        whole = whole_weights(own)
        order = edf(whole, left)
        out.append((whole, order))
        for i in order:
            left[i] -= 1
    return out


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, mix_tie and the place: mix_block (in its source), mix_slot, mix_phase, mix_position (from 0, gapless)."""
    spark = docs.sparkSession
    thin = (
        docs.select("doc_id", "source", F.xxhash64("text").alias("mix_tie"))
        .repartitionByRange("source", "doc_id", "mix_tie")
        .sortWithinPartitions("source", "doc_id", "mix_tie")
        .withColumn("mix_part", F.spark_partition_id())
        .withColumn("mix_row", F.monotonically_increasing_id())
    )
    ranked = materialize(thin, "mix-ranked")
    # a row for each source and partition: rows of a part are numbered in order, so its first gives the rank
    parts = ranked.groupBy("source", "mix_part").agg(F.count(F.lit(1)).alias("n"), F.min("mix_row").alias("first_row"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("mix_part")) - F.col("n")
    parts = parts.withColumn("before", before)
    counts = parts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.asc_nulls_first("source")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r["n"] for r in counts]
    block = max(block, -(-sum(sizes) // slots))
    own = [n**TEMPERATURE for n in sizes] if weights is None else [float(weights.get(r["source"]) or 0.0) for r in counts]
    plan: list[list[int]] = [[], [], [], [], []]
    done, at = [0] * len(sizes), 0
    for number, (_, order) in enumerate(phases([-(-n // block) for n in sizes], own)):
        for i in order:
            for column, value in zip(plan, (i, done[i], len(plan[0]), number, at), strict=True):
                column.append(value)
            at += min(block, sizes[i] - done[i] * block)
            done[i] += 1
    names = ["mix_source", "mix_block", "mix_slot", "mix_phase", "mix_before"]
    planned = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, plan, strict=True)}))
    schema = T.StructType([T.StructField("source", docs.schema["source"].dataType), T.StructField("mix_source", T.LongType())])
    numbered = spark.createDataFrame([(r["source"], i) for i, r in enumerate(counts)], schema)
    rank = F.col("before") + F.col("mix_row") - F.col("first_row")
    numbered_parts = parts.alias("q").join(F.broadcast(numbered).alias("u"), F.expr("q.source <=> u.source")).select("q.source", "q.mix_part", "before", "first_row", "mix_source")  # at most MAX_SOURCES rows
    placed = (
        ranked.alias("r").join(numbered_parts.alias("q"), F.expr("r.source <=> q.source and r.mix_part = q.mix_part"))
        .select("doc_id", "r.source", "mix_tie", "mix_source", rank.alias("mix_rank"), F.floor(rank / block).alias("mix_block"))
    )
    # the plan has at most SLOTS + MAX_SOURCES rows of five numbers
    return placed.join(F.broadcast(planned), ["mix_source", "mix_block"]).select(
        "doc_id", "source", "mix_tie", "mix_block", "mix_slot", F.col("mix_phase").cast("int"), (F.col("mix_before") + F.col("mix_rank") % block).alias("mix_position")
    )


def mixed(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """``docs`` in the mixture's order, its columns alone."""
    place = mix(docs, weights).groupBy("doc_id", "source", "mix_tie").agg(F.min("mix_position").alias("mix_position"))
    # a row travels as one value, so that no name of its columns can clash
    at = docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")).withColumn("tie", F.xxhash64("row.text"))
    same = at["row.doc_id"].eqNullSafe(place["doc_id"]) & at["row.source"].eqNullSafe(place["source"]) & (at["tie"] == place["mix_tie"])
    return at.join(place, same).repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("row.*")
