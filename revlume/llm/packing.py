"""Best-fit packing by minimum bin slack.

Pieces of at most ``capacity`` tokens are known by their length, so the packing
is planned on the histogram of lengths (at most ``capacity`` counts, whatever
the number of documents): for the longest piece left, a bitset subset-sum over
the lengths left finds the fullest feasible bin; the combination is taken as
often as the counts allow and then removed. The plan is a list of bin patterns
with repeats. Each piece has a rank among those of its length, counted per task
and length first, and finds its bin by that rank: no shuffle of texts, no group
gathered in one place.

Nulls and edges: a null text counts as empty, so such a document is one piece
with the end id alone; pieces of equal length are interchangeable and go by the
order of their rank; an empty table gives no piece. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize
from .tokens import CACHE_ENTRIES, encoder
from .workers import freed


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths with multiplicities, at most counts of each, of the largest sum that is at most room.

    ``reach`` is the bitset of sums; a count is split in powers of two, and the
    bitset before each part is kept to walk back. Longer lengths go first, so
    the fullest bin is found with few pieces; it stops as soon as room is met.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            left -= part
            part *= 2
            if reach >> room & 1:
                left = 0
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            taken[length] = taken.get(length, 0) + part
    return sorted(taken.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin patterns as (repeats, [(length, copies), ...]), which use each counted piece exactly once."""
    left = {length: n for length, n in counts.items() if n}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({x: n for x, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        pattern = dict(rest)
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= repeats * n
            if not left[x]:
                del left[x]
        out.append((repeats, sorted(pattern.items(), reverse=True)))
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with the task's number and the piece's rank by length in it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, False, cache_entries), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            texts = [x if isinstance(x, str) else None for x in batch["text"]]
            for doc, got in zip(batch["doc_id"], enc.encode_bytes(texts), strict=True):
                ids = memoryview(got + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    length = len(one) // 4
                    rows.append((None if pd.isna(doc) else int(doc), k, at // 4, length, zlib.crc32(one), part, seen[length]))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "own"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(freed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, own long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Each piece with its sequence_id and offset. ``cache_entries``: word encodings that a worker keeps (memory against time, not results)."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, end_id, capacity, cache_entries), "pieces")
    # a row for each task and length: far fewer than pieces, at most capacity of them for a task
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows

    slots, sequence, used = [], 0, {}
    for repeats, pattern in plan(counts, capacity):
        at = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            slots.append((length, first, first + repeats * copies, copies, sequence, at))
            used[length] = first + repeats * copies
            at += length * copies
        sequence += repeats
    # the plan has a row for each length of each pattern. A pattern at least halves a count or ends it,
    # so their number is bound by capacity * log2(count), not by the number of pieces
    schema = "length long, first long, last long, copies long, sequence long, at long"
    planned = spark.createDataFrame(slots, schema) if slots else spark.createDataFrame([], schema)

    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("own") + F.col("base"))
    step = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(planned), (ranked["length"] == planned["length"]) & (ranked["rank"] >= planned["first"]) & (ranked["rank"] < planned["last"]))
        .select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + F.floor(step / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("at") + step % F.col("copies") * ranked["length"]).cast("long").alias("offset"))
    )
