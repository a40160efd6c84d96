"""Vectors: similarity edges, prototypes, nearest-prototype scores, calibration and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.operators.ranked import running_sum


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

#: Labels of a bank that is sent to every task.
BANK_LABELS = 10_000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def prototypes(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, n and the mean vector: means by place are partial sums, then put in order again."""
    places = rows.select(label, F.posexplode(vector).alias("pos", "x"))
    means = places.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def score(rows: DataFrame, bank: DataFrame, temperature: float = 1.0, key: str = "vec_id") -> DataFrame:
    """(key, label): squared distance to each prototype and its softmax. The bank has a row for each label; every row meets
    every prototype by the model's definition, so the bank goes to the rows as one array if it has at most BANK_LABELS labels, and is refused otherwise."""
    fits = F.assert_true(F.count(F.lit(1)) <= BANK_LABELS, F.lit(f"more than {BANK_LABELS} labels")).isNull()
    whole = bank.agg(F.when(fits, F.collect_list(F.struct(F.col("label").alias("candidate"), "centre"))).alias("bank"))
    measured = rows.select(key, F.col("label").alias("truth"), "embedding").join(F.broadcast(whole), F.size("bank") > 0).select(key, "truth", "embedding", F.explode("bank").alias("b")).select(key, "truth", "embedding", "b.candidate", "b.centre")
    d2 = measured.select(key, "truth", "candidate", squared_distance(F.col("embedding"), F.col("centre")).alias("d2"))
    own = Window.partitionBy(key)
    z = -F.col("d2") / temperature
    weighed = d2.withColumn("z", z).withColumn("e", F.exp(F.col("z") - F.max("z").over(own)))
    return weighed.withColumn("p", F.col("e") / F.sum("e").over(own)).drop("e", "z")


def decide(scored: DataFrame, key: str = "vec_id") -> DataFrame:
    """Of each row the best label, its probability, the ambiguity 1 - (p1 - p2) and the distance d2 / (d2 + 1)."""
    place = Window.partitionBy(key).orderBy(F.desc("p"), "candidate")
    top = scored.withColumn("place", F.row_number().over(place)).where("place <= 2")
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    found = top.groupBy(key, "truth").agg(first("candidate").alias("predicted"), first("p").alias("confidence"), F.max(F.when(F.col("place") == 2, F.col("p"))).alias("second"), first("d2").alias("d2"))
    return found.select(key, "truth", "predicted", "confidence", (1 - (F.col("confidence") - F.coalesce("second", F.lit(0.0)))).alias("ambiguity"), (F.col("d2") / (F.col("d2") + 1)).alias("distance"))


#: Vectors of a block, at most; two blocks meet in a task. Smaller ones as long as there are no more than BLOCKS.
BLOCK, SMALL_BLOCK, BLOCKS = 32_768, 2048, 16
#: Rows of a block that are compared with another one at a time.
TILE = 256


def _block_count(n: int) -> int:
    return max(1, -(-n // BLOCK), min(BLOCKS, -(-n // SMALL_BLOCK)))


def _nearest(left: pd.DataFrame, right: pd.DataFrame, threshold: float, top: int) -> pd.DataFrame:
    """(a, b, cosine): of each row of ``left`` its nearest in ``right`` with at least the threshold, equal ones by key."""
    a, b, parts = left["k"].to_numpy(), right["k"].to_numpy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(a) and len(b):
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()).T
        few = min(top, len(b))
        for at in range(0, len(a), TILE):
            cosine = x[at : at + TILE] @ y
            cosine[a[at : at + TILE, None] == b[None]] = -np.inf
            least = np.maximum(threshold, np.partition(cosine, -few, axis=1)[:, -few])
            row, near = np.nonzero(cosine >= least[:, None])
            # ``right`` is in the order of its keys, so that of equal cosines the first keys stay
            order = np.lexsort((near, -cosine[row, near], row))
            row, near = row[order], near[order]
            turn = np.arange(len(row)) - np.searchsorted(row, row)
            row, near = row[turn < top], near[turn < top]
            parts.append((row + at, near, cosine[row, near]))
    row, near, cosine = (np.concatenate(p) for p in zip(*parts, strict=True))
    return pd.DataFrame({"a": a[row], "b": b[near], "cosine": cosine})


def similar_pairs(rows: DataFrame, threshold: float, top: int = 25, key: str = "id", vector: str = "v", both: bool = False) -> DataFrame:
    """(a, b, cosine), a < b, of unit vectors with a cosine of at least the threshold, if b is among the ``top`` nearest of a;
    with ``both`` also if a is among those of b.

    Vectors are dealt to blocks; each task multiplies two blocks as matrices, a few rows at a time, and lets out only a row's
    best ones, so that no join makes all pairs and no task holds more than two blocks. A vector is sent once for each block:
    at most BLOCKS times up to BLOCKS * BLOCK rows. Equal cosines go by key. Keys are distinct; null vectors take no part.
    """
    own = rows.select(key, vector).where(F.col(vector).isNotNull())
    blocks = _block_count(own.count())
    dealt = own.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sides = other.select("k", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = rows.schema[key].dataType.simpleString()

    def near(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        left, right = (group[group["block"] == n].sort_values("k") for n in (i, j))
        found = _nearest(left, right, threshold, top)
        return found if i == j else pd.concat([found, _nearest(right, left, threshold, top)], ignore_index=True)

    found = sides.groupBy("i", "j").applyInPandas(near, f"a {kind}, b {kind}, cosine double")
    place = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    best = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    if both:
        return best.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"))
    return best.where(F.col("a") < F.col("b")).select("a", "b", "cosine")


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    n = F.count(F.lit(1))
    return rows.groupBy(b.alias("bin")).agg(n.alias("n"), F.avg("confidence").alias("confidence"), (F.count_if(F.col("predicted") == F.col("truth")).cast("double") / n).alias("accuracy"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    found = calibration_bins(rows, bins)
    return found.agg((F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")) / F.sum("n")).alias("ece"))


def per_label(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label."""
    truth = rows.groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("truth") == F.col("predicted")).cast("long").alias("hits"))
    said = rows.groupBy(F.col("predicted").alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    both = truth.join(said, "label", "left").na.fill(0, ["predicted"])
    precision = F.when(F.col("predicted") > 0, F.col("hits").cast("double") / F.col("predicted")).otherwise(0.0)
    recall = F.col("hits").cast("double") / F.col("support")
    return both.select("label", "support", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def auroc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """The area under the curve by average ranks: counts of each score first, then running sums over the scores."""
    counted = rows.groupBy(score).agg(F.count_if(F.col(positive)).cast("long").alias("p"), F.count_if(~F.col(positive)).cast("long").alias("q"))
    summed = running_sum(counted, F.col("q"), "upto", score)
    return summed.withColumn("below", F.col("upto") - F.col("q")).agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)) / (F.sum("p") * F.sum("q"))).alias("auroc"))


def _upto(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """score, p, q, tp, fp: of each distinct score the positives and others at it, and at it or above. Ties are one step."""
    counted = rows.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(positive)).cast("long").alias("p"), F.count_if(~F.col(positive)).cast("long").alias("q"))
    one = running_sum(counted, F.col("p"), "tp", F.desc("score"))
    return running_sum(one, F.col("q"), "fp", F.desc("score"))


def _totals(steps: DataFrame) -> DataFrame:
    return steps.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))


def precision_recall(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """(score, precision, recall): of the rows at the score or above. Rows without a score are left out by the caller."""
    steps = _upto(rows, score, positive)
    met = steps.crossJoin(F.broadcast(_totals(steps)))
    return met.select("score", (F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("all_p") > 0, F.col("tp").cast("double") / F.col("all_p")).otherwise(0.0).alias("recall"))


def average_precision(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the sum over falling scores of the gain in recall times the precision."""
    steps = _upto(rows, score, positive)
    return steps.agg((F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")).alias("average_precision"))


def fpr_at_recall(rows: DataFrame, score: str, positive: str, recall: float = 0.95) -> DataFrame:
    """One row: the least share of others at or above a score that reaches the recall."""
    steps = _upto(rows, score, positive)
    met = steps.crossJoin(F.broadcast(_totals(steps))).where(F.col("tp") >= recall * F.col("all_p") - 1e-9)
    return met.agg(F.min(F.col("fp").cast("double") / F.col("all_q")).alias("fpr"))


def risk_coverage(rows: DataFrame, novelty: str, correct: str, quantiles: list[float]) -> DataFrame:
    """(quantile, threshold, coverage, risk): of the rows whose novelty is not above its quantile (interpolated), their share
    and the share of wrong ones."""
    spark = rows.sparkSession
    counted = rows.groupBy(F.col(novelty).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).cast("long").alias("hits"))
    ranked = running_sum(counted, F.col("n"), "upto", "score")
    total = counted.agg(F.sum("n").alias("total"))
    asked = spark.createDataFrame([(q,) for q in quantiles], "quantile double").crossJoin(F.broadcast(total)).withColumn("at", F.col("quantile") * (F.col("total") - 1))
    # the rows at either side of the place asked for: the first scores whose running counts pass it
    met = ranked.join(F.broadcast(asked))
    first = lambda place: F.min(F.when(F.col("upto") > place, F.col("score")))
    bounds = met.groupBy("quantile", "at", "total").agg(first(F.floor("at")).alias("low"), first(F.ceil("at")).alias("high"))
    cut_at = bounds.select("quantile", "total", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("threshold"))
    covered = counted.join(F.broadcast(cut_at), F.col("score") <= F.col("threshold")).groupBy("quantile", "threshold", "total").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return covered.select("quantile", "threshold", (F.col("n").cast("double") / F.col("total")).alias("coverage"), (1 - F.col("hits").cast("double") / F.col("n")).alias("risk"))


def threshold_grid(rows: DataFrame, steps: int = 19) -> DataFrame:
    """For each pair of thresholds known < novel: share of novel rows found and of known rows kept. The grid has a fixed size."""
    spark = rows.sparkSession
    grid = spark.range(1, steps + 1).select((F.col("id") / (steps + 1.0)).alias("t"))
    pairs = grid.select(F.col("t").alias("known")).join(F.broadcast(grid.select(F.col("t").alias("novel"))), F.col("known") < F.col("novel"))
    # counts by step of the score first, so that the grid meets a few rows and not the data
    at = rows.groupBy(F.floor(F.col("novelty") * (steps + 1)).alias("step"), "is_novel").agg(F.count(F.lit(1)).alias("n"))
    met = pairs.join(F.broadcast(at)).withColumn("s", F.col("step") / (steps + 1.0))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = met.groupBy("known", "novel").agg(n(F.col("is_novel") & (F.col("s") >= F.col("novel"))).alias("tp"), n(~F.col("is_novel") & (F.col("s") >= F.col("novel"))).alias("fp"), n(F.col("is_novel") & (F.col("s") < F.col("novel"))).alias("fn"), n(~F.col("is_novel") & (F.col("s") < F.col("known"))).alias("kept"), n(~F.col("is_novel")).alias("known_rows"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    recall = F.when(F.col("known_rows") > 0, F.col("kept").cast("double") / F.col("known_rows")).otherwise(0.0)
    return out.select("known", "novel", f1.alias("novel_f1"), recall.alias("known_recall"), (0.5 * f1 + 0.5 * recall).alias("objective"))
