"""Quality rules with risk-controlled thresholds.

Each document gets counts by Spark expressions alone. Base rules reject short
and repetitive texts. Five further rules give scores in steps. One half of the
labelled documents (by a hash of their ids) says how much rarer a score or a
worse one is among good than among bad documents; a document's level is that of
the rule that speaks most against it. The other half certifies a cutoff of that
level for each stratum (``lang``): from the mildest on, a cutoff is certified
while the exact binomial tail P(Bin(n, RISK) <= rejected good documents) stays
at most delta; the first failure ends the sequence (fixed-sequence testing, so
neither the grid nor the number of rules costs anything), and the strata share
DELTA evenly (Bonferroni). The strictest certified cutoff applies; a stratum with
too few labels (86 good ones in the second half, with four strata) has none and
loses nothing. So, with confidence 1 - DELTA, no stratum loses more than RISK of
its good documents to these rules.

Nulls and edges: a null or empty text has no words and fails the base rule; a
null lang is a stratum of its own; a document with several labels counts with
each, labels that are null or of absent documents do not count; rows with equal
doc_id are judged one by one, each on its own text; without labels nothing but
the base rules rejects; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import SPACE_CLASS, SPACES, let, words_of
from .storage import materialize

#: At most this share of good documents is lost in a stratum, with confidence 1 - DELTA.
RISK, DELTA = 0.05, 0.05
#: Steps of a rule's score, and levels of all rules together, which are cutoffs.
GRID, LEVELS = 64, 64
#: A score speaks against a document if it or a worse one is so many times as common among bad documents.
LEAST_RATIO = 3.0
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Rule -> score in [0, 1], higher is worse, in whole steps of 1 / GRID.
RULES: dict[str, str] = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "least(1, word_chars / (32 * greatest(n_words, 1)))",
    "few_words": "1 - least(1, n_words / 256)",
}


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the text, each word once.

    The windows are sorted by hash and place, so that equal ones are neighbours:
    n log n for any text.
    """
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("p"))),
    )
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

    def places(s: Column) -> Column:
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def count(w: Column) -> Column:
        some = F.size(F.array_distinct(F.transform(w, lambda x: x["h"]))) < F.size(w)
        return F.when(some, let(F.array_sort(w), lambda s: let(places(s), covered))).otherwise(0)

    return F.coalesce(let(windows, count), F.lit(0)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^" + SPACE_CLASS[1:]))
    return (
        docs.select("doc_id", "lang", text.alias("text"))
        .select(
            "doc_id",
            "lang",
            let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
            F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        )
        .select("doc_id", "lang", "w.*", "word_chars", "n_symbols", "l.*")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def score_step(rule: str) -> Column:
    return F.floor(F.expr(RULES[rule]) * GRID).cast("int")


def most_rejected(n: Column, risk: Column, delta: Column) -> Column:
    """The largest k with P(Bin(n, risk) <= k) <= delta, -1 if there is none. In logarithms, so that n may be large."""
    odds = F.log(risk) - F.log1p(-risk)
    start = F.struct((n * F.log1p(-risk)).alias("log_p"), F.lit(0.0).alias("tail"), F.lit(-1).cast("long").alias("k"))

    def step(s: Column, i: Column) -> Column:
        tail = s["tail"] + F.exp(s["log_p"])
        log_p = s["log_p"] + F.log((n - i) / (i + 1)) + odds
        return F.struct(F.coalesce(log_p, F.lit(float("-inf"))).alias("log_p"), tail.alias("tail"), F.when(tail <= delta, i).otherwise(s["k"]).alias("k"))

    # past the mean the tail is above delta
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * risk).cast("long")), start, step, lambda s: s["k"])


def _levels(labelled: DataFrame) -> DataFrame:
    """One row: for each rule the level of each step, by documents (good, steps) that teach."""
    spark = labelled.sparkSession
    counted = labelled.select("good", F.explode("steps").alias("rule", "step")).groupBy("rule", "step").agg(F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad"))
    grid = spark.range(GRID + 2).select(F.col("id").cast("int").alias("step"), F.explode(F.array(*map(F.lit, RULES))).alias("rule"))
    # a row for each rule and step from here on
    worse, all_steps = Window.partitionBy("rule").orderBy(F.desc("step")), Window.partitionBy("rule")
    share = lambda c, more: (F.sum(F.coalesce(c, F.lit(0))).over(worse) + more) / (F.sum(F.coalesce(c, F.lit(0))).over(all_steps) + 1)
    shares = grid.join(counted, ["rule", "step"], "left").select("rule", "step", share("good", 1).alias("good"), share("bad", 0).alias("bad"))
    against = F.col("bad") / (LEAST_RATIO * F.col("good"))
    level = F.when(against >= 1, F.least(F.lit(LEVELS), 1 + F.floor(8 * F.log2(against)))).otherwise(0).cast("int")
    arrays = shares.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", level.alias("level")))), lambda x: x["level"]).alias("levels"))
    return arrays.agg(F.map_from_entries(F.collect_list(F.struct("rule", "levels"))).alias("levels"))


def _steps() -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*map(score_step, RULES)))


def _level(rule: str) -> Column:
    return F.coalesce(F.get(F.col("levels")[rule], score_step(rule)), F.lit(0))


def cutoffs(graded: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum and its certified cutoff (none certified: no row); a document with a level at or above it is rejected. ``graded``: doc_id, lang, base_failed, level."""
    proof = labels.where((F.col("quality") == 1) & ~teaches(F.col("doc_id"))).select(F.col("doc_id").alias("labelled"))
    good = proof.join(graded.where(~F.col("base_failed")), F.col("labelled") == F.col("doc_id")).select(F.coalesce("lang", F.lit("")).alias("stratum"), "level")
    counted = good.groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"))
    # a row for each stratum and level from here on; every level is a cutoff, seen or not
    grid = counted.select("stratum").distinct().select("stratum", F.explode(F.sequence(F.lit(0), F.lit(LEVELS + 1))).alias("level"))
    own = Window.partitionBy("stratum")
    strata = counted.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    tested = (
        grid.join(counted, ["stratum", "level"], "left")
        .withColumn("rejected", F.sum(F.coalesce("n", F.lit(0))).over(own.orderBy(F.desc("level"))))
        .withColumn("total", F.sum(F.coalesce("n", F.lit(0))).over(own))
        .join(strata)  # one row
        .withColumn("limit", most_rejected(F.col("total"), F.lit(RISK), F.lit(DELTA) / F.col("strata")))
    )
    # rejections grow from cutoff to cutoff, so the first failure is the end of those within the limit; level 0 speaks against nobody
    return tested.where((F.col("rejected") <= F.col("limit")) & (F.col("level") > 0)).groupBy("stratum").agg(F.min("level").alias("cutoff"))


def teaches(doc_id: Column) -> Column:
    """Whether a labelled document says what scores mean; the others certify."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(2)) == 0


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, the counts, base_failed, the rule that rejected (null: none) and kept."""
    found = materialize(features(docs), "quality-features")
    teaching = labels.where(F.col("quality").isin(0, 1) & teaches(F.col("doc_id"))).select(F.col("doc_id").alias("labelled"), (F.col("quality") == 1).alias("good"))
    teaching = teaching.join(found.where(~F.col("base_failed")), F.col("labelled") == F.col("doc_id")).select("good", _steps().alias("steps"))
    graded = found.join(F.broadcast(_levels(teaching))).withColumn("level", F.greatest(*map(_level, RULES)))  # one row of a fixed size
    worst = F.coalesce(*(F.when(_level(rule) == F.col("level"), F.lit(rule)) for rule in RULES))
    cut = cutoffs(graded, labels)
    return (
        graded.join(cut, F.coalesce(graded["lang"], F.lit("")) == cut["stratum"], "left")
        .withColumn("rejected_by", F.when(F.col("level") >= F.col("cutoff"), worst))
        .select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))
    )
