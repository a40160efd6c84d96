"""Per-record logic on nested arrays: gates, novelty, merging of candidates, phrase matching, mapping."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.functions import text as X
from revlume.plans.shared import STORE_ROWS, cut

# fixed values: scores of the explicit gate, polarity of tiers
DOMAIN_SCORE, GENERIC_SCORE, OPEN_SCORE = 0.92, 0.86, 0.72
_WORD = re.compile("[a-z]+")
HARDNESS = {"H0": 0.0, "H1": 0.34, "H2": 0.67, "H3": 1.0}


def matches_any(label: Column, candidates: Column) -> Column:
    """Whether a label equals a candidate or has all of its tokens."""
    have = F.split(X.squash(F.lower(label)), " ")
    return F.exists(candidates, lambda c: F.size(F.array_except(F.split(c, " "), have)) == 0)


def explicit_gate(label: Column, denied: Column, own: Column, generic: Column, others: Column) -> Column:
    """struct<accepted, score, reason>: the deny list first, then the domain's words, the generic ones, those of other domains."""
    verdict = lambda ok, score, reason: F.struct(F.lit(ok).alias("accepted"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    blank = X.blank_to_null(label).isNull()
    return (
        F.when(blank | F.array_contains(denied, F.lower(label)), verdict(False, 0.0, "low_quality_aspect")).when(matches_any(label, own), verdict(True, DOMAIN_SCORE, "domain"))
        .when(matches_any(label, generic), verdict(True, GENERIC_SCORE, "generic")).when(matches_any(label, others), verdict(False, 0.0, "domain_mismatch")).otherwise(verdict(True, OPEN_SCORE, "open_world"))
    )


def route_predictions(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted, abstained and novel rows of (id, predictions: array<struct<aspect, routing, confidence, novel_candidates>>); equal novel candidates once."""
    flat = rows.select("id", F.explode("predictions").alias("p")).select("id", "p.*")
    accepted = flat.where("routing = 'known'").select("id", "aspect", "confidence").distinct()
    abstained = flat.where("routing in ('boundary', 'abstain')").select("id", "aspect", "confidence").distinct()
    own = flat.where("routing = 'novel'")
    nested = own.select("id", F.explode("novel_candidates").alias("c")).select("id", "c.aspect", "c.novelty_score")
    alone = own.where("novel_candidates is null or size(novel_candidates) = 0").select("id", "aspect", F.lit(None).cast("double").alias("novelty_score"))
    return accepted, abstained, nested.union(alone).distinct()


def suppress_overlaps(items: Column, name: str = "canonical") -> Column:
    """Of array<struct<confidence, rank, start, stop, canonical, ...>>, the surer first; one that overlaps a kept one of the same name goes."""
    ordered = F.array_sort(F.transform(items, lambda x: F.struct((-x["confidence"]).alias("k1"), x["rank"].alias("k2"), x["start"].alias("k3"), x["stop"].alias("k4"), x[name].alias("k5"), x.alias("x"))))
    empty = F.filter(items, lambda x: F.lit(False))

    def step(kept: Column, o: Column) -> Column:
        x = o["x"]
        clash = F.exists(kept, lambda k: (k[name] == x[name]) & (k["start"] < x["stop"]) & (x["start"] < k["stop"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(ordered, empty, step)


def collapse_fragments(rows: DataFrame, keys: list[str], name: str = "canonical") -> DataFrame:
    """Of rows with the same keys (evidence, span, sentiment), those whose name is part of the winner's go; the longest name wins, then the surer."""
    own = Window.partitionBy(*keys).orderBy(F.desc(F.length(name)), F.desc("confidence"), name)
    led = rows.withColumn("winner", F.first(name).over(own)).withColumn("place", F.row_number().over(own))
    return led.where((F.col("place") == 1) | ~F.contains("winner", F.col(name))).drop("winner", "place")


def row_novelty(items: Column) -> Column:
    """Of array<struct<confidence, status>>: novel, boundary or known, by the sure ones."""
    sure = F.filter(items, lambda x: x["confidence"] >= 0.6)
    count = lambda s: F.size(F.filter(sure, lambda x: x["status"] == s))
    first = F.array_max(F.transform(sure, lambda x: F.struct(x["confidence"].alias("c"), x["status"].alias("s"))))
    return (
        F.when(F.size(items) == 0, "known").when(F.size(sure) == 0, "boundary").when((first["s"] == "novel") & (first["c"] >= 0.75), "novel").when(2 * count("novel") > F.size(sure), "novel")
        .when(count("novel") + count("boundary") > 0, "boundary").otherwise("known")
    )


def ambiguity(items: Column) -> Column:
    """Of array<struct<canonical, source, sentiment, confidence>>: 0 to 1 by how much they differ. Blanks do not count, nor an unknown sentiment."""
    def kinds(field: str, *but: str) -> Column:
        values = F.transform(items, lambda x: F.coalesce(x[field], F.lit("")))
        return F.size(F.array_distinct(F.filter(values, lambda v: ~v.isin("", *but))))

    names = F.least(F.lit(0.35), 0.18 * F.greatest(kinds("canonical") - 1, F.lit(0)))
    extra = lambda c, v: F.when(c, v).otherwise(0.0)
    unknown, low = F.exists(items, lambda x: x["canonical"] == "unknown"), F.exists(items, lambda x: x["confidence"] < 0.5)
    total = names + extra(kinds("source") > 1, 0.2) + extra(kinds("sentiment", "unknown") > 1, 0.2) + extra(unknown, 0.15) + extra(low, 0.1)
    return F.when(F.size(items) > 0, F.least(F.lit(1.0), total)).otherwise(0.0)


def hardness(items: Column, ambiguity_score: Column, novelty: Column) -> Column:
    """Of array<struct<canonical, source, sentiment, ...>>: H3 if novel or without a name and ambiguous, H2 if many or mixed, H1 if implicit."""
    unsure = F.coalesce(ambiguity_score, F.lit(0.0)) >= 0.5
    sentiments = F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(F.coalesce(x["sentiment"], F.lit("")))), lambda v: v != ""))
    return (
        F.when(F.size(items) == 0, "H0").when((F.coalesce(novelty, F.lit("")) == "novel") & unsure, "H3").when(F.exists(items, lambda x: x["canonical"] == "unknown") & unsure, "H3")
        .when((F.size(items) > 4) | (F.size(sentiments) > 1), "H2").when(F.exists(items, lambda x: x["source"] == "implicit"), "H1").otherwise("H0")
    )


def quality_weight(confidence: Column, evidence: Column, tier: Column) -> Column:
    """A product of bounded factors, between 0.25 and 1.5."""
    scores = F.create_map(*(F.lit(v) for kv in HARDNESS.items() for v in kv))
    bounded = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    product = bounded(confidence, 0.5, 1.0) * bounded(evidence, 0.5, 1.0) * (1 + 0.3 * F.coalesce(scores[tier], F.lit(0.0)))
    return bounded(product, 0.25, 1.5)


def as_one_row(rows: DataFrame, name: str) -> DataFrame:
    """All rows as one array of structs, to be broadcast; more than STORE_ROWS are refused."""
    fits = F.assert_true(F.count(F.lit(1)) <= STORE_ROWS, F.lit(f"more than {STORE_ROWS} rows")).isNull()
    return rows.agg(F.when(fits, F.collect_list(F.struct(*rows.columns))).alias(name))


def map_by_steps(items: DataFrame, steps: list[tuple[str, float, DataFrame, list[str]]]) -> DataFrame:
    """The canonical name by the first dictionary that has the item's keys; each step is (layer, confidence, dictionary, keys)."""
    out, names, layers, scores = items, [], [], []
    for i, (layer, confidence, dictionary, keys) in enumerate(steps):
        found = dictionary.dropDuplicates(keys).withColumnRenamed("canonical", f"c{i}")
        out = out.join(found.select(*keys, f"c{i}"), keys, "left")
        hit = F.col(f"c{i}").isNotNull()
        names.append(F.col(f"c{i}"))
        layers.append(F.when(hit, F.lit(layer)))
        scores.append(F.when(hit, F.lit(confidence)))
    return out.select(*items.columns, F.coalesce(*names).alias("canonical"), F.coalesce(*layers, F.lit("unmapped")).alias("layer"), F.coalesce(*scores, F.lit(0.0)).alias("confidence"))


def set_scores(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of predicted against gold sets (arrays) of a row."""
    hits = F.size(F.array_intersect("predicted", "gold")).cast("double")
    p = F.when(F.size("predicted") > 0, hits / F.size("predicted")).otherwise(0.0)
    r = F.when(F.size("gold") > 0, hits / F.size("gold")).otherwise(0.0)
    return rows.select("id", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def verify_actions(items: Column, actions: Column) -> Column:
    """Keep, drop or merge items by index; a broken list of actions (null) keeps all, merge drops."""
    gone = F.transform(F.filter(actions, lambda a: a["action"].isin("drop", "merge")), lambda a: a["index"])
    return F.when(actions.isNull(), items).otherwise(F.filter(items, lambda x, i: ~F.array_contains(gone, i)))


def _own_bigrams(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The n most frequent word pairs of each lowered text by itself."""
    for batch in batches:
        rows, places, pairs, counts = [], [], [], []
        for i, low in enumerate(batch.column("low").to_pylist()):
            found = _WORD.findall(low or "")
            # counted in the order in which they occur, which ties keep
            for place, ((a, b), k) in enumerate(Counter(zip(found, found[1:])).most_common(n), 1):
                rows.append(i)
                places.append(place)
                pairs.append(f"{a} {b}")
                counts.append(k)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(pairs, pa.string()), pa.array(counts, pa.int64())], ["id", "place", "bigram", "n"])


def top_bigrams(texts: DataFrame, n: int = 6) -> DataFrame:
    """The n most frequent word pairs of each id (its texts together); ties go to the first to occur.

    A text whose id stands alone is counted where it is read and sends nothing; texts of one id are counted as rows of pairs.
    """
    own = texts.select("id", "text")
    kind = own.schema["id"].dataType.simpleString()
    count_alone = lambda rows: rows.select("id", F.lower("text").alias("low")).mapInArrow(lambda batches: _own_bigrams(batches, n), f"id {kind}, place int, bigram string, n long")
    repeated = own.groupBy(F.col("id").alias("again")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("again")
    if repeated.isEmpty():
        return count_alone(own)
    same = F.col("id").eqNullSafe(F.col("again"))
    alone, shared = own.join(repeated, same, "left_anti"), own.join(repeated, same, "left_semi")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    # the words are found once for a text, not for each pair
    pairs = F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))))[0]
    flat = shared.select("id", F.posexplode(pairs).alias("pos", "bigram"))
    counted = flat.groupBy("id", "bigram").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    place = Window.partitionBy("id").orderBy(F.desc("n"), "first")
    placed = counted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)
    return count_alone(alone).unionByName(placed.select("id", "place", "bigram", "n"))


def _inner_grams(text: Column, n: int = 5) -> Column:
    """Hashes of each run of n words between single spaces."""
    # the words are made once for a text, not for each run
    return F.transform(F.array(F.split(text, " ")), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " "))))[0]


def containing(docs: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """(item_id, doc_id, ...) of documents (doc_id, text) that hold an item's text (item_id, item).

    An item may begin and end inside a word, so its inner words are its key: of their runs of n, the one with the
    fewest documents among those with any. Only keys and ids are joined, then the texts. Items of fewer than n + 2
    words, a bounded share of a reviewed set, meet every document by their shortest form: as one row.
    """
    words = F.split("item", " ")
    long = items.where(F.size(words) >= n + 2).select("item_id", "item", F.slice(words, 2, F.size(words) - 2).alias("inner"))
    grams = long.select("item_id", F.explode(F.array_distinct(_inner_grams(F.array_join("inner", " "), n))).alias("k"))
    of_docs = docs.where(F.size(F.split("text", " ")) >= n).select("doc_id", F.explode(F.array_distinct(_inner_grams(F.col("text"), n))).alias("k"))
    # a document counts once for a key, with ids alone; a key that no document has ends the item's search
    seen = cut(of_docs.join(grams.select("k").distinct(), "k", "left_semi"))
    counts = grams.join(seen.groupBy("k").agg(F.count(F.lit(1)).alias("docs")), "k", "left").groupBy("item_id").agg(F.min_by("k", F.struct(F.coalesce("docs", F.lit(0)), "k")).alias("k"), F.min(F.coalesce("docs", F.lit(0))).alias("docs"))
    near = counts.where("docs > 0").join(seen, "k").select("item_id", "doc_id").distinct()
    found = near.join(long.select("item_id", "item"), "item_id").join(docs, "doc_id")
    store = as_one_row(items.where(F.size(words) < n + 2).select("item_id", "item"), "store")
    short = docs.join(F.broadcast(store), F.size("store") > 0).select("doc_id", "text", F.explode("store").alias("s")).select("doc_id", "text", "s.item_id", "s.item")
    return found.select("item_id", "doc_id", "text", "item").union(short.select("item_id", "doc_id", "text", "item")).where(F.contains("text", F.col("item"))).select("item_id", "doc_id").distinct()
