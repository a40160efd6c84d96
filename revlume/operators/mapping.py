"""Canonical names by a reviewed dictionary, in seven steps from the surest to the weakest.

The dictionary has a generic part and one of each domain, which comes before it: names (domain, key, canonical), modifiers
(domain, anchor, modifier, canonical) and broad labels (domain, label); keys and labels are in lower case, the generic
domain is ``generic``. A domain's own broad labels stand in place of the generic ones.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlume.functions import text as X
from revlume.operators.similar import Dictionary
from revlume.plans.shared import STORE_ROWS

GENERIC = "generic"
# fixed values: confidence of the steps, least scores of similar names and what these count for
TRUSTED, MODIFIED, AMBIGUOUS, PHRASE, ANCHOR, TOKEN, FAMILY_LABEL, FAMILY_NAME = 1.0, 0.85, 0.7, 1.0, 0.8, 0.55, 0.55, 0.5
LIKE_LABEL, LIKE_NAME, LIKE_FAMILY = 0.85, 0.80, 0.90
NAME_SHARE, FAMILY_SHARE = 0.9, 0.45
TARGET = ("domain", "source_type", "aspect_canonical", "aspect_raw", "aspect_anchor", "modifier_terms", "latent_family")
FOUND = "canonical string, mapping_source string, confidence double, matched_key string"


def _store(df: DataFrame, *columns: str) -> list[tuple]:
    """The rows of a reviewed store, of which more than STORE_ROWS are refused."""
    rows = df.select(*columns).distinct().limit(STORE_ROWS + 1).collect()
    if len(rows) > STORE_ROWS:
        raise ValueError(f"a dictionary has more than {STORE_ROWS} rows")
    return [tuple(r) for r in rows]


def _similar(targets: DataFrame, names: DataFrame, broad: DataFrame) -> DataFrame:
    """Names for (at, phrase, family) that no key gives: by a similar broad label or key, then by the latent family."""
    own_names, own_labels = defaultdict(dict), defaultdict(list)
    for domain, key, canonical in _store(names, "domain", "key", "canonical"):
        own_names[domain][key] = canonical
    for domain, label in _store(broad, "domain", "label"):
        own_labels[domain].append(label)
    sent = targets.sparkSession.sparkContext.broadcast((dict(own_names), dict(own_labels)))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_names, all_labels = sent.value
        loaded: dict[str, tuple] = {}  # no more than the domains of the dictionary

        def store(at: str) -> tuple:
            at = at if at in all_names or at in all_labels else GENERIC
            if at not in loaded:
                keys = all_names.get(GENERIC, {}) | all_names.get(at, {})
                labels = all_labels.get(at) or all_labels.get(GENERIC, [])
                loaded[at] = (keys, set(labels), Dictionary(labels), Dictionary(list(keys)))
            return loaded[at]

        def one(at: str, phrase: str | None, family: str | None) -> tuple:
            keys, labels, like_label, like_key = store(at)
            if phrase:
                if hit := like_label.best(phrase, LIKE_LABEL):
                    return hit[0], "fuzzy_canonical", hit[1], hit[0]
                if hit := like_key.best(phrase, LIKE_NAME):
                    return keys[hit[0]], "fuzzy_alias", hit[1] * NAME_SHARE, hit[0]
            if family:
                if family in labels:
                    return family, "latent_family_inference", FAMILY_LABEL, family
                if family in keys:
                    return keys[family], "latent_family_map", FAMILY_NAME, family
                if hit := like_label.best(family, LIKE_FAMILY):
                    return hit[0], "fuzzy_family_inference", hit[1] * FAMILY_SHARE, hit[0]
            return None, "no_match", 0.0, None

        for batch in batches:
            found = [(a, p, f, *one(a, p, f)) for a, p, f in zip(batch["at"], batch["phrase"], batch["family"])]
            yield pd.DataFrame(found, columns=["at", "phrase", "family", "canonical", "mapping_source", "confidence", "matched_key"])

    return targets.mapInPandas(named, f"at string, phrase string, family string, {FOUND}")


def map_aspects(items: DataFrame, names: DataFrame, modifiers: DataFrame, broad: DataFrame, mode: str = "full") -> DataFrame:
    """``items`` with canonical, mapping_source, confidence, matched_key, ambiguous, layers and scope.

    Steps: a learned item keeps its own name; anchor with modifier (the least of several names, then ambiguous); the whole
    phrase; the anchor; the first word of three letters or more; a similar broad label, then a similar key; the latent
    family as a label, a key or a similar label. Keys are met by one equi-join of distinct targets with the dictionary,
    similar names are looked up once for each phrase that has none. ``mode`` is full, generic_only or generic_plus_learned:
    the last two leave the domains' parts out. An item without any name has a null canonical, source ``no_match`` and
    scope ``unmapped_internal``; null and blank fields match nothing.
    """
    low = lambda x: F.lower(F.trim(x))
    dictionary = names.select("domain", "key", F.lit("").alias("modifier"), "canonical").unionByName(modifiers.select("domain", F.col("anchor").alias("key"), "modifier", "canonical"))
    own = items.withColumn("__target", F.md5(F.to_json(F.struct(*TARGET))))
    at = F.lit(GENERIC) if mode != "full" else F.lower(F.coalesce(F.nullif("domain", F.lit("")), F.lit(GENERIC)))
    family = low(F.col("latent_family"))
    targets = own.dropDuplicates(["__target"]).select(
        "__target", at.alias("at"), X.blank_to_null(F.col("aspect_raw")).alias("raw"), low(X.blank_to_null(F.col("aspect_anchor"))).alias("anchor"), "modifier_terms", F.when(~family.isin("", "unknown"), family).alias("family"),
        F.when((F.col("source_type") == "implicit_learned") & ~F.col("aspect_canonical").isin("", "unknown"), F.col("aspect_canonical")).alias("learned"))

    key = lambda step, turn, k, m=F.lit(""): F.struct(F.lit(step).alias("step"), turn.cast("int").alias("turn"), k.alias("key"), m.alias("modifier"))
    tokens = F.filter(F.split(F.lower(X.squash(F.col("raw"))), " "), lambda t: F.length(t) > 2)
    none = F.array().cast("array<struct<step:int,turn:int,key:string,modifier:string>>")
    modified = F.when(F.col("anchor").isNotNull(), F.transform("modifier_terms", lambda m, i: key(2, i, F.col("anchor"), F.nullif(low(m), F.lit("")))))
    wanted = F.concat(F.coalesce(modified, none), F.array(key(3, F.lit(0), low(F.col("raw"))), key(4, F.lit(0), F.col("anchor"))), F.coalesce(F.transform(tokens, lambda t, i: key(5, i, t)), none))
    asked = targets.where("learned is null").select("__target", F.explode(wanted).alias("w"), F.array_distinct(F.array("at", F.lit(GENERIC))).alias("domains"))
    asked = asked.select("__target", "w.*", F.posexplode("domains").alias("layer", "domain")).where("key is not null and modifier is not null")
    met = asked.join(dictionary.distinct(), ["domain", "key", "modifier"])
    hits = met.groupBy("__target").agg(F.array_sort(F.collect_list(F.struct("step", "turn", "layer", "domain", "key", "modifier", "canonical"))).alias("h"))

    # the sorted hits of a target: the first is of its surest step, a domain's own before a generic one of the same turn
    first = F.col("h")[0]
    by_modifier = F.filter("h", lambda x: (x["step"] == 2) & ~F.exists("h", lambda y: (y["step"] == 2) & (y["turn"] == x["turn"]) & (y["layer"] < x["layer"])))
    several = F.array_sort(F.array_distinct(F.transform(by_modifier, lambda x: x["canonical"])))
    two = first["step"] == 2
    by_key = hits.select(
        "__target", F.when(two, several[0]).otherwise(first["canonical"]).alias("canonical"),
        F.when(two, "anchor_modifier").when(first["step"] == 3, "exact_phrase").when(first["step"] == 4, "anchor_only").otherwise("token_fallback").alias("mapping_source"),
        F.when(two & (F.size(several) > 1), AMBIGUOUS).when(two, MODIFIED).when(first["step"] == 3, PHRASE).when(first["step"] == 4, ANCHOR).otherwise(TOKEN).alias("confidence"),
        F.when(two, F.concat_ws(".", first["key"], first["modifier"])).otherwise(first["key"]).alias("matched_key"), (two & (F.size(several) > 1)).alias("ambiguous"),
        F.when(two, F.array_distinct(F.transform(F.filter("h", lambda x: (x["step"] == 2) & (x["turn"] == first["turn"])), lambda x: x["domain"]))).alias("met_in"))

    left = targets.where("learned is null").join(hits, "__target", "left_anti").select("__target", "at", low(F.col("raw")).alias("phrase"), "family")
    like = _similar(left.select("at", "phrase", "family").distinct(), names, broad)
    same = (left["at"] == like["at"]) & left["phrase"].eqNullSafe(like["phrase"]) & left["family"].eqNullSafe(like["family"])
    by_likeness = left.join(like, same).select("__target", "canonical", "mapping_source", "confidence", "matched_key", F.lit(False).alias("ambiguous"), F.lit(None).cast("array<string>").alias("met_in"))
    by_learning = targets.where("learned is not null").select(
        "__target", F.col("learned").alias("canonical"), F.lit("trusted_learned").alias("mapping_source"), F.lit(TRUSTED).alias("confidence"), F.lit(None).cast("string").alias("matched_key"), F.lit(False).alias("ambiguous"), F.lit(None).cast("array<string>").alias("met_in"))
    found = by_learning.unionByName(by_key).unionByName(by_likeness)

    # where a key is known, whatever it stands for: as a name or as an anchor
    known = dictionary.groupBy(F.col("key").alias("matched_key")).agg(F.collect_set("domain").alias("known_in"))
    judged = targets.select("__target", "at").join(found, "__target").join(known, "matched_key", "left")
    layers, scope = _layers(F.coalesce("met_in", "known_in", F.array().cast("array<string>")), mode)
    verdict = judged.select("__target", "canonical", "mapping_source", "confidence", "matched_key", "ambiguous", layers.alias("layers"), scope.alias("scope"))
    return own.join(verdict, "__target").drop("__target")


def _layers(domains: Column, mode: str) -> tuple[Column, Column]:
    """The layers that know the key, and their scope; a key that none knows belongs to the item's domain."""
    source, at = F.col("mapping_source"), F.col("at")
    is_generic, is_own = F.array_contains(domains, GENERIC), F.array_contains(domains, at) & (at != GENERIC)
    if mode == "generic_only":
        # a match of anchor and modifier tells its layers itself, which here are generic as well
        is_generic, is_own = F.lit(True), F.lit(False)
    at_home = F.when(at == GENERIC, GENERIC).otherwise("domain_specific")
    layers = F.when(is_generic & is_own, F.array(F.lit(GENERIC), F.lit("domain_specific"))).when(is_generic, F.array(F.lit(GENERIC))).when(is_own, F.array(F.lit("domain_specific"))).otherwise(F.array(at_home))
    learned = source == "trusted_learned"
    return (
        F.when(learned, F.array(F.lit("learned_store"))).when(source == "no_match", F.array().cast("array<string>")).otherwise(layers),
        F.when(learned, "learned_store").when(source == "no_match", "unmapped_internal").otherwise(F.array_join(layers, "+")),
    )
