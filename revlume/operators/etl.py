"""Nested records: cleaning, gating, evidence, de-duplication, splitting and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.functions import text as X
from revlume.operators.ranked import running_sum

# fixed values: columns that may hold a review's text, in order; modes; words of rules
TEXT_FIELDS = ("review_text", "text", "review", "content", "body", "comment")
GENERIC = (
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "when", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "good", "bad", "great", "poor", "amazing", "very",
)
ACTION_VERBS = ("provide", "get", "give", "take", "make", "use", "want", "need", "visit", "go", "come")
WEAK_NOUNS = ("visit", "road", "center", "place", "area", "thing", "something", "anything", "nothing", "everything", "way", "lot", "bit")
CLAUSE_LABELS = ("it is", "there is", "this is", "i have", "they have", "we have")
SPLITS = ("train", "val", "test")


def present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that is not blank in a row; columns that are absent do not count."""
    have = [X.blank_to_null(F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def normalize_reviews(df: DataFrame, source: str) -> DataFrame:
    """review_id, group_id, domain, text: ids from the row or a hash of it, the text from the first column that has one."""
    text = X.squash(present(df, TEXT_FIELDS))
    given, group = present(df, ("review_id", "id")), present(df, ("product_id", "group_id", "business_id", "entity_id"))
    domain = X.slug(F.coalesce(present(df, ("domain",)), F.lit(source)))
    rows = df.select(F.coalesce(given, X.stable_id("r_", text, group)).alias("review_id"), group.alias("group_id"), domain.alias("domain"), text.alias("text"))
    # the data must name a group: a row without one stops the job
    return rows.where(F.assert_true(F.col("group_id").isNotNull(), F.lit("a review has no group id")).isNull())


def flatten_aspects(df: DataFrame, nested: str = "aspects") -> DataFrame:
    """A row for each element of the nested array; an empty one keeps its row. The element's fields override the row's."""
    fields = df.schema[nested].dataType.elementType.names
    rows = df.withColumn("element", F.explode_outer(nested)).drop(nested)
    kept = [F.coalesce(F.col(f"element.{c}").cast("string"), F.col(c).cast("string")).alias(c) if c in fields else F.col(c) for c in df.columns if c != nested]
    new = [F.col(f"element.{f}").alias(f) for f in fields if f not in df.columns]
    return rows.select(*kept, *new)


def noisy_label(label: Column) -> Column:
    """Blank, longer than five tokens, with a verb of action or a weak noun anywhere, or a clause for a label."""
    plain = X.squash(F.lower(F.coalesce(label, F.lit(""))))
    words = F.split(plain, " ")
    return (plain == "") | (F.size(words) > 5) | F.exists(words, lambda w: w.isin(*ACTION_VERBS) | w.isin(*WEAK_NOUNS)) | F.trim(F.lower(label)).isin(*CLAUSE_LABELS)


def clean_phrase(label: Column) -> Column:
    """In lower case, without generic words."""
    words = F.split(X.squash(F.lower(F.coalesce(label, F.lit("")))), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*GENERIC)), " ")


def gate_reasons(confidence: Column, support: Column, evidence: Column) -> Column:
    """Why a candidate fails; an accepted one has no reason. ``missing_evidence`` is a hard failure."""
    return F.array_compact(F.array(
        F.when(confidence < 0.3, "low_confidence"), F.when(~F.coalesce(support, F.lit("")).isin("exact", "near_exact", "gold"), "weak_support"), F.when(X.blank_to_null(evidence).isNull(), "missing_evidence")))


def span_issue(text: Column, evidence: Column, span: Column) -> Column:
    """What is wrong with an evidence span: shape, range, mismatch or empty; null if it is right."""
    start, end = span[0], span[1]
    return (
        F.when(span.isNull() | (F.size(span) != 2), "shape").when((start < 0) | (end < start) | (end > F.length(text)), "range").when(start == end, "empty")
        .when(F.lower(F.substring(text, start + 1, end - start)) != F.lower(evidence), "mismatch")
    )


def phrase_window(text: Column, cue: Column, size: int = 8) -> Column:
    """Up to ``size`` tokens on each side of the first token that holds the cue, joined; null without one."""
    words = F.split(X.squash(text), " ")
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.contains(F.lower(w), F.lower(cue)), i)), lambda i: i.isNotNull())
    at = F.get(hits, F.lit(0))
    first = F.greatest(at - size, F.lit(0))
    return F.when(at.isNotNull(), F.array_join(F.slice(words, first + 1, at + size + 1 - first), " "))


def keyword_share(texts: DataFrame, words: tuple[str, ...], column: str = "text") -> Column:
    low = F.lower(F.col(column))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return F.count_if(hit).cast("double") / F.count(F.lit(1))


def novelty(name: Column, known: Column, confidence: Column, source: Column, supported: Column) -> Column:
    """known, boundary or novel with its score and reason, by the first rule that holds: no name, a sure known name, a weak
    or untrusted mapping, no evidence, a sure name outside the registry."""
    case = lambda status, score, reason: F.struct(F.lit(status).alias("status"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    own = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    weak = F.coalesce(source, F.lit("none")).isin("token_fallback", "provisional", "unmapped") | (confidence > 0) & (confidence < 0.75)
    return (
        F.when(own.isin("", "unknown"), case("boundary", 0.4, "unknown_aspect_canonical")).when(known & (confidence >= 0.75), case("known", 0.0, "canonical_in_registry"))
        .when(weak, case("boundary", 0.6, "weak_mapping_or_untrusted_source")).when(~supported, case("boundary", 0.5, "insufficient_evidence"))
        .when(~known, case("novel", 0.9, "high_confidence_unknown_canonical")).otherwise(case("novel", 1.0, "unmapped_evidence_supported"))
    )


def novelty_score(distance: Column, ambiguity: Column, energy: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * distance + 0.3 * ambiguity + 0.2 * energy))


def route(score: Column, confidence: Column, known: float = 0.70, novel: float = 0.85, abstain: float = 0.01) -> Column:
    return F.when(score >= novel, "novel").when(score > known, "boundary").when(confidence < abstain, "abstain").otherwise("known")


# fixed values: words that are no aspects, objects too broad for one, strong cues, and hints of a general parent
BAD_NAMES = ("good", "bad", "great", "terrible", "excellent", "poor", "thing", "item", "product", "stuff", "use", "works")
BROAD_OBJECTS = ("computer", "restaurant", "product", "thing", "place", "dinner", "table", "bar", "glass")
STRONG_CUES = ("failure_event", "delay_event", "durability_event", "reliability_event", "support_problem", "usability_problem", "comfort_problem", "quality_judgment")
PARENT_HINTS = {
    "quality": ("quality", "build", "craft"), "performance": ("speed", "processor", "ram", "memory"), "storage": ("storage", "drive", "disk", "space"), "display": ("screen", "display", "lcd"),
    "durability": ("durable", "broke", "ripped", "wear"), "service": ("service", "staff", "support", "wait"), "delivery": ("delivery", "shipping", "arrived", "late"), "comfort": ("comfort", "noisy", "fit"),
}
#: Examples of evidence that are kept of an aspect; support and reviews that promote or queue it, and forms that queue it.
EXAMPLES = 5
LEAST_SUPPORT, LEAST_REVIEWS, LEAST_FORMS = 5, 3, 2


def generic_parent(name: Column) -> Column:
    """The first parent with a hint in the name, null without one."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for parent, hints in reversed(PARENT_HINTS.items()):
        hit = F.lit(False)
        for h in hints:
            hit = hit | F.contains(low, F.lit(h))
        out = F.when(hit, parent).otherwise(out)
    return out


def memory_status(aspect: Column, support: Column, reviews: Column, forms: Column, parent: Column, cue: Column) -> Column:
    """rejected, review_queue or candidate, where nothing is promoted without review."""
    queued = (support >= LEAST_SUPPORT) & (reviews >= LEAST_REVIEWS) & (forms >= LEAST_FORMS) & ~aspect.isin(*BROAD_OBJECTS) & (parent.isNotNull() | F.coalesce(cue.isin(*STRONG_CUES), F.lit(False)))
    return F.when((aspect == "") | aspect.isin(*BAD_NAMES), "rejected").when(queued, "review_queue").otherwise("candidate")


def memory(rows: DataFrame, promote: bool = False, salts: int = 32) -> DataFrame:
    """The memory of aspects that evidence (aspect_raw, review_id, domain, context, cue_type, seq) leaves, taken in the order
    of ``seq`` (whole numbers; equal ones by review and context): support, reviews, domains, the first EXAMPLES contexts,
    the last cue (of those at one place the last by name) and the status.

    With ``promote``, support and reviews are enough, once: an aspect is promoted if its last evidence is what made them
    enough and no other name of the same canonical form was promoted before; else it is queued. An aspect of any share
    of the rows is counted in parts (by review; examples by salt), so that no task has all of it. A null name is an empty one.
    """
    own = rows.select(F.lower(F.trim(F.coalesce("aspect_raw", F.lit("")))).alias("aspect"), "review_id", "domain", F.coalesce("context", F.lit("")).alias("context"), F.when(F.col("cue_type") != "", F.col("cue_type")).alias("cue_type"), F.struct("seq", "review_id", "context").alias("at"))
    by_review = own.groupBy("aspect", "review_id").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("domain").alias("domains"), F.min("at").alias("first"), F.max("at").alias("last"),
        F.max(F.when(F.col("cue_type").isNotNull(), F.struct("at", "cue_type"))).alias("cued"))
    found = by_review.groupBy("aspect").agg(
        F.sum("n").alias("support"), F.count("review_id").alias("reviews"), F.size(F.array_distinct(F.flatten(F.collect_set("domains")))).cast("long").alias("domains"), F.max("cued")["cue_type"].alias("cue"), F.max("last").alias("last"), F.max_by("n", "last").alias("last_review"))
    salted = own.select("aspect", "context", "at", F.pmod(F.xxhash64("review_id"), F.lit(salts)).alias("salt"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("at"))
    few = salted.withColumn("place", place("aspect", "salt")).where(F.col("place") <= EXAMPLES).withColumn("place", place("aspect")).where(F.col("place") <= EXAMPLES)
    kept = few.groupBy("aspect").agg(F.array_sort(F.collect_list(F.struct("place", "context", "at"))).alias("kept"))
    contexts = F.transform("kept", lambda k: k["context"])
    forms = F.size(F.array_distinct(F.transform(contexts, lambda c: F.lower(F.trim(c)))))
    out = found.join(kept, "aspect").withColumn("forms", forms.cast("long")).withColumn("parent", generic_parent(F.col("aspect")))
    out = out.withColumn("status", memory_status(F.col("aspect"), F.col("support"), F.col("reviews"), F.col("forms"), F.col("parent"), F.col("cue")))
    if promote:
        # when support and reviews became enough: at the fifth evidence or the first of the third review, the later one
        firsts = by_review.withColumn("place", F.row_number().over(Window.partitionBy("aspect").orderBy("first"))).where(F.col("place") == LEAST_REVIEWS).select("aspect", F.col("first").alias("third"))
        out = out.join(firsts, "aspect", "left").withColumn("enough", F.when(F.col("support") >= LEAST_SUPPORT, F.greatest(F.get("kept", F.lit(EXAMPLES - 1))["at"], F.col("third"))))
        out = out.withColumn("enough", F.when(F.col("third").isNotNull() & (F.col("status") != "rejected"), F.col("enough"))).withColumn("canonical", F.replace("aspect", F.lit(" "), F.lit("_")))
        earliest = F.min("enough").over(Window.partitionBy("canonical"))
        alone = (F.col("enough") == F.col("last")) & (earliest == F.col("enough"))
        out = out.withColumn("status", F.when(F.col("enough").isNull(), F.col("status")).when(alone, "promoted").otherwise("review_queue"))
    return out.select("aspect", "support", "reviews", "domains", "forms", "parent", "cue", contexts.alias("examples"), "status")


def grouped_split(groups: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """key and split: the groups in the order of a hash of seed and id, cut at shares of their number. A group is never parted."""
    ranked = groups.select(key).distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256))
    place = running_sum(ranked, F.lit(1), "place", "h")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    first = F.greatest(F.lit(1), F.floor(F.col("n") * train + 0.5))
    return place.crossJoin(F.broadcast(n)).select(key, F.when(F.col("place") <= first, "train").when(F.col("place") <= first + F.floor(F.col("n") * val + 0.5), "val").otherwise("test").alias("split"))


def group_leakage(rows: DataFrame, key: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return rows.groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def text_leakage(rows: DataFrame) -> DataFrame:
    """By pair of splits, the texts (trimmed, in lower case) that both hold."""
    seen = rows.select(F.lower(F.trim("text")).alias("t"), "split").distinct()
    sets = seen.groupBy("t").agg(F.array_sort(F.collect_set("split")).alias("s")).where("size(s) > 1")
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.greatest(F.size("s") - i - 1, F.lit(0))), lambda y: F.concat_ws("-", x, y))))
    return sets.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("texts"))


def distinct_texts(rows: DataFrame, key: str) -> DataFrame:
    """The first row, by key, of each exact text."""
    return rows.groupBy("text").agg(F.min(key).alias(key))


def mined_patterns(rows: DataFrame, least: int = 2) -> DataFrame:
    """Patterns of the neutral symptom phrases that stand in texts (text, domain), or of a row's own ``symptom_phrase``: how
    often, in which domains, and how often as evidence in the text itself."""
    from revlume.operators.gates import neutral_phrases

    given = F.when(F.col("symptom_phrase").isNotNull() & (F.col("symptom_phrase") != ""), F.array("symptom_phrase")) if "symptom_phrase" in rows.columns else F.lit(None).cast("array<string>")
    said = rows.select(F.coalesce("domain", F.lit("unknown")).alias("domain"), F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.explode(F.coalesce(given, neutral_phrases(F.col("text")))).alias("phrase"))
    own = said.select("domain", "low", F.trim(F.regexp_replace(F.lower("phrase"), r"\s+", " ")).alias("phrase")).where("phrase <> ''")
    stands = F.contains("low", F.col("phrase")) | F.startswith("phrase", F.lit("keeps ")) & F.contains("low", F.concat(F.lit("keep "), F.substring("phrase", 7, 1 << 30)))
    found = own.groupBy("phrase").agg(F.count(F.lit(1)).alias("support_count"), F.array_sort(F.collect_set("domain")).alias("domains"), F.count_if(stands).alias("evidence_valid_count")).where(F.col("support_count") >= least)
    name = F.regexp_replace(F.regexp_replace("phrase", "[^a-z0-9]+", "_"), "^_+|_+$", "")
    rate = F.col("evidence_valid_count").cast("double") / F.col("support_count")
    return found.select(
        F.concat(F.lit("mined_"), name).alias("pattern_id"), "phrase", name.alias("aspect_canonical"), "support_count", "domains", "evidence_valid_count", rate.alias("precision_estimate"), rate.alias("evidence_valid_rate"),
        F.when(F.size("domains") > 1, 1.0).otherwise(0.0).alias("domain_entropy"))


def validated_patterns(found: DataFrame, broad: tuple[str, ...], support: int = 2, valid_rate: float = 0.8, precision: float = 0.75) -> DataFrame:
    """``found`` with its status (promoted, or review_queue with reasons) and scope."""
    reasons = F.array_compact(F.array(
        F.when(F.col("support_count") < support, "insufficient_support"), F.when(F.col("evidence_valid_rate") < valid_rate, "invalid_evidence"), F.when(F.col("precision_estimate") < precision, "low_precision"),
        F.when(F.col("phrase").isin(*broad), "broad_phrase")))
    return found.withColumn("reason_codes", reasons).withColumn("status", F.when(F.size("reason_codes") > 0, "review_queue").otherwise("promoted")).withColumn("domain_scope", F.when(F.size("domains") > 1, "global").otherwise("domain_scoped"))


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns, by one shuffle over grouping sets."""
    sets = [[F.col(c)] for c in columns]
    counted = rows.groupingSets(sets, *columns).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    width = len(columns)
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        own = F.col("g") == (2**width - 1 - 2 ** (width - 1 - i))
        field, value = F.when(own, F.lit(c)).otherwise(field), F.when(own, F.col(c).cast("string")).otherwise(value)
    return counted.select(field.alias("field"), value.alias("value"), "n")


def snapshot(rows: DataFrame, key: str, value: str, *groups: str, block: int = 1000) -> DataFrame:
    """A hash of each group's rows in the order of their whole-number key: of row hashes by blocks of consecutive keys, of
    blocks by blocks of blocks, so that no task gathers a group. Equal rows stay side by side; null keys are left out."""
    def hashed(df: DataFrame, by: list[str], place: str, digest: str, sep: str = "") -> DataFrame:
        one = F.struct(F.col(place), F.col(digest))
        ordered = F.array_sort(F.collect_list(one))
        text = F.array_join(F.transform(ordered, lambda x: F.concat(x[place].cast("string"), F.lit(sep), x[digest]) if sep else x[digest]), "|")
        return df.groupBy(*by).agg(F.sha1(text).alias("h"))

    down = lambda c: F.floor(F.col(c) / block)
    low = hashed(rows.where(F.col(key).isNotNull()).select(*groups, F.col(key).alias("p"), F.sha1(value).alias("d"), down(key).alias("block")), [*groups, "block"], "p", "d", ":")
    high = hashed(low.select(*groups, F.col("block").alias("p"), F.col("h").alias("d"), down("block").alias("upper")), [*groups, "upper"], "p", "d")
    return hashed(high.select(*groups, F.col("upper").alias("p"), F.col("h").alias("d")), list(groups), "p", "d").withColumnRenamed("h", "snapshot")
