"""Gates and routing of candidates: drop reasons, export routes, broad labels, canonical names with their fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.functions import text as X
from revlume.operators import etl as E
from revlume.operators import records as C

# fixed values: vague heads, aliases of labels, what a graph leaves out, its least weight
VAGUE = ("something", "anything", "everything", "nothing", "every", "means", "general", "unknown")
ALIASES = {"my cam": "camera", "cam": "camera", "built in mic": "microphone", "built-in mic": "microphone"}
GRAPH_BLOCKED = ("general", "unknown", "thing", "something", "everything", "means", "time", "place", "item")
GRAPH_WEIGHT = 0.75
# fixed values: words by which a candidate without a canonical name is judged
START_VERBS = ("recommend", "save", "lose", "have", "make", "use", "buy", "try", "go", "come", "get", "take", "give", "watch", "upload", "download", "open", "close")
START_PRONOUNS = ("this", "that", "these", "those", "my", "your", "our", "their", "his", "her", "its")
CONTEXT_NOUNS = ("occasion", "beginning", "time", "day", "night", "moment", "thing", "stuff", "way", "part", "kind", "type", "lot")
SENTIMENT_PREFIXES = ("great", "excellent", "amazing", "terrible", "awful", "bad", "good", "poor", "delicious", "tasty", "slow", "fast")
BE_FORMS = ("is", "was", "were", "are", "be", "being", "been")
OPINION_CUES = ("good", "bad", "great", "poor", "slow", "fast", "broken", "broke", "excellent", "awful", "amazing", "terrible", "soft", "hard")
# fixed values: how a selection score weighs its metrics
SELECTION = {"accuracy": 0.30, "macro_f1": 0.20, "aspect_only_accuracy": 0.12, "grouped_accuracy": 0.13, "grouped_macro_f1": 0.10, "known_vs_novel_f1": 0.05, "abstention_f1": 0.05}


def explicit_label(x: Column) -> Column:
    """Lower case, separators as spaces, without a leading ``my``, aliases resolved."""
    plain = X.squash(F.translate(F.lower(F.coalesce(x, F.lit(""))), "_-", "  "))
    plain = F.trim(F.regexp_replace(plain, "^my ", ""))
    names = F.create_map(*(F.lit(v) for kv in ALIASES.items() for v in kv))
    return F.coalesce(names[plain], plain)


def drop_reason(label: Column, gate: Column) -> Column:
    """Why an explicit aspect is dropped, by the first rule that holds; null if it stays. ``gate`` is that of the explicit gate."""
    first = F.split(label, " ")[0]
    return (
        F.when(label == "", "empty").when(first.rlike("^[0-9]+$"), "numeric_quantity").when(label.isin(*VAGUE), "vague_head")
        .when(~gate["accepted"], gate["reason"])
    )


def implicit_allowed(label: Column, domain: Column, denied: Column, own: Column, generic: Column) -> Column:
    """Whether an implicit aspect may stay in a domain: not of low quality, and of the domain's or generic words where a domain is given."""
    good = lambda plain: (plain != "") & ~F.array_contains(denied, plain)
    return X.let(X.normalize(F.coalesce(label, F.lit(""))), lambda plain: good(plain) & (X.blank_to_null(domain).isNull() | C.matches_any(plain, own) | C.matches_any(plain, generic)))


def gate_implicit(rows: DataFrame, allowed: Column) -> DataFrame:
    """Known rows that do not abstain and are not allowed become boundary rows that do; others pass unchanged."""
    known = (F.lower(F.coalesce("routing", F.lit("known"))) == "known") & (F.lower(F.coalesce("decision", F.lit(""))) != "abstain") & ~F.coalesce("abstain", F.lit(False))
    turned = known & ~allowed
    new = {"routing": F.lit("boundary"), "decision": F.lit("abstain"), "abstain": F.lit(True), "reason": F.lit("domain_mismatch")}
    return rows.select(*(c for c in rows.columns if c not in new), *(F.when(turned, v).otherwise(F.col(c)).alias(c) for c, v in new.items()))


def allowed_in_graph(cluster: Column, raw: Column, weight: Column) -> Column:
    name = X.squash(F.lower(F.coalesce(X.blank_to_null(cluster), raw, F.lit(""))))
    return (name != "") & ~name.isin(*GRAPH_BLOCKED) & F.coalesce(weight >= GRAPH_WEIGHT, F.lit(True))


def export_route(reasons: Column, split: Column) -> Column:
    """struct<destination, reasons> of a row from the reasons of all its items (array of arrays; null or empty: no items)."""
    distinct = F.array_sort(F.array_distinct(F.flatten(reasons)))
    to = F.when((split == "train") & (F.size(distinct) > 0), "review_queue").when(F.array_contains(distinct, "missing_evidence"), "hard_reject").otherwise("benchmark_gold")
    none = reasons.isNull() | (F.size(reasons) == 0)
    return F.struct(F.when(none, "hard_reject").otherwise(to).alias("destination"), F.when(none, F.array(F.lit("no_interpretations"))).otherwise(distinct).alias("reasons"))


def prune_broad(items: Column, broad: Column) -> Column:
    """Of array<struct<label_type, canonical, ...>>, without explicit broad labels where an explicit specific one stands beside; one item alone stays."""
    is_broad = lambda x: F.array_contains(broad, F.lower(F.trim(x["canonical"])))
    specific = F.exists(items, lambda x: (x["label_type"] == "explicit") & ~is_broad(x))
    kept = F.filter(items, lambda x: (x["label_type"] == "implicit") | ~is_broad(x) | ~specific)
    return F.when(F.size(items) <= 1, items).otherwise(kept)


def neutral_phrases(x: Column) -> Column:
    """keeps X, stopped X, does not X, X under Y, in this order of kinds."""
    # fixed values: the patterns
    low = F.lower(F.coalesce(x, F.lit("")))
    found = lambda rule, group=1: F.regexp_extract_all(low, F.lit(rule), F.lit(group))
    under = r"\b([a-z]+s?)\s+under\s+([a-z]+)\b"
    return F.concat(
        F.transform(found(r"\bkeeps?\s+([a-z]+(?:ing|ed|s)?)\b"), lambda w: F.concat(F.lit("keeps "), w)), F.transform(found(r"\bstopped\s+([a-z]+(?:ing|ed)?)\b"), lambda w: F.concat(F.lit("stopped "), w)),
        F.transform(found(r"\bdoes\s+not\s+([a-z]+)\b"), lambda w: F.concat(F.lit("does not "), w)), F.zip_with(found(under), found(under, 2), lambda a, b: F.concat_ws(" under ", a, b)),
    )


def family_scores(x: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """array<struct<family, confidence, matched>> of the families with a term in the text, best first, ties as given."""
    low = F.lower(F.coalesce(x, F.lit("")))
    scored = []
    for place, (name, terms) in enumerate(families.items()):
        matched = F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(low, F.lower(t)))
        confidence = F.least(F.lit(0.95), 0.4 + 0.1 * F.size(matched))
        scored.append(F.struct((-confidence).alias("far"), F.lit(place).alias("place"), F.lit(name).alias("family"), confidence.alias("confidence"), matched.alias("matched")))
    hits = F.filter(F.array(*scored), lambda s: F.size(s["matched"]) > 0)
    return F.transform(F.array_sort(hits), lambda s: F.struct(s["family"].alias("family"), s["confidence"].alias("confidence"), s["matched"].alias("matched")))


def looks_like_noise(candidate: Column, evidence: Column) -> Column:
    raw = F.trim(F.lower(F.coalesce(candidate, F.lit(""))))
    first = F.split(X.squash(raw), " ")[0]
    number = F.regexp_replace(raw, r"^([^.]*)\.", "$1").rlike("^[0-9]+$")
    return (raw == "") | E.noisy_label(raw) | first.isin(*START_VERBS) | first.isin(*START_PRONOUNS) | raw.isin(*CONTEXT_NOUNS) | number | X.blank_to_null(F.coalesce(evidence, F.lit(""))).isNull()


def unmapped(candidate: Column, evidence: Column, support: Column) -> Column:
    """struct<bucket, score> of a candidate without a canonical name, by an additive score."""
    c, e = F.trim(F.lower(F.coalesce(candidate, F.lit("")))), F.trim(F.lower(F.coalesce(evidence, F.lit(""))))
    tokens = F.split(X.squash(c), " ")
    noun = (c != "") & ~tokens[0].isin(*START_VERBS) & ~tokens[0].isin(*START_PRONOUNS) & ~F.exists(tokens, lambda t: t.isin(*BE_FORMS)) & (F.size(tokens) <= 3)
    worth = lambda rule, points: F.when(rule, points).otherwise(0.0)

    def scored(e: Column, noise: Column) -> Column:
        cue = F.exists(F.array(*(F.lit(w) for w in OPINION_CUES)), lambda w: F.contains(e, w))
        return F.round(worth(noun, 0.25) + worth((c != "") & F.contains(e, c) & (c != e), 0.15) + worth(cue, 0.25) + worth(~noise, 0.15) + worth(support > 1, 0.1), 6)

    def judged(score: Column, noise: Column) -> Column:
        bucket = F.when(score >= 0.75, "open_world").when(score >= 0.5, "provisional").when(score >= 0.35, "memory_candidate").otherwise("dropped_noise")
        return F.struct(F.when(noise, "dropped_noise").otherwise(bucket).alias("bucket"), F.when(noise, 0.0).otherwise(score).alias("score"))

    # the evidence may be a long text: lowered once, not for each cue and bound
    return X.let(looks_like_noise(candidate, evidence), lambda noise: X.let(X.let(e, lambda low: scored(low, noise)), lambda score: judged(score, noise)))


def strip_sentiment(x: Column) -> Column:
    """Without the sentiment words at the beginning."""
    words = "|".join(SENTIMENT_PREFIXES)
    return F.trim(F.regexp_replace(X.squash(F.lower(F.coalesce(x, F.lit("")))), rf"^((?:{words})( |$))+", ""))


def canonicalize(rows: DataFrame, steps: list[tuple[str, float, DataFrame, list[str]]]) -> DataFrame:
    """canonical, layer and confidence of rows (aspect_raw, evidence, ...): by the dictionaries, else by the bucket of what has no name there."""
    mapped = C.map_by_steps(rows, steps)
    raw = F.trim("aspect_raw")
    snake = lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("_"))
    fine = (raw != "") & ~E.noisy_label(raw)
    bucket = F.col("bucket")
    kind = (
        F.when(F.col("canonical").isNotNull(), F.col("layer")).when((bucket == "provisional") & fine, "provisional")
        .when((bucket == "open_world") & fine & (F.size(F.split(X.squash(raw), " ")) <= 4) & raw.rlike(r"\p{L}"), "open_world").when(bucket == "dropped_noise", "dropped_noise").otherwise("memory_candidate")
    )
    stripped = strip_sentiment(F.col("aspect_raw"))
    name = F.when(F.col("canonical").isNotNull(), F.col("canonical")).when(F.col("kind") == "provisional", snake(raw)).when(F.col("kind") == "open_world", snake(F.coalesce(X.blank_to_null(stripped), raw))).otherwise("unknown")
    sure = F.when(F.col("canonical").isNotNull(), F.col("confidence")).when(F.col("kind") == "provisional", 0.35).when(F.col("kind") == "open_world", 0.25).otherwise(0.0)
    judged = mapped.withColumn("bucket", unmapped(F.col("aspect_raw"), F.col("evidence"), F.lit(1))["bucket"]).withColumn("kind", kind)
    return judged.select(*rows.columns, name.alias("canonical"), F.col("kind").alias("layer"), sure.alias("confidence"))


def clauses(x: Column) -> Column:
    """array<struct<snippet, start, stop>> of the text with single spaces: cut after stops and at commas and semicolons before a space."""
    plain = X.squash(F.coalesce(x, F.lit("")))
    marked = F.regexp_replace(F.regexp_replace(plain, "([.!?]) ", "$1\x01"), "[;,] ", "\x02\x01")

    def span(p: Column, at: Column) -> Column:
        snippet = F.rtrim(p, F.lit("\x02"))
        return F.struct(snippet.alias("snippet"), at.alias("start"), (at + F.length(snippet)).cast("int").alias("stop"))

    spans = X.let(F.split(marked, "\x01"), lambda parts: F.zip_with(parts, X.starts(F.transform(parts, lambda p: F.length(p) + 1), F.lit(0)), span))
    return F.filter(spans, lambda s: F.length(s["snippet"]) > 0)


def selection_score(metrics: DataFrame) -> Column:
    """The blend of metrics; accuracy and macro_f1 stand for those that are null, a missing calibration error is the worst."""
    instead = {"aspect_only_accuracy": "accuracy", "grouped_accuracy": "accuracy", "grouped_macro_f1": "macro_f1", "known_vs_novel_f1": "abstention_f1"}
    have = lambda name, other=0.0: F.coalesce(F.col(name), F.lit(other)) if name in metrics.columns else F.lit(other)
    value = lambda name: F.coalesce(F.col(name), have(instead[name])) if name in metrics.columns and name in instead else have(instead.get(name, name))
    total = sum((weight * value(name) for name, weight in SELECTION.items()), F.lit(0.0))
    return total + 0.03 * (1 - have("calibration_ece", 1.0)) + 0.02 * have("coverage")


def row_score(evidence: Column, novelty: Column, ambiguity: Column, repairs: Column) -> Column:
    """Evidence and bonuses less a fifth for each repair (half at most), within [0, 1]."""
    penalty = F.least(F.lit(0.5), F.greatest(F.lit(0), repairs) * 0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), evidence + novelty + ambiguity - penalty))


def tier(ambiguity: Column, novelty: Column) -> Column:
    return F.when(novelty != "known", "H3").when(ambiguity >= 0.75, "H2").when(ambiguity > 0, "H1").otherwise("H0")


def policy(mode: Column) -> Column:
    """struct<policy, min_confidence_train> of a profile's mode."""
    name = F.when(mode == "implicit_heavy", "evidence_strict").when(mode == "explicit_heavy", "canonical_balanced").otherwise("balanced")
    return F.struct(name.alias("policy"), F.when(name == "evidence_strict", 0.6).otherwise(0.5).alias("min_confidence_train"))


def parse_time(x: Column) -> Column:
    """An ISO timestamp or date; null for anything else, which means no bound."""
    plain = F.trim(x)
    return F.coalesce(F.try_to_timestamp(plain), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")))


def label_variants(x: Column) -> Column:
    """The forms under which a label may be stored: normalised, its key, with hyphens, as given, and its plural in the same forms."""
    plain = X.normalize(x)
    swap = lambda v, by: F.replace(v, F.lit(" "), F.lit(by))
    last = F.element_at(F.split(plain, " "), -1)
    head = F.substring(plain, F.lit(1), F.length(plain) - F.length(last))
    plural = F.concat(head, F.when(last.endswith("y") & (F.length(last) > 1), F.concat(F.substring(last, F.lit(1), F.length(last) - 1), F.lit("ies"))).when(last.endswith("s"), last).otherwise(F.concat(last, F.lit("s"))))
    forms = F.array(plain, swap(plain, "_"), swap(plain, "-"), F.trim(x), plural, swap(plural, "_"), swap(plural, "-"))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(forms)))


def working_sample(rows: DataFrame, key: str, seed: int, n: int, offset: int = 0, chunk: int | None = None) -> DataFrame:
    """n rows in an order by a hash of seed and key, and of these a chunk from an offset on (a sampling operator)."""
    order = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    taken = rows.withColumn("order", order).orderBy("order", key).limit(n)
    return taken.orderBy("order", key).offset(offset).limit(n if chunk is None else chunk).drop("order")


def benchmark_examples(rows: DataFrame) -> DataFrame:
    """A row for each gold interpretation of (id, review_text, domain, split, gold: array<struct<aspect, sentiment>>), with all labels of its parent."""
    label = lambda g: F.concat_ws("__", F.coalesce(X.blank_to_null(g["aspect"]), F.lit("unknown")), F.lower(F.coalesce(g["sentiment"], F.lit("neutral"))))
    bad = X.blank_to_null(F.col("id").cast("string")).isNull() | X.blank_to_null(F.col("review_text")).isNull() | F.col("gold").isNull() | (F.size("gold") == 0)
    whole = rows.where(F.assert_true(~F.coalesce(bad, F.lit(True)), F.lit("a benchmark row lacks its id, text or interpretations")).isNull())
    flat = whole.withColumn("labels", F.transform("gold", label)).select("id", "domain", "split", "labels", F.posexplode("gold").alias("at", "g"))
    return flat.select(F.concat(F.col("id").cast("string"), F.lit("_g"), (F.col("at") + 1).cast("string")).alias("example_id"), "id", "domain", "split", label(F.col("g")).alias("label"), "labels")


def rolling_mean(rows: DataFrame, value: str, order: list[str], *keys: str, last: int = 20) -> DataFrame:
    """Mean of the last values, this one included, in each key's order."""
    return rows.withColumn("rolling", F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(last - 1), 0)))


def artifact_report(rows: DataFrame) -> DataFrame:
    """One row: rows by split, empty splits, rows without id, text or a right span, groups and texts in several splits."""
    one = lambda s: F.count_if(F.col("split") == s).alias(f"n_{s}")
    own = rows.agg(*(one(s) for s in E.SPLITS), F.count_if(X.blank_to_null(F.col("id").cast("string")).isNull() | X.blank_to_null(F.col("review_text")).isNull()).alias("incomplete"), F.count_if(F.col("issue").isNotNull()).alias("bad_spans"))
    leaks = lambda c, name: rows.groupBy(c).agg(F.countDistinct("split").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias(name))
    both = own.crossJoin(leaks(F.col("group_id"), "leaked_groups")).crossJoin(leaks(F.lower(X.squash(F.col("review_text"))), "leaked_texts"))  # one row each
    fine = (F.least(*(F.col(f"n_{s}") for s in E.SPLITS)) > 0) & (F.col("incomplete") + F.col("bad_spans") + F.col("leaked_groups") + F.col("leaked_texts") == 0)
    return both.withColumn("valid", fine)
