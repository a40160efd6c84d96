"""The report on an exported benchmark and the gate before its release.

An artifact is a set of rows (key, split, group_id, review_text, novelty_status, hardness_tier, gold), where gold is
array<struct<source_type, label_type, mapping_source, mapping_scope, mapping_layers, aspect_canonical, evidence_text,
evidence_span, matched_terms, quality_flags>>; many artifacts are judged at once, by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlume.functions import text as X

# fixed values: kinds of sources, flags of rejected interpretations, limits of the two profiles
SOURCE_TYPES = ("explicit", "implicit_learned", "implicit_json", "implicit_llm", "merged")
REJECTING = ("llm_drop", "repair_failed", "low_quality")
STRICT, RESEARCH = "diagnostic_strict", "research_default"
LIMITS = {
    RESEARCH: {"provisional": (0.50, 0.70), "full_review": (0.15, 0.30), "term": 0.85, "novelty": 0.8, "provenance": 0.1},
    STRICT: {"provisional": (None, 0.25), "full_review": (None, 0.05), "term": 0.95, "novelty": 0.5, "provenance": 0.0},
}


def _or(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def _exact(g: Column) -> Column:
    """Whether the evidence is the text of its span; a span without numbers is not."""
    start, stop = g["evidence_span"][0], g["evidence_span"][1]
    text = F.coalesce(F.col("review_text"), F.lit(""))
    return (start >= 0) & (F.substring(text, start + 1, F.greatest(stop - start, F.lit(0))) == F.coalesce(g["evidence_text"], F.lit("")))


def _hit(g: Column) -> Column:
    low = F.lower(F.coalesce(g["evidence_text"], F.lit("")))
    return F.exists(g["matched_terms"], lambda t: (F.trim(t) != "") & F.contains(low, F.lower(t)))


def quality_report(rows: DataFrame, key: str, accounting: DataFrame | None = None) -> DataFrame:
    """One row for each artifact: counts of rows and interpretations and the rates that the gate reads.

    Interpretations are counted within their row's array, so that what is shuffled is one partial aggregate of a key and
    not an exploded row each. ``accounting`` (key, loaded_rows, rejected_rows, discarded_rows, runtime_reasons) tells what became
    of the rows that were read; without it all of them were exported. A row without gold (null or empty) counts as a row
    alone; an artifact without rows has no report.
    """
    whole = lambda g: F.size(g["evidence_span"]) == 2

    def found(condition) -> Column:
        return F.coalesce(F.sum(F.size(F.filter("gold", condition))), F.lit(0))

    flags = F.flatten(F.transform("gold", lambda g: F.coalesce(g["quality_flags"], F.array().cast("array<string>"))))
    size = F.coalesce(F.size("gold"), F.lit(0))
    counted = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_exported"), *(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")),
        F.sum(F.when(size > 0, size).otherwise(0)).alias("total_gold"), F.max(F.greatest(size, F.lit(0))).cast("long").alias("max_gold"),
        F.count_if(_or(F.col("novelty_status"), "known") == "novel").alias("novel_rows"),
        found(lambda g: g["aspect_canonical"] == "unknown").alias("unknown"), found(lambda g: g["mapping_source"] == "anchor_modifier").alias("anchor_modifier_count"),
        found(lambda g: g["mapping_source"] == "provisional").alias("provisional"), found(lambda g: _or(g["mapping_source"], "none").isin("unknown", "none")).alias("unknown_provenance"),
        found(lambda g: _or(g["mapping_scope"], "unknown") == "unknown").alias("mapping_scope_unknown_count"),
        found(lambda g: ~_or(g["source_type"], "unknown").isin(*SOURCE_TYPES)).alias("invalid_source_types"), found(lambda g: g["source_type"] == "implicit_learned").alias("implicit_learned"),
        found(whole).alias("spans"), found(lambda g: whole(g) & _exact(g)).alias("exact_spans"),
        found(lambda g: whole(g) & (g["evidence_span"][0] == 0) & (g["evidence_span"][1] == F.length(F.coalesce(F.col("review_text"), F.lit(""))))).alias("full_spans"),
        found(lambda g: F.size(g["matched_terms"]) > 0).alias("with_terms"), found(_hit).alias("term_hits"),
        F.coalesce(F.sum(F.size(F.filter(flags, lambda f: f.isin(*REJECTING)))), F.lit(0)).alias("rejected_interpretations"),
    )
    if accounting is None:
        whole_run = counted.withColumns({"loaded_rows": F.col("total_exported"), "rejected_rows": F.lit(0), "discarded_rows": F.lit(0), "runtime_reasons": F.lit(0)})
    else:
        whole_run = counted.join(accounting.select(key, "loaded_rows", "rejected_rows", "discarded_rows", "runtime_reasons"), key, "left").fillna(0, ["loaded_rows", "rejected_rows", "discarded_rows", "runtime_reasons"])
    rate = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return whole_run.withColumns({
        "unknown_rate": rate("unknown", "total_gold"), "provisional_rate": rate("provisional", "total_gold"), "provenance_unknown_rate": rate("unknown_provenance", "total_gold"), "novelty_rate": rate("novel_rows", "total_exported"),
        "exact_match_rate": rate("exact_spans", "spans"), "full_review_evidence_rate": rate("full_spans", "spans"), "matched_term_in_evidence_rate": rate("term_hits", "with_terms"),
        "avg_gold_per_row": rate("total_gold", "total_exported"), "accounting_valid": F.col("loaded_rows") == F.col("total_exported") + F.col("rejected_rows") + F.col("discarded_rows"),
    })


def distributions(rows: DataFrame, key: str) -> DataFrame:
    """(key, field, value, n): how often each kind, source, scope, layer, novelty and tier occurs, by one shuffle of counts."""
    one = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    item = lambda g: F.concat(
        F.array(one("source_type", _or(g["source_type"], "unknown")), one("label_type", _or(g["label_type"], "unknown")), one("mapping_source", _or(g["mapping_source"], "none")), one("mapping_scope", _or(g["mapping_scope"], "unknown"))),
        F.coalesce(F.transform(g["mapping_layers"], lambda x: one("mapping_layer", x)), F.array().cast("array<struct<field:string,value:string>>")))
    own = F.array(one("novelty", _or(F.col("novelty_status"), "known")), one("hardness", _or(F.col("hardness_tier"), "H0")))
    pairs = F.concat(own, F.coalesce(F.flatten(F.transform("gold", item)), F.array().cast("array<struct<field:string,value:string>>")))
    return rows.select(key, F.explode(pairs).alias("p")).groupBy(key, "p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """(key, leaked_groups, leaked_texts): groups and texts (trimmed, in lower case, blank ones apart) of an artifact that stand in several splits.

    Groups and texts are met as one kind of value, so that the rows are shuffled once. A missing group is one group.
    """
    text = F.lower(F.regexp_replace("review_text", r"(?U)^\s+|\s+$", ""))
    values = F.array(F.struct(F.lit(True).alias("is_group"), F.coalesce(F.col("group_id").cast("string"), F.lit("")).alias("value")), F.struct(F.lit(False).alias("is_group"), F.sha2(X.blank_to_null(text), 256).alias("value")))
    seen = rows.select(key, "split", F.explode(values).alias("v")).where("v.value is not null").groupBy(key, "v.is_group", "v.value").agg((F.min("split") != F.max("split")).alias("leaks"))
    return seen.groupBy(key).agg(F.count_if(F.col("is_group") & F.col("leaks")).alias("leaked_groups"), F.count_if(~F.col("is_group") & F.col("leaks")).alias("leaked_texts"))


def release_gate(report: DataFrame, leaks: DataFrame, key: str, profile: str = RESEARCH, require_learned: bool = False) -> DataFrame:
    """(key, profile, status, failures, warnings): FATAL by the first invariant that does not hold, whatever the profile;
    else FAIL by the failures, where the strict profile stops at the first unknown name, excess of novelty or unknown provenance; else PASS.
    """
    limit, strict = LIMITS[profile], profile == STRICT
    c = F.col
    rows = report.join(leaks, key, "left").fillna(0, ["leaked_groups", "leaked_texts"])
    fatal = F.coalesce(
        F.when(c("leaked_groups") > 0, "grouped_leakage"), F.when(c("leaked_texts") > 0, "exact_text_leakage"), F.when(~c("accounting_valid"), "accounting_mismatch"),
        F.when(c("exact_match_rate") < 1.0, "evidence_mismatch"), F.when(c("invalid_source_types") > 0, "invalid_source_type"))
    unknown, novel = F.when(c("unknown_rate") > 0, "unknown_canonicals"), F.when(c("novelty_rate") > limit["novelty"], "novelty_rate")
    provenance = F.when(c("provenance_unknown_rate") > limit["provenance"], "unknown_provenance")
    alone = F.coalesce(unknown, novel, provenance) if strict else F.lit(None).cast("string")
    unexplained = F.when((c("rejected_rows") > 0) & (c("rejected_interpretations") + c("runtime_reasons") == 0), "rejected_without_reason")
    no_modifier, few_terms = F.when(c("anchor_modifier_count") == 0, "no_anchor_modifier"), F.when(c("matched_term_in_evidence_rate") < limit["term"], "matched_term_rate")
    over = lambda name, column: F.when(c(column) > limit[name][1], column)
    near = lambda name, column: F.when((c(column) > limit[name][0]) & (c(column) <= limit[name][1]), column) if limit[name][0] is not None else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    failures = F.array_compact(F.array(
        unknown, F.when(c("mapping_scope_unknown_count") > 0, "mapping_scope_unknown"), unexplained if strict else none, over("provisional", "provisional_rate"), no_modifier if strict else none, over("full_review", "full_review_evidence_rate"),
        novel, provenance, F.when(F.lit(require_learned) & (c("implicit_learned") == 0), "no_implicit_learned")))
    warnings = F.array_compact(F.array(none if strict else unexplained, near("provisional", "provisional_rate"), near("full_review", "full_review_evidence_rate"), none if strict else no_modifier, few_terms))
    stopped = F.coalesce(fatal, alone)
    why = F.when(stopped.isNotNull(), F.array(stopped)).otherwise(failures)
    return rows.select(
        key, F.lit(profile).alias("profile"), F.when(fatal.isNotNull(), "FATAL").when(F.size(why) > 0, "FAIL").otherwise("PASS").alias("status"), why.alias("failures"),
        F.when(stopped.isNotNull(), F.array().cast("array<string>")).otherwise(warnings).alias("warnings"))
