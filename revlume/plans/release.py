"""Reports on artifacts and their release: each domain's reviews with their mentions are one artifact."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlume.operators import release as O
from revlume.plans.analytics import rows
from revlume.plans.registry import Registry
from revlume.plans.views import with_views

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

ARTIFACTS = """t AS (SELECT review_id, domain, product_id, CASE WHEN domain = 'FURNITURE' THEN '' ELSE review_id || ': ' END || string_agg(aspect_raw, '. ' ORDER BY position, aspect_raw) AS text FROM joined GROUP BY 1, 2, 3),
a AS (SELECT *, CASE CASE WHEN domain = 'BUILDING' THEN review_id ELSE product_id END % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, review_id % 5 = 0 AS novel FROM t),
g AS (SELECT a.*, position, conf, source, aspect_raw, domain = 'AUTOMOBILE' AS odd, CASE source WHEN 'explicit' THEN 'explicit' WHEN 'implicit' THEN 'implicit_learned' END AS source_type,
 CASE WHEN conf < 92 THEN 'provisional' WHEN conf = 92 THEN 'anchor_modifier' WHEN conf = 100 AND domain = 'AUTOMOBILE' THEN 'none' ELSE 'exact_phrase' END AS mapping_source, CASE WHEN conf = 91 AND domain = 'AUTOMOBILE' THEN 'unknown' ELSE 'generic' END AS mapping_scope,
 strpos(text, aspect_raw) - 1 + CASE WHEN domain = 'MACHINERY' AND conf = 95 THEN 1 ELSE 0 END AS begins FROM a JOIN predictions USING (review_id))"""

REPORT = (
    ARTIFACTS
    + """, ra AS (SELECT domain, count(*) AS total_exported, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (novel) AS novel_rows FROM a GROUP BY 1),
rg AS (SELECT domain, count(*) AS total_gold, count(*) FILTER (odd AND conf = 95) AS unknown, count(*) FILTER (mapping_source = 'anchor_modifier') AS modifiers, count(*) FILTER (mapping_source = 'provisional') AS provisional, count(*) FILTER (mapping_source = 'none') AS nameless,
 count(*) FILTER (mapping_scope = 'unknown') AS scopeless, count(*) FILTER (source_type = 'implicit_learned') AS learned, count(*) FILTER (substr(text, CAST(begins + 1 AS INTEGER), length(aspect_raw)) = aspect_raw) AS exact, count(*) FILTER (begins = 0 AND length(text) = length(aspect_raw)) AS full_text,
 count(*) FILTER (position % 2 = 1 OR conf < 92) AS with_terms, count(*) FILTER (position % 2 = 1) AS hits, count(*) FILTER (position = 7) AS flagged FROM g GROUP BY 1),
rm AS (SELECT domain, max(n) AS max_gold FROM (SELECT domain, review_id, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
report AS (SELECT *, unknown::DOUBLE / total_gold AS unknown_rate, provisional::DOUBLE / total_gold AS provisional_rate, nameless::DOUBLE / total_gold AS provenance_rate, novel_rows::DOUBLE / total_exported AS novelty_rate, exact::DOUBLE / total_gold AS exact_rate, full_text::DOUBLE / total_gold AS full_rate, hits::DOUBLE / greatest(1, with_terms) AS term_rate
 FROM ra JOIN rg USING (domain) JOIN rm USING (domain))"""
)


def artifacts(spark, d):
    """Rows of five artifacts. One splits its groups, one has equal texts, one has spans that miss their evidence, one has interpretations without names."""
    at = F.array_sort(F.collect_list(F.struct("position", "aspect_raw", "aspect", "conf", "source")))
    own = rows(spark, d).groupBy("review_id", "domain", "product_id").agg(at.alias("said"))
    names = F.array_join(F.transform("said", lambda x: x["aspect_raw"]), ". ")
    own = own.withColumn("review_text", F.concat(F.when(F.col("domain") == "FURNITURE", "").otherwise(F.concat(F.col("review_id").cast("string"), F.lit(": "))), names))
    odd, none = F.col("domain") == "AUTOMOBILE", F.lit(None).cast("array<string>")

    def gold(x):
        start = F.position(x["aspect_raw"], F.col("review_text")) - 1 + F.when((F.col("domain") == "MACHINERY") & (x["conf"] == 95), 1).otherwise(0)
        source = F.when(x["conf"] < 92, "provisional").when(x["conf"] == 92, "anchor_modifier").when((x["conf"] == 100) & odd, "none").otherwise("exact_phrase")
        terms = F.when(x["position"] % 2 == 1, F.array(F.split_part(x["aspect_raw"], F.lit(" "), F.lit(1)))).when(x["conf"] < 92, F.array(F.lit("elsewhere")))
        return F.struct(
            F.when(x["source"] == "explicit", "explicit").otherwise("implicit_learned").alias("source_type"), x["source"].alias("label_type"), source.alias("mapping_source"), F.when((x["conf"] == 91) & odd, "unknown").otherwise("generic").alias("mapping_scope"),
            F.array(F.lit("generic")).alias("mapping_layers"), F.when((x["conf"] == 95) & odd, "unknown").otherwise(x["aspect"]).alias("aspect_canonical"), x["aspect_raw"].alias("evidence_text"), F.array(start, start + F.length(x["aspect_raw"])).alias("evidence_span"),
            terms.alias("matched_terms"), F.when(x["position"] == 7, F.array(F.lit("low_quality"))).otherwise(none).alias("quality_flags"))

    turn = F.when(F.col("domain") == "BUILDING", F.col("review_id")).otherwise(F.col("product_id")) % 10
    return own.select(
        "domain", F.when(turn == 0, "val").when(turn == 1, "test").otherwise("train").alias("split"), F.col("product_id").alias("group_id"), "review_text",
        F.when(F.col("review_id") % 5 == 0, "novel").otherwise("known").alias("novelty_status"), F.lit("H0").alias("hardness_tier"), F.transform("said", gold).alias("gold"))


@R.add("A21_artifact_reports", with_views(REPORT + " SELECT domain, total_exported, n_train, n_val, n_test, total_gold, max_gold, unknown_rate, provisional_rate, provenance_rate AS provenance_unknown_rate, novelty_rate, exact_rate AS exact_match_rate, full_rate AS full_review_evidence_rate, term_rate AS matched_term_in_evidence_rate, modifiers AS anchor_modifier_count, scopeless AS mapping_scope_unknown_count, flagged AS rejected_interpretations, total_gold::DOUBLE / total_exported AS avg_gold_per_row, true AS accounting_valid FROM report"))
def a21(spark, d):
    """The report on each domain's artifact."""
    return O.quality_report(artifacts(spark, d), "domain").select(
        "domain", "total_exported", "n_train", "n_val", "n_test", "total_gold", "max_gold", "unknown_rate", "provisional_rate", "provenance_unknown_rate", "novelty_rate", "exact_match_rate", "full_review_evidence_rate", "matched_term_in_evidence_rate",
        "anchor_modifier_count", "mapping_scope_unknown_count", "rejected_interpretations", "avg_gold_per_row", "accounting_valid")


@R.add("A21_distributions", with_views(ARTIFACTS + """, v AS (SELECT domain, 'source_type' AS field, source_type AS value FROM g UNION ALL SELECT domain, 'label_type', source FROM g UNION ALL SELECT domain, 'mapping_source', mapping_source FROM g UNION ALL SELECT domain, 'mapping_scope', mapping_scope FROM g
UNION ALL SELECT domain, 'mapping_layer', 'generic' FROM g UNION ALL SELECT domain, 'novelty', CASE WHEN novel THEN 'novel' ELSE 'known' END FROM a UNION ALL SELECT domain, 'hardness', 'H0' FROM a) SELECT domain, field, value, count(*) AS n FROM v GROUP BY 1, 2, 3"""))
def a21_distributions(spark, d):
    return O.distributions(artifacts(spark, d), "domain")


GATE = (
    REPORT
    + """, lg AS (SELECT domain, count(*) AS groups FROM (SELECT domain FROM a GROUP BY domain, product_id HAVING count(DISTINCT split) > 1) GROUP BY 1), lt AS (SELECT domain, count(*) AS texts FROM (SELECT domain FROM a GROUP BY domain, lower(trim(text, ' ')) HAVING count(DISTINCT split) > 1) GROUP BY 1),
f AS (SELECT report.*, CASE WHEN groups > 0 THEN 'grouped_leakage' WHEN texts > 0 THEN 'exact_text_leakage' WHEN exact_rate < 1 THEN 'evidence_mismatch' END AS fatal FROM report LEFT JOIN lg USING (domain) LEFT JOIN lt USING (domain)),
r AS (SELECT domain, 'research_default' AS profile, fatal, NULL AS alone, [CASE WHEN unknown_rate > 0 THEN 'unknown_canonicals' END, CASE WHEN scopeless > 0 THEN 'mapping_scope_unknown' END, CASE WHEN provisional_rate > 0.7 THEN 'provisional_rate' END, CASE WHEN full_rate > 0.3 THEN 'full_review_evidence_rate' END, CASE WHEN novelty_rate > 0.8 THEN 'novelty_rate' END, CASE WHEN provenance_rate > 0.1 THEN 'unknown_provenance' END] AS bad,
 [CASE WHEN provisional_rate > 0.5 AND provisional_rate <= 0.7 THEN 'provisional_rate' END, CASE WHEN full_rate > 0.15 AND full_rate <= 0.3 THEN 'full_review_evidence_rate' END, CASE WHEN modifiers = 0 THEN 'no_anchor_modifier' END, CASE WHEN term_rate < 0.85 THEN 'matched_term_rate' END] AS soft FROM f
 UNION ALL SELECT domain, 'diagnostic_strict', fatal, CASE WHEN unknown_rate > 0 THEN 'unknown_canonicals' WHEN novelty_rate > 0.5 THEN 'novelty_rate' WHEN provenance_rate > 0 THEN 'unknown_provenance' END, [CASE WHEN scopeless > 0 THEN 'mapping_scope_unknown' END, CASE WHEN provisional_rate > 0.25 THEN 'provisional_rate' END, CASE WHEN modifiers = 0 THEN 'no_anchor_modifier' END, CASE WHEN full_rate > 0.05 THEN 'full_review_evidence_rate' END],
 [CASE WHEN term_rate < 0.95 THEN 'matched_term_rate' END] FROM f),
w AS (SELECT domain, profile, fatal, coalesce(fatal, alone) AS stopped, CASE WHEN coalesce(fatal, alone) IS NOT NULL THEN coalesce(fatal, alone) ELSE array_to_string(list_filter(bad, lambda x: x IS NOT NULL), ',') END AS failures, array_to_string(list_filter(soft, lambda x: x IS NOT NULL), ',') AS soft FROM r)
SELECT domain, profile, CASE WHEN fatal IS NOT NULL THEN 'FATAL' WHEN failures <> '' THEN 'FAIL' ELSE 'PASS' END AS status, failures, CASE WHEN stopped IS NULL THEN soft ELSE '' END AS warnings FROM w"""
)


@R.add("X09_gate_profiles", with_views(GATE))
def x09(spark, d):
    """Both profiles' verdict on each domain's artifact."""
    own = artifacts(spark, d)
    report, leaks = O.quality_report(own, "domain"), O.leakage(own, "domain")
    both = O.release_gate(report, leaks, "domain").unionByName(O.release_gate(report, leaks, "domain", O.STRICT))
    return both.withColumn("failures", F.array_join("failures", ",")).withColumn("warnings", F.array_join("warnings", ","))
