"""The release gate by hand-made artifacts: each rule, in both profiles, and the order in which they stop."""


from revlume.operators import release as O

GOLD = "struct<source_type:string,label_type:string,mapping_source:string,mapping_scope:string,mapping_layers:array<string>,aspect_canonical:string,evidence_text:string,evidence_span:array<int>,matched_terms:array<string>,quality_flags:array<string>>"
SCHEMA = f"artifact string, split string, group_id string, review_text string, novelty_status string, hardness_tier string, gold array<{GOLD}>"


def gold(**changed):
    own = dict(source_type="explicit", label_type="explicit", mapping_source="anchor_modifier", mapping_scope="generic", mapping_layers=["generic"], aspect_canonical="battery", evidence_text="battery", evidence_span=[4, 11], matched_terms=["Battery"], quality_flags=[])
    return own | changed


def artifact(name, *interpretations, **changed):
    """Three rows in three splits, of which each has the interpretations given."""
    given = list(interpretations) or [gold()]
    rows = []
    for i, split in enumerate(("train", "val", "test")):
        own = dict(artifact=name, split=split, group_id=f"g{i}", review_text=f"The battery is weak {i}", novelty_status="known", hardness_tier="H0", gold=given) | changed
        rows.append(own)
    return rows


def verdicts(spark, rows, accounting=None, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    found = O.release_gate(O.quality_report(df, "artifact", accounting), O.leakage(df, "artifact"), "artifact", **how)
    return {r["artifact"]: (r["status"], r["failures"], r["warnings"]) for r in found.collect()}


def test_both_profiles(spark):
    odd = dict(source_type="implicit_learned", label_type="implicit")
    rows = (
        artifact("fine") + artifact("groups", group_id="g") + artifact("texts", review_text=" The battery is WEAK 0 ") + artifact("span", gold(evidence_text="not there")) + artifact("no spans", gold(evidence_span=None)) + artifact("source", gold(source_type=""))
        + artifact("unknown", gold(), gold(aspect_canonical="unknown")) + artifact("scope", gold(mapping_scope=None)) + artifact("provisional", gold(mapping_source="provisional")) + artifact("half", gold(), gold(), gold(mapping_source="provisional"), gold(mapping_source="provisional"), gold(mapping_source="provisional"))
        + artifact("novel", novelty_status="novel") + artifact("nameless", gold(mapping_source=None)) + artifact("terms", gold(matched_terms=["screen", " "])) + artifact("no terms", gold(matched_terms=None)) + artifact("learned", gold(**odd)) + artifact("null gold", gold=None)
        + [dict(r, gold=[gold(evidence_text=r["review_text"], evidence_span=[0, 21])]) for r in artifact("whole")]
    )
    research, strict = verdicts(spark, rows), verdicts(spark, rows, profile=O.STRICT)
    for name, why in {"groups": "grouped_leakage", "texts": "exact_text_leakage", "span": "evidence_mismatch", "no spans": "evidence_mismatch", "source": "invalid_source_type", "null gold": "evidence_mismatch"}.items():
        assert research[name] == strict[name] == ("FATAL", [why], []), name
    assert research["fine"] == strict["fine"] == ("PASS", [], [])
    assert research["unknown"] == strict["unknown"] == ("FAIL", ["unknown_canonicals"], [])
    assert research["scope"] == strict["scope"] == ("FAIL", ["mapping_scope_unknown"], [])
    assert research["provisional"] == ("FAIL", ["provisional_rate"], ["no_anchor_modifier"])
    assert strict["provisional"] == ("FAIL", ["provisional_rate", "no_anchor_modifier"], [])
    assert research["half"] == ("PASS", [], ["provisional_rate"])
    assert research["novel"] == strict["novel"] == ("FAIL", ["novelty_rate"], [])
    assert research["nameless"] == ("FAIL", ["unknown_provenance"], ["no_anchor_modifier"])
    assert strict["nameless"] == ("FAIL", ["unknown_provenance"], [])
    assert research["terms"] == strict["terms"] == research["no terms"] == ("PASS", [], ["matched_term_rate"])
    assert research["whole"] == strict["whole"] == ("FAIL", ["full_review_evidence_rate"], [])
    learned = verdicts(spark, rows, require_learned=True)
    assert learned["learned"][0] == "PASS" and learned["fine"] == ("FAIL", ["no_implicit_learned"], [])


def test_accounting(spark):
    rows = artifact("even") + artifact("off") + artifact("silent") + artifact("flagged", gold(quality_flags=["llm_drop", "other"])) + artifact("said")
    told = spark.createDataFrame([("even", 3, 0, 0, 0), ("off", 9, 5, 0, 0), ("silent", 9, 6, 0, 0), ("flagged", 9, 5, 1, 0), ("said", 9, 6, 0, 2)], "artifact string, loaded_rows long, rejected_rows long, discarded_rows long, runtime_reasons long")
    research, strict = verdicts(spark, rows, told), verdicts(spark, rows, told, profile=O.STRICT)
    assert research["off"] == strict["off"] == ("FATAL", ["accounting_mismatch"], [])
    assert research["silent"] == ("PASS", [], ["rejected_without_reason"]) and strict["silent"] == ("FAIL", ["rejected_without_reason"], [])
    assert all(research[k] == strict[k] == ("PASS", [], []) for k in ("even", "flagged", "said"))


def test_report_of_odd_rows(spark):
    """No rows: no report. A row of nulls counts as a row; spans of nulls or beyond the text are not exact."""
    empty = spark.createDataFrame([], SCHEMA)
    assert O.quality_report(empty, "artifact").count() == O.leakage(empty, "artifact").count() == O.distributions(empty, "artifact").count() == 0
    nulls = {k: None for k in gold()}
    rows = [dict.fromkeys(("split", "group_id", "review_text", "novelty_status", "hardness_tier", "gold")) | {"artifact": "a"}, artifact("a", nulls, gold(evidence_span=[None, 4]), gold(evidence_span=[90, 99]), gold(evidence_text="", evidence_span=[9, 2]))[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    r = O.quality_report(df, "artifact").first()
    assert (r["total_exported"], r["total_gold"], r["max_gold"], r["spans"], r["exact_spans"], r["invalid_source_types"]) == (2, 4, 4, 3, 1, 1)
    assert {(x["field"], x["value"]): x["n"] for x in O.distributions(df, "artifact").collect()} == {
        ("novelty", "known"): 2, ("hardness", "H0"): 2, ("source_type", "explicit"): 3, ("source_type", "unknown"): 1, ("label_type", "explicit"): 3, ("label_type", "unknown"): 1, ("mapping_source", "anchor_modifier"): 3, ("mapping_source", "none"): 1, ("mapping_scope", "generic"): 3, ("mapping_scope", "unknown"): 1, ("mapping_layer", "generic"): 3}
