from pyspark.sql import functions as F

from revlume.operators import graphs as G
from revlume.operators import records as R
from revlume.operators import vectors as V


def arr(*words):
    return F.array(*(F.lit(w) for w in words))


def test_explicit_gate(spark):
    df = spark.createDataFrame([("thing",), ("battery life",), ("price tag",), ("menu card",), ("hinge",), (" ",)], "label string")
    gate = R.explicit_gate(F.col("label"), arr("thing"), arr("battery"), arr("price"), arr("menu"))
    got = [(r["accepted"], r["score"], r["reason"]) for r in df.select(gate.alias("g")).select("g.*").collect()]
    assert got == [(False, 0.0, "low_quality_aspect"), (True, 0.92, "domain"), (True, 0.86, "generic"), (False, 0.0, "domain_mismatch"), (True, 0.72, "open_world"), (False, 0.0, "low_quality_aspect")]


def test_routing_of_predictions(spark):
    rows = [(1, [("a", "known", 0.9, []), ("b", "boundary", 0.4, []), ("c", "novel", 0.5, [("x", 0.9), ("x", 0.9)]), ("d", "novel", 0.5, [])])]
    df = spark.createDataFrame(rows, "id int, predictions array<struct<aspect:string,routing:string,confidence:double,novel_candidates:array<struct<aspect:string,novelty_score:double>>>>")
    accepted, abstained, novel = R.route_predictions(df)
    assert [r["aspect"] for r in accepted.collect()] == ["a"] and [r["aspect"] for r in abstained.collect()] == ["b"]
    assert sorted(r["aspect"] for r in novel.collect()) == ["d", "x"]


def test_overlaps_and_fragments(spark):
    items = [(0.9, 1, 0, 10, "battery"), (0.8, 1, 5, 12, "battery"), (0.7, 1, 5, 12, "screen"), (0.6, 1, 10, 14, "battery")]
    df = spark.createDataFrame([(items,)], "items array<struct<confidence:double,rank:int,start:int,stop:int,canonical:string>>")
    kept = df.select(R.suppress_overlaps(F.col("items")).alias("k")).first()["k"]
    assert [(x["canonical"], x["start"]) for x in kept] == [("battery", 0), ("screen", 5), ("battery", 10)]
    rows = spark.createDataFrame([("e", "battery", 0.9), ("e", "battery life", 0.5), ("e", "screen", 0.4)], "evidence string, canonical string, confidence double")
    assert sorted(r["canonical"] for r in R.collapse_fragments(rows, ["evidence"]).collect()) == ["battery life", "screen"]


def test_row_scores(spark):
    df = spark.createDataFrame([([(0.9, "novel")],), ([(0.65, "novel"), (0.7, "known")],), ([(0.2, "novel")],), ([],), ([(0.7, "known")],)], "items array<struct<confidence:double,status:string>>")
    assert [r[0] for r in df.select(R.row_novelty(F.col("items"))).collect()] == ["novel", "boundary", "boundary", "known", "known"]
    two = spark.createDataFrame([([("a", "s1", "positive", 0.9), ("b", "s2", "unknown", 0.3)],)], "items array<struct<canonical:string,source:string,sentiment:string,confidence:double>>")
    assert abs(two.select(R.ambiguity(F.col("items"))).first()[0] - 0.48) < 1e-9
    assert two.select(R.hardness(F.col("items"), F.lit(0.8), F.lit("novel"))).first()[0] == "H3" and two.select(R.hardness(F.col("items"), F.lit(0.2), F.lit("novel"))).first()[0] == "H2"
    assert spark.range(1).select(R.quality_weight(F.lit(0.9), F.lit(1.0), F.lit("H3"))).first()[0] == 0.9 * 1.3


def test_ordered_dictionaries_and_fuzzy(spark):
    items = spark.createDataFrame([("laptop", "battery", "weak"), ("laptop", "speaker", "loud"), ("cafe", "x", "y")], "domain string, anchor string, modifier string")
    both = spark.createDataFrame([("laptop", "battery", "weak", "battery_life")], "domain string, anchor string, modifier string, canonical string")
    anchor = spark.createDataFrame([("laptop", "speaker", "audio"), ("laptop", "battery", "power")], "domain string, anchor string, canonical string")
    out = R.map_by_steps(items, [("anchor_modifier", 0.85, both, ["domain", "anchor", "modifier"]), ("anchor", 0.8, anchor, ["domain", "anchor"])])
    assert {r["anchor"]: (r["canonical"], r["layer"], r["confidence"]) for r in out.collect()} == {"battery": ("battery_life", "anchor_modifier", 0.85), "speaker": ("audio", "anchor", 0.8), "x": (None, "unmapped", 0.0)}


def test_sets_actions_bigrams(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, [], ["a"])], "id int, predicted array<string>, gold array<string>")
    assert {r["id"]: (r["precision"], r["recall"]) for r in R.set_scores(df).collect()} == {1: (0.5, 1.0), 2: (0.0, 0.0)}
    acts = spark.createDataFrame([(["a", "b", "c"], [("drop", 1)]), (["a", "b"], None)], "items array<string>, actions array<struct<action:string,index:int>>")
    assert [r[0] for r in acts.select(R.verify_actions(F.col("items"), F.col("actions"))).collect()] == [["a", "c"], ["a", "b"]]
    t = spark.createDataFrame([(1, "big screen and big screen, good"), (2, "one")], "id int, text string")
    assert R.top_bigrams(t, 1).collect()[0]["bigram"] == "big screen"


def test_graph_parts(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 3), ("x", "y", 2), ("c", "x", 1)], "a string, b string, weight int")
    assert {r["node"]: r["root"] for r in G.components(edges.where("weight > 1")).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert sorted(tuple(r) for r in G.communities(edges).collect()) == [(1, 3, "a"), (1, 3, "b"), (1, 3, "c"), (2, 2, "x"), (2, 2, "y")]
    assert abs(sum(r["rank"] for r in G.pagerank(edges).collect()) - 1) < 1e-9


def test_components_follow_a_long_chain(spark):
    chain = spark.range(0, 300).select(F.format_string("%04d", "id").alias("a"), F.format_string("%04d", F.col("id") + 1).alias("b"))
    assert {r["root"] for r in G.components(chain).select("root").distinct().collect()} == {"0000"}


def test_auroc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, False), (2, True), (2, False), (3, True)], "s int, y boolean")
    assert V.auroc(df, "s", "y").first()[0] == 0.875
