import json
import os

import pytest
from pyspark.sql import functions as F

from revlume.operators import flow as W
from revlume.operators import graphs as G
from revlume.operators import lines as N
from revlume.operators import published as P

FORMS = [
    ('"speed": "positive"\n"crashes": "NEG"', [("speed", "positive"), ("crashes", "negative")]),
    ('{"battery life": "great", "Battery Life": "pos"}', [("battery life", "positive")]),
    ("battery: positive, heating : negative, price: so so", [("battery", "positive"), ("heating", "negative")]),
    ("battery: positive\nheating: negative", [("battery", "positive"), ("heating", "negative")]),
    ("1) • screen  size | good\r\n* fan noise - terrible!\n\nno pair here\n- lid: mixed", [("screen size", "positive"), ("fan noise", "negative"), ("lid", "neutral")]),
    ('{"pairs": [{"aspect": "hinge", "sentiment": "unsure"}]}', []),
    ('{"pairs": [{"aspect": "hinge", "sentiment": "positive"}]}', [("sentiment", "positive")]),
    ('{"pairs": []}', []),
    ("the | good\nphone | bad\nof the | good\none two three four five six seven eight nine | bad\nphone case | bad", [("phone case", "negative")]),
    ("x" * 300 + " | good", [("x" * 255, "positive")]),
    ("", []),
    (None, []),
    ("   ", []),
]


def test_generated_lines_of_every_form(spark):
    rows = [(i, text, "clash") for i, (text, _) in enumerate(FORMS)]
    got = {}
    for r in sorted(N.parsed(spark.createDataFrame(rows, "id int, text string, place string"), "id").collect(), key=lambda r: (r["id"], r["place"])):
        got.setdefault(r["id"], []).append((r["aspect"], r["sentiment"]))
    assert got == {i: pairs for i, (_, pairs) in enumerate(FORMS) if pairs}
    assert N.parsed(spark.createDataFrame([], "id int, text string"), "id").count() == 0


CLAUSES = f"review_id int, place int, span {W.SPAN}, decision string, confidence double, ambiguity_score double, novelty_score double, accepted array<struct<aspect:string,sentiment:string,confidence:double,raw_score:double,routing:string>>, novel array<struct<aspect:string,novelty_score:double>>"
COLUMNS = "review_id", "aspect", "sentiment", "confidence", "routing"


def clause(review, place, decision, accepted=(), novel=()):
    return (review, place, (0, 5, f"part {place}"), decision, 0.5, 0.2, 0.3, [(a, s, c, c, r) for a, s, c, r in accepted], [tuple(n) for n in novel])


def test_predictions_of_clauses(spark):
    rows = [
        clause(1, 0, "single_label", [("battery", "Positive", 0.8, None), (" ", "positive", 0.9, "known")], [("sparks", 0.9)]),
        clause(1, 1, None, [("battery", "negative", 0.8, "known"), ("lid", None, 0.4, "known")]),
        clause(1, 2, "abstain", [("fan", "negative", 0.3, "known")]),
        *(clause(2, i, "Abstain", [] if i == 1 else [(f"a{i}", "neutral", 0.1, "known")], [("never", 0.9)]) for i in range(4)),
        clause(3, 0, "single_label", [], [("lost", 0.9)]),
        (4, 0, None, None, None, None, None, None, None),
    ]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in W.predict(spark.createDataFrame(rows, CLAUSES), top_k=2).na.fill(-1.0).collect())
    assert got == [
        (1, "battery", "positive", 0.8, "known"), (1, "fan", "negative", 0.5, "boundary"), (1, "lid", "neutral", 0.4, "known"), (1, "sparks", "neutral", -1.0, "novel"),
        (2, "", "neutral", 0.5, "boundary"), (2, "a0", "neutral", 0.5, "boundary"),
    ]
    assert W.predict(spark.createDataFrame([], CLAUSES)).count() == 0


def test_only_known_implicit_predictions_are_merged(spark):
    explicit = spark.createDataFrame([(1, 0, "screen", "positive", 0.91, None), (1, 1, "Screens", "positive", 0.91, None), (1, 2, "lid", "negative", 0.5, None), (1, 3, " ", None, None, None)], f"review_id int, place int, aspect string, sentiment string, confidence double, span {W.SPAN}")
    rows = [
        clause(1, 0, "single_label", [("battery_life", "negative", 0.7, "known"), ("hinge_sparks", "negative", 0.6, "novel"), ("screen", "positive", 0.91, "known"), ("lid", "negative", 0.52, "known"), ("weather", "neutral", 0.9, "known")]),
        clause(1, 1, "abstain", [("fan", "negative", 0.3, "known")]),
    ]
    tables = W.hybrid(explicit, W.predict(spark.createDataFrame(rows, CLAUSES)), F.col("aspect") != "weather")
    won = {r["aspect_normalized"]: (r["aspect"], r["source"], r["confidence"]) for r in tables["predictions"].collect()}
    assert won == {"screen": ("screen", "explicit", 0.91), "battery life": ("battery_life", "implicit", 0.7), "lid": ("lid", "implicit", 0.52)}
    assert [r["aspect"] for r in tables["novel"].collect()] == ["hinge_sparks"]
    assert sorted((r["aspect"], r["reason"]) for r in tables["abstained"].collect()) == [("fan", "low_selective_confidence"), ("weather", "domain_mismatch")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key int, value string")


def held(spark, root, name="a"):
    return sorted(tuple(r) for r in P.read(spark, root, name).collect())


def test_tables_are_replaced_by_key_and_published_together(spark, tmp_path):
    root = str(tmp_path / "t")
    first = [(k, v) for k in range(40) for v in "xy"]
    keys = frame(spark, first)
    assert P.replace(keys, "key", root, 3, {"a": keys, "b": frame(spark, [(1, "old")])}, buckets=8)
    assert held(spark, root) == sorted(first)
    # one key: its old rows go, and only its bucket is written anew
    one = frame(spark, [(1, "new"), (1, None), (1, None)])
    assert P.replace(one, "key", root, 4, {"a": one.where("value is not null"), "b": one.limit(0)})
    assert held(spark, root) == sorted([r for r in first if r[0] != 1] + [(1, "new")]) and held(spark, root, "b") == []
    state = P.states(spark, root)[-1]
    assert sorted(state["tables"]["a"]["at"].values()).count(4) == 1 and len(os.listdir(tmp_path / "t" / "a" / "n=4")) < 4
    # a replay changes nothing, nor does an older number
    assert not P.replace(one, "key", root, 4, {"a": one.limit(0)}) and not P.replace(one, "key", root, 2, {"a": one.limit(0)})
    assert (1, "new") in held(spark, root)


def test_an_unpublished_attempt_is_not_seen_and_old_states_go(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    rows = frame(spark, [(k, "v0") for k in range(20)])
    P.replace(rows, "key", root, 0, {"a": rows}, buckets=4)
    before = held(spark, root)

    def lost(*_):
        raise OSError("lost before the publication")

    later = rows.withColumn("value", F.lit("v1"))
    with monkeypatch.context() as m:
        m.setattr(P, "_publish", lost)
        with pytest.raises(OSError):
            P.replace(rows, "key", root, 1, {"a": later})
    assert held(spark, root) == before
    for n in (1, 2, 3):
        P.replace(rows, "key", root, n, {"a": rows.withColumn("value", F.lit(f"v{n}"))})
    assert {v for _, v in held(spark, root)} == {"v3"}
    assert [s["number"] for s in P.states(spark, root)] == [2, 3]
    files = [f for at, _, fs in os.walk(tmp_path / "t" / "a" / "n=0") for f in fs if f.endswith(".parquet")]
    assert not files and json.loads(json.dumps(P.states(spark, root)[0]))["tables"]["a"]["schema"]


def test_an_empty_first_batch_gives_an_empty_table(spark, tmp_path):
    root = str(tmp_path / "t")
    none = frame(spark, [])
    assert P.replace(none, "key", root, 0, {"a": none}) and held(spark, root) == []


def test_the_graph_of_a_scope_is_built_anew_and_others_stay(spark, tmp_path):
    root = str(tmp_path / "g")
    rows = spark.createDataFrame([(1, "lid"), (1, "fan"), (2, "lid"), (2, "fan noise"), (3, "hue")], "review_id int, aspect_raw string")
    alike = spark.createDataFrame([("fan", "fan noise")], "a string, b string")
    reviews = spark.range(4).withColumnRenamed("id", "review_id")
    graph = lambda: (sorted(tuple(r) for r in P.read(spark, root, "nodes").drop("idf", "rank").collect()), sorted(tuple(r) for r in P.read(spark, root, "edges").collect()))
    assert G.publish(rows, alike, reviews, "x", root, 0)
    first = graph()
    assert first == ([("x", "fan", 2, 2), ("x", "hue", 1, 1), ("x", "lid", 2, 2)], [("x", "fan", "lid", 2)])
    ranks = {r["cluster"]: r["rank"] for r in P.read(spark, root, "nodes").collect()}
    assert ranks["hue"] is None and abs(ranks["fan"] + ranks["lid"] - 1) < 1e-9
    assert G.publish(rows.where("review_id = 1"), alike, reviews, "y", root, 1) and G.publish(rows, alike, reviews, "x", root, 2)
    both = graph()
    assert [r for r in both[0] if r[0] == "x"] == first[0] and [r for r in both[1] if r[0] == "x"] == first[1] and ("y", "fan", "lid", 1) in both[1]
    assert not G.publish(rows.limit(0), alike, reviews, "x", root, 2) and graph() == both
    assert G.publish(rows.limit(0), alike, reviews, "x", root, 3) and {r[0] for part in graph() for r in part} == {"y"}
