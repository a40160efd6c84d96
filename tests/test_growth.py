"""Steps that send little: the same results as plain ones, on rows that are odd."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlume import catalog
from revlume.functions import text as X
from revlume.operators import etl as E
from revlume.operators import flow as W
from revlume.operators import phrases as P
from revlume.operators import records as R
from revlume.operators import vectors as V
from revlume.plans import shared

TEXTS = [(1, "Big screen and BIG screen, good"), (None, "a b a b"), (2**60 + 1, "one"), (3, None), (4, "x y, z x y z"), (5, "")]


def bigrams(rows, n):
    out = set()
    for i in {i for i, _ in rows}:
        counts = Counter()
        for _, t in (r for r in rows if r[0] == i):
            found = "".join(c if "a" <= c <= "z" else " " for c in (t or "").lower()).split()
            counts.update(zip(found, found[1:]))
        out |= {(i, place, " ".join(pair), k) for place, (pair, k) in enumerate(counts.most_common(n), 1)}
    return out


@pytest.mark.parametrize("rows", [TEXTS, [*TEXTS, (4, "q q q q"), (None, "a b a")]])
def test_bigrams_of_odd_ids(spark, rows):
    texts = spark.createDataFrame(rows, "id long, text string")
    assert {tuple(r) for r in R.top_bigrams(texts, 2).collect()} == bigrams(rows, 2)


def test_bigrams_of_single_texts_send_no_pairs(spark):
    found = R.top_bigrams(spark.createDataFrame(TEXTS, "id long, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_lowered_once_for_all_words(spark):
    text = spark.range(1).select(F.lit("Good but SLOW and bad").alias("t"))
    plan = text.select(X.keyword_polarity(F.col("t")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") == 1


def vectors(n, width=8, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, width))
    x[n // 2 : n // 2 + 9] = x[0]  # equal cosines
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@pytest.mark.parametrize("both", [False, True])
def test_similar_pairs_of_brute_force_in_blocks_and_tiles(spark, monkeypatch, both):
    monkeypatch.setattr(V, "BLOCK", 70)
    monkeypatch.setattr(V, "SMALL_BLOCK", 40)
    x = vectors(300)
    cosine = np.round(x @ x.T, 9)
    wanted = set()
    for a in range(len(x)):
        near = [b for b in sorted(range(len(x)), key=lambda b: (-cosine[a, b], b)) if b != a and cosine[a, b] >= 0.4][:4]
        wanted |= {(min(a, b), max(a, b)) for b in near if both or a < b}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.round(x, 12))], "id long, v array<double>")
    found = V.similar_pairs(rows, 0.4, 4, both=both).collect()
    assert len(found) == len(wanted) and {(r["a"], r["b"]) for r in found} == wanted


def test_a_vector_is_sent_at_most_once_for_each_of_few_blocks():
    assert [V._block_count(n) for n in (0, 1, 2048, 2049, 20_000, 100_000, 524_288, 600_000)] == [1, 1, 1, 2, 10, 16, 16, 19]


def test_similar_labels_hold_pairs_that_either_names(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.436]), (3, [0.8, 0.6])], "id long, v array<double>")
    pairs = lambda **kw: {(r["a"], r["b"]) for r in V.similar_pairs(rows, 0.0, 1, **kw).collect()}
    assert pairs() == {(1, 2), (2, 3)} and pairs(both=True) == {(1, 2), (2, 3)}
    swapped = rows.select((4 - F.col("id")).alias("id"), "v").where("id > 0")
    assert {(r["a"], r["b"]) for r in V.similar_pairs(swapped, 0.0, 1).collect()} < {(r["a"], r["b"]) for r in V.similar_pairs(swapped, 0.0, 1, both=True).collect()}


def test_overall_sentiment_ranks_by_all_twenty_rounds():
    sql = catalog.ORACLE_SQL["A19_overall_sentiment"]
    assert "JOIN r20 ON" in sql and "moved" not in sql


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["W04_transitions", "W06_top_six_per_review", "A24_memory_summary", "X14_implicit_predictions"])
def test_tasks_of_a_review_step_hold_a_number_of_rows(spark, monkeypatch, name):
    wanted = sorted(map(str, catalog.QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    found = catalog.QUERIES[name](spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    parts = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    assert "hashpartitioning(review_id" in plan and f", {parts})" in plan
    assert sorted(map(str, found.collect())) == wanted


def test_few_rows_are_not_dealt(spark):
    rows = spark.range(10)
    assert shared.spread(rows, 10, "id") is rows


@pytest.mark.parametrize("cues", [("b", "a"), ("a", "b")])
def test_cues_of_one_place_count_by_name(spark, cues):
    rows = spark.createDataFrame([("lid", 1, "d", "c", cue, 5) for cue in cues], "aspect_raw string, review_id int, domain string, context string, cue_type string, seq int").coalesce(1)
    assert E.memory(rows).first()["cue"] == "b"


def test_matches_are_held_for_few_texts_at_a_time():
    pattern = {"pattern_id": "p", "phrase": "runs hot", "aspect_canonical": "heat", "latent_family": "f", "domain_scope": "global", "domains": None, "confidence": 0.5, "precision_estimate": 0.5}
    texts = pd.DataFrame({"id": range(300), "domain": None, "text": "it runs hot"})
    parts = list(P.found_in(P.Automaton([pattern]), iter([texts]), True))
    assert max(len(p) for p in parts) <= P.TEXTS and pd.concat(parts)["id"].tolist() == list(range(300))


def test_a_flow_makes_each_name_once(spark):
    columns = "review_id int, place int, aspect string, sentiment string, confidence double, span " + W.SPAN
    explicit = spark.createDataFrame([(1, 0, "Lids quality", "positive", 0.5, None), (1, 1, "lid", "positive", 0.4, None), (1, 2, None, "positive", 0.4, None)], columns)
    implicit = W.predict(spark.createDataFrame([], "review_id int, place int, span " + W.SPAN + ", decision string, confidence double, ambiguity_score double, novelty_score double, accepted array<struct<aspect:string,sentiment:string,confidence:double,raw_score:double,routing:string>>, novel array<struct<aspect:string,novelty_score:double>>"))
    found = W.hybrid(explicit, implicit, F.lit(True))["predictions"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("quality$") <= 2  # of explicit and implicit rows
    assert [(r["aspect_normalized"], r["aspect"]) for r in found.collect()] == [("lid", "Lids quality")]
