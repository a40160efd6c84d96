import json
import random

import pytest
from pyspark.sql import functions as F

from revlume.functions import text as X
from revlume.operators import analytics as A
from revlume.operators import etl as E
from revlume.operators import published
from revlume.sources import files
from revlume.streaming import changes

SF = "/root/testdata/sf0.001"


def test_csv_and_jsonl_become_reviews(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿review_id,product_id,text\n1,p1,"two\nlines  here"\n2,p2,"says ""hi"""\n'.encode())
    (tmp_path / "b.jsonl").write_text('{"group_id": "g", "text": " spaced  out ", "domain": "Home & Garden"}\n\n{"group_id": "g2", "review": "other"}\n')
    rows = {r["text"]: r for r in files.ingest(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.jsonl")], "shop").collect()}
    assert set(rows) == {"two lines here", 'says "hi"', "spaced out", "other"}
    assert rows["spaced out"]["domain"] == "home_garden" and rows["spaced out"]["review_id"].startswith("r_") and rows["other"]["domain"] == "shop"


def test_missing_group_is_an_error(spark):
    with pytest.raises(Exception, match="no group id"):
        E.normalize_reviews(spark.createDataFrame([("x", None)], "text string, group_id string"), "s").collect()


def test_nested_aspects_are_flattened_and_empty_ones_kept(spark):
    df = spark.createDataFrame([("1", "t", [("battery", "positive"), ("screen", None)]), ("2", "u", [])], "id string, text string, aspects array<struct<term:string,polarity:string>>")
    assert sorted((r["id"], r["term"] or "") for r in E.flatten_aspects(df).collect()) == [("1", "battery"), ("1", "screen"), ("2", "")]


def test_broken_json_stops(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n[1\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_upload_keeps_broken_lines_and_refuses_too_many(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,Review\n1,good\n2,bad,extra\n")
    df = files.read_csv_upload(spark, str(tmp_path / "u.csv"))
    assert files.text_column(df.columns) == "Review" and df.count() == 2
    with pytest.raises(ValueError):
        files.read_csv_upload(spark, str(tmp_path / "u.csv"), 1)


def test_benchmark_examples(spark, tmp_path):
    row = {"review_id": "r1", "group_id": "g", "domain": "d", "review_text": "The battery died", "novelty_status": "novel", "abstain_acceptable": True, "hardness_tier": "H3", "gold_interpretations": [{"aspect_canonical": "battery", "sentiment": "negative", "source_type": "explicit"}, {"aspect_canonical": "power", "sentiment": "neutral"}]}
    for s in files.SPLITS:
        (tmp_path / f"{s}.jsonl").write_text(json.dumps(row) + "\n" if s == "train" else "")
    out = files.examples(files.read_benchmark(spark, str(tmp_path))).orderBy("example_id").collect()
    assert [r["example_id"] for r in out] == ["r1_g1", "r1_g2"] and out[0]["gold_joint_labels"] == ["battery__negative", "power__neutral"]
    assert out[0]["novel_acceptable"] and out[0]["abstain_acceptable"] and out[0]["hardness_tier"] == "H3"


def test_write_splits_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "id int, split string")
    assert files.write_splits(df, str(tmp_path / "out")) == {"train": 2, "test": 1, "total": 3}
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_sentences_with_places(spark):
    text = "Good food. But  slow! Why?"
    spans = spark.createDataFrame([(text,)], "t string").select(X.sentence_spans(F.col("t")).alias("s")).first()["s"]
    assert [text[x["start"] : x["stop"]] for x in spans] == [x["sentence"] for x in spans] == ["Good food.", "But  slow!", "Why?"]


def test_canonical_labels(spark):
    row = spark.range(1).select(X.normalize(F.lit("Food_quality")).alias("a"), X.aspect_label(F.lit("battery-lives")).alias("b"), X.canonical_aspect(F.lit(""), F.lit(None).cast("string"), F.lit("Prices"), F.lit("x")).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("food", "Battery Live", "Price")


def test_wilson_bounds(spark):
    low, high = spark.range(1).select(A.wilson(F.lit(0.5), F.lit(10.0), False), A.wilson(F.lit(0.5), F.lit(10.0), True)).first()
    assert abs(low - 0.2366) < 1e-3 and abs(high - 0.7634) < 1e-3


def test_product_cache_by_stream_equals_batch(spark, tmp_path):
    deltas = [(1, 4, 1, 2), (1, 2, 1, 0), (2, 5, 1, 1), (1, -4, -1, -2)]
    schema = "product_id long, rating_delta long, review_delta long, helpful_delta long"
    for i, d in enumerate(deltas):
        spark.createDataFrame([d], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = changes.maintain_product_cache(changes.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), str(tmp_path / "cache"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = {r["product_id"]: (r["avg_rating"], r["review_count"], r["helpful_count"]) for r in published.read(spark, str(tmp_path / "cache"), "cache").collect()}
    assert got == {1: (2.0, 1, 0), 2: (5.0, 1, 1)}


def test_streamed_windows(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", i % 2, "view", 1.0) for i in range(9)] + [(99, "2024-01-03 00:00:00", 1, "end", 0.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = changes.stream(spark, str(tmp_path / "ev"), events.schema)
    q = changes.run_once(changes.windowed_counts(live), "windows_once", str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("windows_once").where("event_type = 'view'").collect()) in (0, 9)


def test_streamed_memory_equals_batch_after_shuffles_and_a_restart(spark, tmp_path):
    rng = random.Random(6)
    cues = ["failure_event", "unknown", "", None]
    names = ["Battery", "battery ", "screen size", "thing", "", None, "hinge", "fit of lid"]
    rows = [(rng.choice(names), rng.randint(1, 8), rng.choice("de"), rng.choice(["a", "A ", "b", "c"]), rng.choice(cues), seq) for seq in range(160)]
    schema = "aspect_raw string, review_id long, domain string, context string, cue_type string, seq long"
    wanted = sorted(map(str, map(tuple, E.memory(spark.createDataFrame(rows, schema)).collect())))
    rng.shuffle(rows)
    source, last = str(tmp_path / "m"), {}
    for part in (rows[:70], rows[70:]):  # the second run goes on from the first one's state
        for at in range(0, len(part), 30):
            spark.createDataFrame(part[at : at + 30], schema).coalesce(1).write.mode("append").parquet(source)
        seen = []
        live = changes.aspect_memory(changes.stream(spark, source, spark.createDataFrame([], schema).schema))
        writer = live.writeStream.outputMode("update").foreachBatch(lambda batch, _, seen=seen: seen.extend(batch.collect()))
        writer.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
        last.update({r["aspect"]: tuple(r) for r in sorted(seen, key=lambda r: r["support"])})
    assert sorted(map(str, last.values())) == wanted
