"""Readers and writers of review files: CSV, JSON lines, benchmark artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlume.operators import etl as E

SPLITS = ("train", "val", "test")
INTERPRETATION = "aspect_raw string, aspect_canonical string, sentiment string, label_type string, source_type string, evidence_text string, evidence_span array<int>, canonical_confidence double, hardness_tier string"
BENCHMARK = f"review_id string, group_id string, domain string, review_text string, novelty_status string, abstain_acceptable boolean, hardness_tier string, gold_interpretations array<struct<{', '.join(f'{a.split()[0]}:{a.split()[1]}' for a in INTERPRETATION.split(', '))}>>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quoted fields may span lines; a byte order mark is no part of the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", inferSchema=False)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line, blank lines skipped; a line that is no object stops the job."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_any(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV and JSON line files as one table; a column that a file lacks is null."""
    out = None
    for path in sorted(paths):
        df = read_csv(spark, path) if path.lower().endswith(".csv") else read_jsonl(spark, path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def text_column(columns: list[str]) -> str:
    """The column that holds the reviews: by name in any case, else the first."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[c] for c in ("reviews", "review", "text", "content", "sentence", "comment") if c in low), columns[0])


def read_csv_upload(spark: SparkSession, path: str, most_rows: int = 20_000) -> DataFrame:
    """A user's file, with a column of broken lines instead of a failure; more rows than allowed are an error, not a cut."""
    head = spark.read.csv(path, header=True, mode="PERMISSIVE")
    schema = T.StructType([*head.schema.fields, T.StructField("_broken", T.StringType())])
    # a line is judged whole, whatever columns a query reads
    df = spark.read.schema(schema).option("columnPruning", "false").csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    if df.select(df.columns[0]).limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return df


def read_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """The three splits of an artifact, with their name; broken lines stop the job."""
    out = None
    for split in SPLITS:
        df = read_jsonl(spark, f"{folder}/{split}.jsonl", BENCHMARK).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def examples(rows: DataFrame) -> DataFrame:
    """One example for each gold interpretation, with its row's fields, a number from 1 and the row's joint labels."""
    joint = F.transform("gold_interpretations", lambda g: F.concat_ws("__", g["aspect_canonical"], g["sentiment"]))
    flat = rows.withColumn("gold_joint_labels", joint).select("*", F.posexplode("gold_interpretations").alias("pos", "gold")).drop("gold_interpretations")
    return flat.select(
        F.concat("review_id", F.lit("_g"), F.col("pos") + 1).alias("example_id"), *(c for c in rows.columns if c not in ("gold_interpretations", "hardness_tier")),
        F.coalesce("gold.hardness_tier", "hardness_tier").alias("hardness_tier"), "gold.aspect_raw", "gold.aspect_canonical", "gold.sentiment", "gold.source_type", "gold.evidence_text", "gold.evidence_span",
        (F.col("novelty_status") == "novel").alias("novel_acceptable"), "gold_joint_labels",
    )


def write_splits(rows: DataFrame, folder: str) -> dict[str, int]:
    """JSON lines by split; the rows of each and of all."""
    rows.write.partitionBy("split").mode("overwrite").json(folder)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}  # a row for each split
    return counts | {"total": sum(counts.values())}


def ingest(spark: SparkSession, paths: list[str], source: str) -> DataFrame:
    """Files to normalized reviews."""
    raw = read_any(spark, paths)
    if "aspects" in raw.columns:
        raw = E.flatten_aspects(raw)
    return E.normalize_reviews(raw, source)
