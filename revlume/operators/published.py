"""Keyed tables that change together: a batch rewrites the buckets it touches and publishes all tables by one pointer.

Below a root folder lie ``<table>/n=<number>/published_bucket=<b>`` and ``_published/<number>.json``, which names for each
table the number under which each bucket was written last. A reader sees the tables of one such file and none in the making;
the file appears by a rename. A number that is published already does nothing when it comes again, so replays count once.
The tables of the last two numbers stay, older ones are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlume.plans.shared import delete, discard, materialize

BUCKET = "published_bucket"
#: Buckets of a new root, and the bound of what the driver holds of it.
BUCKETS = 64

Change = tuple[str, Callable[[DataFrame], DataFrame]]


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def states(spark: SparkSession, root: str) -> list[dict]:
    """The published states, oldest first."""
    files = [n for n in _names(spark, f"{root}/_published") if n.endswith(".json")]
    # each is one small line: bounded by tables and buckets
    return [json.loads(spark.read.text(f"{root}/_published/{n}", wholetext=True).first()[0]) for n in files]


def _publish(spark: SparkSession, root: str, state: dict) -> None:
    fs, draft = _fs(spark, f"{root}/_draft-{state['number']}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    _, final = _fs(spark, f"{root}/_published/{state['number']:012d}.json")
    fs.mkdirs(final.getParent())
    if not fs.rename(draft, final):
        raise RuntimeError(f"{final} could not be published")


def _places(root: str, state: dict, name: str, buckets=None) -> list[str]:
    held = state["tables"].get(name, {}).get("at", {})
    return [f"{root}/{name}/n={n}/{BUCKET}={b}" for b, n in held.items() if buckets is None or int(b) in buckets]


def _rows(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as it was published last."""
    state = states(spark, root)[-1]
    return _rows(spark, _places(root, state, name), state["tables"][name]["schema"])


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def change(keys: DataFrame, key: str, root: str, number: int, changes: dict[str, Change], buckets: int = BUCKETS) -> bool:
    """Publish ``number``: of each table (schema, function) the buckets of ``keys``, as the function makes them of what they held.

    The function returns rows whose keys lie in those buckets. Numbers rise; one that is not above the last gives False.
    """
    spark = keys.sparkSession
    known = states(spark, root)
    if known and known[-1]["number"] >= number:
        return False
    state = known[-1] if known else {"number": -1, "buckets": buckets, "tables": {}}
    own = bucket(key, state["buckets"])
    touched = {r[0] for r in keys.select(own.alias("b")).distinct().collect()}  # at most so many as there are buckets
    new = {"number": number, "buckets": state["buckets"], "tables": dict(state["tables"])}
    for name, (schema, after) in changes.items():
        rows = after(_rows(spark, _places(root, state, name, touched), schema))
        # files of one bucket lie together; adaptive execution splits a bucket that is too large for a task
        rows.withColumn(BUCKET, own).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/{name}/n={number}")
        held = {b: n for b, n in state["tables"].get(name, {}).get("at", {}).items() if int(b) not in touched}
        written = [x.split("=")[1] for x in _names(spark, f"{root}/{name}/n={number}") if x.startswith(f"{BUCKET}=")]
        new["tables"][name] = {"schema": schema, "at": held | {b: number for b in written}}
    _publish(spark, root, new)
    _forget(spark, root, [*known, new])
    return True


def _forget(spark: SparkSession, root: str, known: list[dict]) -> None:
    """Delete what only states before the last two name."""
    kept = {p for s in known[-2:] for name in s["tables"] for p in _places(root, s, name)}
    for old in known[:-2]:
        for name in old["tables"]:
            for path in _places(root, old, name):
                if path not in kept:
                    delete(spark, path)
        delete(spark, f"{root}/_published/{old['number']:012d}.json")


def replaced(keys: DataFrame, key: str, rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What a table holds with the rows of ``keys`` replaced by ``rows`` (of those keys alone). Keys may come several times."""
    gone = keys.select(key)
    return lambda before: before.join(gone, key, "left_anti").select(*rows.columns).unionByName(rows.join(gone, key, "left_semi"))


def replace(keys: DataFrame, key: str, root: str, number: int, tables: dict[str, DataFrame], buckets: int = BUCKETS) -> bool:
    """Publish the rows of ``tables`` in place of all that the tables hold of ``keys``; keys without new rows lose theirs."""
    known = states(keys.sparkSession, root)
    if known and known[-1]["number"] >= number:
        return False
    # found once, not for each table anew
    keys = materialize(keys.select(key).distinct(), "published-keys")
    ddl = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) for name, rows in tables.items()}
    try:
        return change(keys, key, root, number, {name: (ddl[name], replaced(keys, key, rows)) for name, rows in tables.items()}, buckets)
    finally:
        discard(keys)
