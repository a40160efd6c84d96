"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree parts a bounded sample at random hyperplanes (through the middle of
two of its vectors) until a leaf holds about LEAF of the sample. The forest is
fitted once, every vector is sent to its leaf in each tree and counted there. A
query walks all trees with one shared priority queue: the node whose hyperplane
is nearest to the query on its worse side comes next, until the leaves reached
hold VISIT of all places in the index (a vector has one in each tree). The
vectors of these leaves are the candidates; their cosines are computed in double
precision, leaf by leaf in tasks that hold a bounded number of vectors (CELL) and
queries (ASKED) each, and only a query's best ones leave a task.

VISIT is large because vectors without clusters (as in the test tables: cosines
of the nearest lie 3.7 deviations above the mean, and nothing else tells them
from the rest) have neighbours that a hyperplane parts nearly as often as any
two. Vectors in clusters need far less; VISIT is a parameter.

Equal vectors are indexed once, with the smallest of their ids, and equal
queries searched once, so a very common vector costs no more than another.

Sample: about SAMPLE distinct vectors, by a hash. Recall against brute force is
measured in the tests (at least 0.9).

Nulls and edges: null vectors, those with a null or non-finite component, zero
vectors and those of another length than most take no part, neither as query
nor as candidate; a query with fewer candidates found than asked for gets all of
them; ties go to the smaller id; rows with equal id are candidates each, but not
of a query of that id; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize

TREES, LEAF = 8, 96
#: Share of the index's places (vectors times trees) in the leaves that a query visits.
VISIT = 0.12
SAMPLE = 60_000
NEAREST = 5
#: Vectors and queries that meet in one task.
CELL, ASKED = 20_000, 4_000


@dataclass
class Tree:
    normals: np.ndarray  # a hyperplane for each inner node
    offsets: np.ndarray
    children: np.ndarray  # two for each inner node; a leaf is -1 - its number
    sizes: np.ndarray  # vectors in each leaf: of the sample, later of all

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(x), np.int64)
        if not len(self.normals):
            return at
        inner = np.arange(len(x))
        while len(inner):
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normals[node]) >= self.offsets[node]
            at[inner] = self.children[node, right.astype(np.int64)]
            inner = inner[at[inner] >= 0]
        return -1 - at


def build_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals, offsets, children, sizes = [], [], [], []
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        right = None
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = a - b
                offset = float(normal @ (a + b) / 2)
                right = x[rows] @ normal >= offset
                if min(right.sum(), len(rows) - right.sum()) >= len(rows) // 20:
                    break
        if right is None or right.all() or not right.any():
            number = -1 - len(sizes)
            sizes.append(len(rows))
        else:
            number = len(normals)
            normals.append(normal)
            offsets.append(offset)
            children.append([0, 0])
            todo += [(rows[~right], number, 0), (rows[right], number, 1)]
        if parent >= 0:
            children[parent][side] = number
    width = x.shape[1]
    return Tree(np.array(normals, np.float32).reshape(-1, width), np.array(offsets, np.float32), np.array(children, np.int64).reshape(-1, 2), np.array(sizes))


def search(forest: list[Tree], q: np.ndarray, visit: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in the order of one queue that all trees share, until ``visit`` vectors are reached."""
    queue = [(-np.inf, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    found, seen = [], 0
    while queue and seen < visit:
        margin, t, node = heapq.heappop(queue)
        tree = forest[t]
        if node < 0:
            found.append((t, -1 - node))
            seen += int(tree.sizes[-1 - node])
            continue
        side = float(tree.normals[node] @ q - tree.offsets[node])
        left, right = tree.children[node].tolist()
        # the queue gives the least first: the good side keeps its parent's margin, the other is no better than its distance
        heapq.heappush(queue, (max(margin, -side), t, right))
        heapq.heappush(queue, (max(margin, side), t, left))
    return found


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    most = good.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).select("width")
    return good.join(F.broadcast(most), F.size("v") == F.col("width")).drop("width")  # one row


def _unit(values: pd.Series) -> np.ndarray:
    x = np.stack(values.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit(distinct: DataFrame, trees: int = TREES, leaf: int = LEAF) -> list[Tree]:
    total = distinct.count()
    share = min(1.0, SAMPLE / max(1, total))
    rows = distinct.where(F.pmod(F.xxhash64("v", F.lit(8)), F.lit(1 << 20)) / float(1 << 20) < share).select("v").toPandas()  # bounded by SAMPLE
    if rows.empty:
        return []
    x = _unit(rows["v"])
    x = x[np.lexsort(x.T[::-1])]
    return [build_tree(x, leaf, np.random.default_rng(100 + t)) for t in range(trees)]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _in_cell(vectors: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query among the vectors of the leaves that it visits."""
    names = ["q", "ids", "score"]
    if vectors.empty or asked.empty:
        return pd.DataFrame({"q": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
    vectors = vectors.sort_values("leaf", kind="stable").reset_index(drop=True)
    leaf = vectors["leaf"].to_numpy()
    v, q = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (vectors, asked))
    v_norm, q_norm = _norms(v), _norms(q)
    visits = asked["leaves"].to_list()
    owner = np.repeat(np.arange(len(asked)), [len(x) for x in visits])
    visited = np.concatenate(visits)
    order = np.argsort(visited, kind="stable")
    owner, visited = owner[order], visited[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for one in np.unique(visited).tolist():
        a, b = np.searchsorted(leaf, (one, one + 1))
        who = owner[slice(*np.searchsorted(visited, (one, one + 1)))]
        for at in range(a, b, 4096):
            end = min(b, at + 4096)
            score = (q[who] @ v[at:end].T) / (q_norm[who][:, None] * v_norm[None, at:end])
            few = min(k, end - at)
            best = np.argpartition(-score, few - 1, axis=1)[:, :few]
            found.append((np.repeat(who, few), (best + at).ravel(), np.take_along_axis(score, best, 1).ravel()))
    if not found:
        return _in_cell(vectors.iloc[:0], asked, k)
    who, which, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((which, -score, who))
    who, which, score = who[order], which[order], score[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    kept = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who)))) < k
    ids = vectors["ids"].to_numpy()
    return pd.DataFrame({"q": asked["q"].to_numpy()[who[kept]], "ids": ids[which[kept]], "score": score[kept]}, columns=names)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, visit: float = VISIT) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row, its k nearest found by cosine, its own id excluded."""
    spark = vectors.sparkSession
    good = materialize(usable(vectors).withColumn("group", F.xxhash64("v")).withColumn("check", F.hash("v")), "vectors")
    same = Window.partitionBy("group", "check", "v").orderBy("vec_id")
    # of equal vectors the smallest k + 1 ids are enough: one may be the query's own. The window's limit applies before the shuffle
    least = good.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    distinct = materialize(least.groupBy("group", "check", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    kind = distinct.schema["v"].dataType.simpleString()
    forest = fit(distinct)
    known = spark.sparkContext.broadcast(forest)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _unit(batch["v"])
            for t, tree in enumerate(known.value):
                yield pd.DataFrame({"tree": t, "leaf": tree.leaves(x), "v": batch["v"], "ids": batch["ids"]})

    placed = distinct.select("v", "ids").mapInPandas(leaves, f"tree int, leaf int, v {kind}, ids array<long>")
    # all vectors in each leaf: at most trees * SAMPLE / LEAF rows, twice that for uneven trees
    total = 0
    for r in placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        if total == 0:
            for tree in forest:
                tree.sizes = np.zeros_like(tree.sizes)
        forest[r["tree"]].sizes[r["leaf"]] = r["n"]
        total += r["n"]
    counted = spark.sparkContext.broadcast(forest)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, v, q in zip(batch["q"], batch["v"], _unit(batch["v"]), strict=True):
                found = search(counted.value, q, math.ceil(visit * total))
                yield pd.DataFrame({"q": number, "tree": [t for t, _ in found], "leaf": [n for _, n in found], "v": [v] * len(found)}).groupby("tree", as_index=False).agg({"q": "first", "v": "first", "leaf": list}).rename(columns={"leaf": "leaves"})

    asked = good.where(is_query)
    asked_for = materialize(asked.groupBy("group", "check", "v").agg(F.min("vec_id").alias("q")), "queries")
    n_queries = asked_for.count()
    cells, turns = max(1, math.ceil(total / max(1, len(forest)) / CELL)), max(1, math.ceil(n_queries / ASKED))
    walked = asked_for.select("q", "v").repartition(spark.sparkContext.defaultParallelism).mapInPandas(visits, f"tree int, q long, v {kind}, leaves array<int>")
    # a cell has a share of a tree's vectors, of every leaf; a turn has a share of the queries
    left = placed.withColumn("cell", F.pmod(F.xxhash64(F.col("ids")[0], F.lit(5)), F.lit(cells))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = walked.withColumn("turn", F.pmod(F.xxhash64("q", F.lit(6)), F.lit(turns)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    keys = ["tree", "cell", "turn"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda x, y: _in_cell(x, y, k + 1), "q long, ids array<long>, score double")
    # a candidate of several trees counts once
    scored = scored.groupBy("q", "ids").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    top = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # for each searched vector at most k + 1 candidates with as many ids each, nearest first
    ranked = top.groupBy("q").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))))).alias("found"))
    rows = asked.select("group", "check", "v", F.col("vec_id").alias("query_id")).distinct().join(asked_for, ["group", "check", "v"]).join(ranked, "q")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(own).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
