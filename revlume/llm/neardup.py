"""Near duplicates by DartMinHash signatures and banded joins.

A document is the set of its word shingles (SHINGLE lower-cased words; a shorter
text is one shingle), with weight 1 each, or its counts as weights. Darts lie on
the plane of weight and rank of each element, by hashes alone: a Poisson number
with mean one in each unit cell, each dart with a place, a rank and one of
COORDINATES. A document sees the darts below its weights up to the rank at
which about k ln k + 2k of them fall, and keeps the earliest of each coordinate;
two documents agree in a coordinate with the probability of their weighted
Jaccard similarity. A coordinate without a dart extends the rank.

Documents with the same shingles form a class first. Bands of ROWS coordinates
of a class's signature are joined; what shares a band is compared exactly, by the
shingles of the texts: similarity of SIMILARITY or more is a link. In a bucket,
members are first compared with one member, the leader, which binds a large
group with as many pairs as members. Buckets of more parts than one are then
compared further: small ones (SMALL members) as pairs, larger ones in tasks of
two blocks of bounded size each, from which only a spanning forest of links
comes out. Members of the largest part of a bucket meet only those of others, so
that a few strays in a bucket of many copies cost as many comparisons for each
copy as there are strays. So no link that the bands show is lost, no task holds a whole bucket,
and no join makes its pairs. Classes are the connected components.

Nulls and edges: null and empty texts, and those of white space, have no
shingle and are each a class of their own; a row is known by doc_id and text, so
repeated rows are one member; a class is named by its smallest doc_id (null ids
count as the smallest) and told apart by its root, the smallest key, since
doc_ids may be null or repeat; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, free_name, materialize, row_key
from .vector import U, chunks, grams, mix, word_hashes
from .workers import freed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share are not compared: ten standard deviations below SIMILARITY.
LEAST_AGREEMENT = 0.5
#: Members of a bucket that is compared as pairs; members and shingles of a block of a larger one.
SMALL, BLOCK_MEMBERS, BLOCK_SHINGLES = 16, 512, 400_000

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
_UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * _UNIT


def dart_signatures(elements: np.ndarray, weights: np.ndarray, starts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """For each document and coordinate, the hash of the earliest dart below its elements' weights.

    Document i has the elements (distinct 64-bit hashes, sorted) from starts[i] to
    starts[i + 1], at least one. Documents are worked together; each sees what it
    would see alone.
    """
    docs = len(starts) - 1
    best_rank = np.full(docs * coordinates, np.inf)
    best = np.zeros(docs * coordinates, U)
    owner = np.repeat(np.arange(docs), np.diff(starts))
    columns = np.ceil(weights).astype(np.int64)
    # a cell for each element and unit of weight
    element = np.repeat(np.arange(len(elements)), columns)
    column = np.arange(len(element)) - np.repeat(np.cumsum(columns) - columns, columns)
    base = mix(elements[element] ^ mix(column.astype(U) + U(0x51ED2701)))
    width, owner = weights[element] - column, owner[element]
    wanted = coordinates * (math.log(coordinates) + 2)
    top = np.ceil(wanted / np.add.reduceat(weights, starts[:-1])).astype(np.int64)
    row, open_cells = 0, np.arange(len(base))
    while len(open_cells):
        # a row of cells of each document up to its rank, then on while a coordinate is empty
        cell = mix(base[open_cells] ^ mix(np.full(1, row + 0x2545F491, U)))
        number = np.searchsorted(_POISSON, _uniform(cell))
        at = np.repeat(np.arange(len(cell)), number)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
        dart, at = mix(cell[at] + U(0x9E3779B97F4A7C15) * (turn + 1).astype(U)), open_cells[at]
        below = _uniform(mix(dart ^ U(0xA5A5A5A5))) < width[at]
        dart, at = dart[below], at[below]
        rank = row + _uniform(mix(dart ^ U(0x5A5A5A5A)))
        slot = owner[at] * coordinates + (mix(dart ^ U(0x3C3C3C3C)) % U(coordinates)).astype(np.int64)
        np.minimum.at(best_rank, slot, rank)
        first = rank == best_rank[slot]
        best[slot[first]] = dart[first]
        row += 1
        full = np.isfinite(best_rank).reshape(docs, coordinates).all(1)
        more = (row < top) | ~full
        open_cells = open_cells[more[owner[open_cells]]]
    return best.reshape(docs, coordinates)


def dart_signature(elements: np.ndarray, weights: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The signature of one document."""
    return dart_signatures(elements, weights, np.array([0, len(elements)]), coordinates)[0]


def shingle_lists(texts: list[str], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of the shingles of each text, in order; all words of a shorter text are one shingle."""
    for a, b in chunks(texts):
        words, at = word_hashes([t.lower() for t in texts[a:b]])
        for i in range(b - a):
            own = words[at[i] : at[i + 1]]
            yield grams(own, min(size, len(own))) if len(own) else own


def signatures(docs: DataFrame, counted: bool = False) -> DataFrame:
    """key, doc_id, n (shingles), print_a and print_b (of the shingles together), signature and bands of each text with a word."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, ids, texts = batch["key"].to_numpy(), batch["doc_id"].to_numpy(dtype=object), batch["text"].tolist()
            for a, b in chunks(texts, 1 << 18):
                lists = list(shingle_lists(texts[a:b]))
                which = np.array([i for i, x in enumerate(lists) if len(x)], np.int64)
                if not len(which):
                    continue
                owner = np.repeat(np.arange(len(which)), [len(lists[i]) for i in which])
                hashes = np.concatenate([lists[i] for i in which])
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]))
                counts = np.diff(np.append(first, len(hashes)))
                elements, owner = hashes[first], owner[first]
                weights = counts.astype(np.float64) if counted else np.ones(len(elements))
                starts = np.searchsorted(owner, np.arange(len(which) + 1))
                own = mix(elements ^ mix(weights.astype(np.int64).astype(U)))
                darts = dart_signatures(elements, weights, starts)
                folded = np.zeros((len(which), BANDS), U)
                for r in range(ROWS):
                    folded = mix(folded * U(0x100000001B3) ^ darts.reshape(-1, BANDS, ROWS)[:, :, r])
                bands = mix(folded + np.arange(BANDS).astype(U) * U(0xC2B2AE3D27D4EB4F)).view(np.int64)
                short = (darts & U(0xFFFF)).astype("<u2")
                yield pd.DataFrame({
                    "key": keys[a + which], "doc_id": pd.array(ids[a + which], dtype="Int64"), "n": np.diff(starts).astype(np.int32), "print_a": np.add.reduceat(own, starts[:-1]).view(np.int64),
                    "print_b": np.add.reduceat(mix(own ^ U(77)), starts[:-1]).view(np.int64), "signature": [x.tobytes() for x in short], "bands": list(bands),
                })

    keyed = docs.where(F.col("text").isNotNull()).select(row_key().alias("key"), F.col("doc_id").cast("long"), "text")
    return keyed.mapInPandas(freed(rows), "key binary, doc_id long, n int, print_a long, print_b long, signature binary, bands array<long>")


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), -1) for s in (a, b)) if len(a) else (np.zeros((0, 1)), np.zeros((0, 1)))
    return pd.Series((x == y).mean(1))


def _jaccard(counted: bool):
    @F.pandas_udf(T.DoubleType())
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            for t in (x, y):
                if t not in known:
                    if len(known) > 500:
                        known.clear()
                    known[t] = np.unique(next(shingle_lists([t])), return_counts=True)
            (ea, ca), (eb, cb) = (known.get(t) or np.unique(next(shingle_lists([t])), return_counts=True) for t in (x, y))
            _, i, j = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
            both = np.minimum(ca[i], cb[j]).sum() if counted else len(i)
            total = (ca.sum() + cb.sum() if counted else len(ea) + len(eb)) - both
            out.append(both / total)
        return pd.Series(out, dtype="float64")

    return jaccard


def _verified(pairs: DataFrame, members: DataFrame, texts: DataFrame, counted: bool) -> DataFrame:
    """The pairs (a, b) of member keys whose texts are similar enough, written."""
    sig = members.select("key", "signature", "n")
    near = (
        pairs.join(sig.toDF("a", "sig_a", "n_a"), "a").join(sig.toDF("b", "sig_b", "n_b"), "b")
        # without counts, sizes alone bound the similarity
        .where(F.lit(counted) | (F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")))
        .where(_agreement("sig_a", "sig_b") >= LEAST_AGREEMENT).select("a", "b")
    )
    near = materialize(near, "near")  # of known size, so that few pairs move no texts
    compared = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    found = materialize(compared.where(_jaccard(counted)("text_a", "text_b") >= SIMILARITY).select("a", "b"), "links")
    discard(near)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every end of the edges (a, b): the smallest key it is connected with.

    In each round every key takes the smallest root around it, then the root's
    root; rounds end when nothing changes.
    """
    both = materialize(edges.union(edges.select("b", "a")).toDF("key", "other").distinct(), "edges")
    roots = materialize(both.groupBy("key").agg(F.min("other").alias("root")).select("key", F.least("key", "root").alias("root")), "roots")
    written = roots
    while True:
        around = both.join(roots.toDF("other", "near"), "other").groupBy("key").agg(F.min("near").alias("near"))
        closer = roots.join(around, "key").select("key", "root", F.least("root", "near").alias("new"))
        # a root may have moved as well
        jumped = closer.join(closer.select(F.col("key").alias("new"), F.col("new").alias("next")), "new").select("key", "root", F.least("new", "next").alias("new"))
        step = materialize(jumped, "roots")
        discard(written)
        written = step
        if step.where("new < root").isEmpty():
            discard(both)
            return step.select("key", "root")
        roots = step.select("key", F.col("new").alias("root"))


def shingle_sets(texts: DataFrame, counted: bool) -> DataFrame:
    """key and the sorted hashes of each text's shingles (with counts, of each occurrence)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, own = batch["key"].tolist(), batch["text"].tolist()
            for a, b in chunks(own):
                sets = []
                for x in shingle_lists(own[a:b]):
                    elements, counts = np.unique(x, return_counts=True)
                    if counted:
                        turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        elements = np.sort(mix(np.repeat(elements, counts) + U(0xC2B2AE3D27D4EB4F) * turn.astype(U)))
                    sets.append(elements.tobytes())
                yield pd.DataFrame({"key": keys[a:b], "elements": sets})

    return texts.mapInPandas(freed(rows), "key binary, elements binary")


def forest(sets: list[np.ndarray], roots: list, side: np.ndarray) -> list[tuple[int, int]]:
    """Links of the sets that bind all that are similar enough: a spanning forest, without links inside a root.

    Sets of different sides are compared, and all if there is one side alone.
    """
    n = np.array([len(x) for x in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    known, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    two = side.any() and not side.all()
    right = np.bincount(place, side[owner], len(known))
    wanted = (right > 0) & (right < count) if two else count > 1
    kept = wanted[place]
    column = (np.cumsum(wanted) - 1)[place[kept]]
    owner, both = owner[kept], np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    one, other = (np.flatnonzero(~side), np.flatnonzero(side)) if two else (np.arange(len(sets)),) * 2
    cross = np.zeros((len(one), len(other)), np.float32)
    for first in range(0, int(wanted.sum()), 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        cross += part[one] @ part[other].T
    both[np.ix_(one, other)] = cross
    if two:
        both[np.ix_(other, one)] = cross.T
    link = both >= SIMILARITY * (n[:, None] + n[None] - both) - 1e-4
    number: dict = {}
    root = np.array([number.setdefault(r, len(number)) for r in roots])
    same = root[:, None] == root[None]
    if two:
        link &= side[:, None] != side[None]
    out, todo = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not todo[start]:
            continue
        todo[start], queue = False, [start]
        while queue:
            x = queue.pop()
            near = todo & same[x]
            todo &= ~near
            queue += np.flatnonzero(near).tolist()
            near = np.flatnonzero(todo & link[x])
            for y in near.tolist():
                if todo[y]:  # all of its root come with it
                    out.append((x, y))
                    todo[same[y]] = False
                    queue += np.flatnonzero(same[y]).tolist()
    return out


def _in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of rows sorted by bucket and blocks (band, i, j); block is i or j."""
    held: list[pd.DataFrame] = []

    def compared() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        keys = rows["key"].tolist()
        side = (rows["block"] != rows["i"]).to_numpy()
        got = forest([np.frombuffer(x, U) for x in rows["elements"]], rows["root"].tolist(), side)
        return pd.DataFrame([(min(keys[x], keys[y]), max(keys[x], keys[y])) for x, y in got], columns=["a", "b"])

    for batch in batches:
        what = batch[["band", "i", "j"]].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((what[1:] != what[:-1]).any(1)) + 1, [len(batch)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and tuple(held[0][["band", "i", "j"]].iloc[0]) != tuple(what[a]):
                yield compared()
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield compared()


def blocks(many: DataFrame) -> DataFrame:
    """(band, key, root, block, rest, main) of buckets' members (band, key, root, n, size, shingles): those of a bucket's largest root are
    in the ``main`` blocks after the ``rest`` blocks of all others."""
    of_root = many.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    largest = of_root.groupBy("band").agg(F.max_by(F.struct("root", "n", "shingles"), F.struct("n", "root")).alias("most"))
    count = lambda n, shingles: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")
    own = many.join(largest, "band").select(
        "band", "key", "root", (F.col("root") == F.col("most.root")).alias("inner"), count(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")).alias("rest"), count(F.col("most.n"), F.col("most.shingles")).alias("main")
    )
    turn = F.xxhash64("key", F.lit(3))
    block = F.when(F.col("inner"), F.col("rest") + F.pmod(turn, "main")).otherwise(F.pmod(turn, "rest")).cast("int")
    return own.select("band", "key", "root", block.alias("block"), "rest", "main")


def in_pairs_of_blocks(placed: DataFrame) -> DataFrame:
    """Members by the pairs of blocks that are compared: a rest block with each block; main blocks not with each other, since one root binds them."""
    last = F.when(F.col("block") < F.col("rest"), F.col("rest") + F.col("main")).otherwise(F.col("rest")) - 1
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return met.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).drop("rest", "main", "with")


def _roots(members: DataFrame, texts: DataFrame, counted: bool) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that bind all members that the bands show as similar, and (key, root) of all they bind."""
    buckets = materialize(members.select("key", F.col("n").alias("size"), F.explode("bands").alias("band")), "buckets")
    several = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    shared = materialize(buckets.join(several, "band"), "shared")
    discard(buckets)
    # the texts that may be compared, once, so that later joins move no others
    texts = materialize(texts.join(shared.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "compared-texts")
    # a bucket's leader is the member that meets most others in all its buckets
    meets = shared.groupBy("key").agg(F.sum("n").alias("meets"))
    leaders = shared.join(meets, "key").groupBy("band").agg(F.max_by("key", F.struct("meets", "key")).alias("other"))
    led = shared.join(leaders, "band").where("key <> other")
    stars = materialize(led.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct(), "stars")
    links = _verified(stars, members, texts, counted)
    discard(stars)
    bound = components(links)
    parted = shared.where("n > 2").join(bound, "key", "left").withColumn("root", F.coalesce("root", "key"))
    parts = parted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    parted = materialize(parted.join(parts, "band"), "parted")
    discard(shared)

    few = parted.where(F.col("n") <= SMALL).select("band", "key", "root")
    pairs = few.toDF("band", "a", "r").join(few.toDF("band", "b", "s"), "band").where("a < b and r <> s").select("a", "b").distinct()
    found = _verified(pairs, members, texts, counted)

    many = parted.where(F.col("n") > SMALL)
    sets = materialize(shingle_sets(texts.join(many.select("key").distinct(), "key", "left_semi"), counted), "sets")
    blocked = in_pairs_of_blocks(blocks(many).join(sets, "key"))
    inside = materialize(blocked.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(freed(_in_blocks), "a binary, b binary"), "links")
    links = links.union(found).union(inside)
    # what was found last, between the roots found first
    later = found.union(inside).join(bound.toDF("a", "r"), "a", "left").join(bound.toDF("b", "s"), "b", "left").select(F.coalesce("r", "a").alias("a"), F.coalesce("s", "b").alias("b")).where("a <> b")
    over = components(later)
    ends = bound.select("key", "root").union(over.select("key", F.col("key").alias("root"))).distinct()
    roots = ends.join(over.toDF("root", "top"), "root", "left").select("key", F.coalesce("top", "root").alias("root"))
    return links, roots


def classes(docs: DataFrame, counted: bool = False) -> DataFrame:
    """One row for each doc_id and text: doc_id, key, class_id, n_shingles, n_links (of its shingle set to others that were verified), root.

    ``root`` tells classes apart: class_id, a doc_id, is null or shared by several where doc_ids are."""
    prints = materialize(signatures(docs, counted), "signatures")
    # equal shingles: one member, the smallest key, stands for all
    same = ["print_a", "print_b", "n"]
    sets = prints.groupBy(*same).agg(F.min("key").alias("member"))
    # repeated rows have one key
    of_set = materialize(prints.select("key", "doc_id", *same).distinct().join(sets, same).select("key", "doc_id", "n", "member"), "sets")
    members = materialize(prints.join(sets.select(F.col("member").alias("key")), "key", "left_semi").dropDuplicates(["key"]).select("key", "n", "signature", "bands"), "members")
    texts = docs.where(F.col("text").isNotNull()).select(row_key().alias("key"), "text")
    links, roots = _roots(members, texts, counted)
    links, roots = links.distinct(), roots.toDF("member", "root")
    degree = links.select(F.explode(F.array("a", "b")).alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("n_links"))
    found = of_set.join(roots, "member", "left").join(degree, "member", "left").withColumn("root", F.coalesce("root", "member"))
    names = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least"))
    named = found.join(names, "root").select("key", "root", F.col("least.doc_id").alias("class_id"), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key")).distinct()
    return every.join(named, "key", "left").select(
        "doc_id", "key", F.when(F.col("n_shingles").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "key").alias("root")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of its smallest doc_id, and of equal ids the smallest text hash.
    Texts without a word are kept; of repeated rows one stays, with a word or without."""
    found = classes(docs)
    best = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key")).alias("best"))
    kept = best.select(F.col("best.key").alias("kept_key")).union(found.where("n_shingles = 0").select("key")).distinct()
    own = free_name(docs, "kept_row_key")
    rows = docs.withColumn(own, row_key())
    kept = kept.withColumnRenamed("kept_key", own)
    return rows.join(kept, own, "left_semi").dropDuplicates([own]).select(*docs.columns)
