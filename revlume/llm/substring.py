"""Repeated passages by suffix trees of groups of suffixes with one prefix.

A window is LENGTH consecutive words of one document; every word that lies in a
window whose word sequence also starts anywhere else is removed. A window is the
beginning of a suffix, and repeats exactly if its suffix lies below an internal
node of the suffix tree at LENGTH words or deeper.

Suffixes are split into groups that fit in memory by a prefix. So that a word is
sent a few times and not LENGTH times, the prefix that counts is that of the
suffix at the window's seed (its run of SEED words with the least hash, the
first of equal ones): equal windows have equal seeds at equal places, and
neighbouring windows share one, so that they go together in one stretch of
words. Seeds that occur once in the corpus begin no repeat, and their windows go
no further. In a task, the suffixes of a batch of groups are sorted by doubling,
neighbours' common prefixes in words give the depths of the tree's internal
nodes, and all leaves below a node of LENGTH words or more are repeats. A seed
that occurs more than GROUP times is too short a prefix for one group: it grows
to the whole window, whose occurrences are counted with partial sums, wherever
they are.

Words are ``[^\\x20\\x09-\\x0D]+``, compared by 64-bit hashes.

Nulls and edges: a null text has no words; texts of fewer than LENGTH words have
no window; a row is known by doc_id and text, and repeated rows repeat each
other's windows; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, row_key
from .vector import U, chunks, grams, mix, word_hashes

LENGTH, SEED = 35, 8
#: Stretches of one seed that a task gathers at most; windows that a task sorts at a time.
GROUP, BATCH = 20_000, 100_000
#: Stretches that a task hands on at a time.
PART = 20_000
#: Depths are told apart up to this number of words.
DEEPEST = 64

_WORD = re.compile("[^\x20\x09-\x0d]+")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds, first windows and numbers of windows of the maximal runs of windows with one seed, and the seed's places in them."""
    if len(words) < LENGTH:
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    runs = grams(words, SEED)
    seeds = _least(runs, LENGTH - SEED + 1)
    first = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))
    n = np.diff(np.append(first, len(seeds)))
    places = np.ones(len(first), np.int64)
    if len(np.unique(runs)) < len(runs):  # a seed may stand twice in a stretch, whose windows may repeat each other then
        for i, (a, k) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
            places[i] = (runs[a : a + k + LENGTH - SEED] == seeds[a]).sum()
    return seeds[first], first, n, places


def _words(texts: list[str]) -> Iterator[np.ndarray]:
    for a, b in chunks(texts):
        words, at = word_hashes(texts[a:b])
        for i in range(b - a):
            yield words[at[i] : at[i + 1]]


def seeds(keyed: DataFrame) -> DataFrame:
    """(seed, key, first, n, places) of all stretches."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(parts: list) -> pd.DataFrame:
            key, s, first, n, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pd.DataFrame({"seed": s, "key": key, "first": first.astype(np.int32), "n": n.astype(np.int32), "places": places.astype(np.int32)})

        for batch in batches:
            parts, size = [], 0
            for key, words in zip(batch["key"].to_numpy(), _words(batch["text"].tolist()), strict=True):
                s, *numbers = stretches(words)
                # not np.full: it drops the zero bytes at a key's end
                parts.append((np.repeat(np.array([key], object), len(s)), s.view(np.int64), *numbers))
                size += len(s)
                if size > PART:
                    yield table(parts)
                    parts, size = [], 0
            if parts:
                yield table(parts)

    return keyed.mapInPandas(rows, "seed long, key binary, first int, n int, places int")


def suffix_tree(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of pieces of words in their order, and the depth, in words, of the node that parts each from the one before.

    ``ends``: where pieces end, the last one with the words. Ranks of runs of 1, 2, 4, ... DEEPEST words sort the suffixes;
    depths come from the same ranks. A suffix ends with its piece; depths are at most 2 * DEEPEST - 1.
    """
    n = len(words) + len(ends)
    stops = ends + np.arange(len(ends))
    text = np.empty(n, np.int64)
    body = np.ones(n, bool)
    body[stops] = False
    text[body] = np.unique(words, return_inverse=True)[1] + len(ends)
    text[stops] = np.arange(len(ends))  # each piece ends with a word of its own
    ranks, length = [text], 1
    while length < DEEPEST:
        after = np.full(n, -1, np.int64)
        after[:-length] = ranks[-1][length:] if length < n else after[:-length]
        ranks.append(np.unique(ranks[-1] * (n + 1) + after + 1, return_inverse=True)[1])
        length *= 2
    order = np.argsort(ranks[-1], kind="stable")
    depth = np.zeros(n, np.int64)
    a, b = order[1:], order[:-1]
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + depth[1:], b + depth[1:]
        inside = np.maximum(x, y) < n
        same = inside & (ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)])
        depth[1:][same] += 1 << level
    # back to places among the words; a suffix of a mark alone is none
    place = np.cumsum(body) - 1
    kept = body[order]
    at = np.flatnonzero(kept)
    if len(at):
        # marks sort before all words, so that nothing between two suffixes is left out
        depth = depth[at]
        depth[0] = 0
    return place[order[kept]], depth[: len(at)]


def internal_nodes(depth: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(depth, first, end) of the tree's internal nodes of a depth or more: their leaves among the sorted suffixes."""
    out, open_nodes = [], []
    for i, d in enumerate([*depth.tolist(), 0]):
        first = i - 1
        while open_nodes and open_nodes[-1][0] > d:
            deep, first = open_nodes.pop()
            out.append((deep, first, i))
        if d >= least and (not open_nodes or open_nodes[-1][0] < d):
            open_nodes.append((d, first))
    return out


def repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word of the pieces, whether the window that begins there lies below a node of LENGTH words or more."""
    order, depth = suffix_tree(words, ends)
    deep = depth >= LENGTH
    out = np.zeros(len(words), bool)
    out[order] = deep | np.append(deep[1:], False)
    return out


def _stretch_rows(found: DataFrame) -> DataFrame:
    """The words (hashes) of the stretches that a text has left: (seed, key, first, n, words)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, names = [], ["seed", "key", "first", "n", "words"]
            for key, own, words in zip(batch["key"], batch["stretches"], _words(batch["text"].tolist()), strict=True):
                for x in own:
                    out.append((x["seed"], key, x["first"], x["n"], words[x["first"] : x["first"] + x["n"] + LENGTH - 1].tobytes()))
                if len(out) > PART:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return found.mapInPandas(rows, "seed long, key binary, first int, n int, words binary")


def _runs(row: np.ndarray, window: np.ndarray, keys: list) -> pd.DataFrame:
    """Marked windows as runs: (key, first word, end); a row is a number in ``keys``."""
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)]))
    last = np.append(first[1:], len(row)) - 1
    return pd.DataFrame({"key": [keys[i] for i in row[first].tolist()], "first": window[first].astype(np.int32), "end": (window[last] + LENGTH).astype(np.int32)})


def _trees(stretches_by_seed: DataFrame) -> DataFrame:
    """Runs of repeated windows, by the trees of the groups. Rows of a seed stand together in a partition."""

    def tree(parts: list[pd.DataFrame]) -> pd.DataFrame | None:
        rows = pd.concat(parts, ignore_index=True)
        pieces = [np.frombuffer(w, U) for w in rows["words"]]
        n, sizes = rows["n"].to_numpy(np.int64), np.array([len(w) for w in pieces])
        ends = np.cumsum(sizes)
        deep = repeats(np.concatenate(pieces), ends)
        row = np.repeat(np.arange(len(rows)), n)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        marked = deep[(ends - sizes)[row] + turn]
        window = turn + rows["first"].to_numpy(np.int64)[row]
        return _runs(row[marked], window[marked], rows["key"].tolist()) if marked.any() else None

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            # a batch may end inside a group: only whole groups go, in parts of about BATCH windows
            held.append(batch)
            size += int(batch["n"].sum())
            while size >= BATCH:
                rows = pd.concat(held, ignore_index=True)
                seed = rows["seed"].to_numpy()
                edges = np.flatnonzero(seed[1:] != seed[:-1]) + 1
                if not len(edges):
                    held = [rows]
                    break
                at = np.cumsum(rows["n"].to_numpy())[edges - 1]
                cut = int(edges[max(0, int(np.searchsorted(at, BATCH)) - 1)])
                if (found := tree([rows.iloc[:cut]])) is not None:
                    yield found
                held, size = [rows.iloc[cut:]], int(rows["n"].iloc[cut:].sum())
        if held and (found := tree(held)) is not None:
            yield found

    return stretches_by_seed.repartition("seed").sortWithinPartitions("seed").mapInPandas(rows, "key binary, first int, end int")


def _long_prefixes(stretch: DataFrame) -> DataFrame:
    """Runs of repeated windows of frequent seeds: windows as prefixes, counted with partial sums.

    Equal stretches share their verdict: only one of each is cut into windows,
    which count as often as it occurs.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PART // 8):
                part = batch.iloc[at : at + PART // 8]
                words = [np.frombuffer(w, U) for w in part["words"]]
                n = np.array([len(w) - LENGTH + 1 for w in words])
                one, two = (np.concatenate([grams(w if k else mix(w), LENGTH) for w in words]) for k in (0, 1))
                spread = {c: np.repeat(part[c].to_numpy(), n) for c in ("x", "y", "copies")}
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"a": one.view(np.int64), "b": two.view(np.int64), "x": spread["x"], "y": spread["y"], "offset": offset.astype(np.int32), "copies": spread["copies"]})

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["offsets"].map(len).to_numpy()
            if sizes.sum():
                window = np.concatenate(batch["offsets"].to_list()) + np.repeat(batch["first"].to_numpy(), sizes)
                yield _runs(np.repeat(np.arange(len(batch)), sizes), window, batch["key"].tolist())

    same = [F.xxhash64("words").alias("x"), F.xxhash64("words", F.lit(35)).alias("y")]
    stretch = materialize(stretch.select("key", "first", "words", *same), "long-prefixes")
    distinct = stretch.groupBy("x", "y").agg(F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"))
    windows = materialize(distinct.mapInPandas(cut, "a long, b long, x long, y long, offset int, copies long"), "long-windows")
    often = windows.groupBy("a", "b").agg(F.sum("copies").alias("n")).where("n > 1").select("a", "b")
    marked = windows.join(often, ["a", "b"]).groupBy("x", "y").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
    return stretch.select("key", "first", "x", "y").join(marked, ["x", "y"]).select("key", "first", "offsets").mapInPandas(runs, "key binary, first int, end int")


def repeated(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (key, text): the texts with a frequent seed, and the runs (key, first, end) of words to remove."""
    all_seeds = materialize(seeds(keyed), "seeds")
    often = all_seeds.groupBy("seed").agg(F.sum("places").alias("count")).where("count > 1")
    left = all_seeds.join(often, "seed").select("key", F.struct("seed", "first", "n", (F.col("count") > GROUP).alias("long")).alias("s"))
    # a document's stretches: no more than it has words
    of_text = left.groupBy("key").agg(F.collect_set("s").alias("stretches"))
    texts = materialize(keyed.join(of_text, "key"), "repeat-texts")
    short = texts.select("key", "text", F.filter("stretches", lambda x: ~x["long"]).alias("stretches")).where("size(stretches) > 0")
    long = texts.select("key", "text", F.filter("stretches", lambda x: x["long"]).alias("stretches")).where("size(stretches) > 0")
    runs = _trees(_stretch_rows(short)).union(_long_prefixes(_stretch_rows(long)))
    return texts.select("key", "text"), runs


def kept_text(words: list[str], runs: list | None) -> tuple[int, str]:
    """The number of words that runs cover, and the others joined by spaces."""
    keep = np.ones(len(words), bool)
    for r in runs if runs is not None else ():
        keep[r["first"] : r["end"]] = False
    return int(len(words) - keep.sum()), " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each row."""
    keyed = docs.select(row_key().alias("key"), "text").where(F.col("text").isNotNull())
    texts, runs = repeated(keyed)
    by_text = runs.groupBy("key").agg(F.collect_set(F.struct("first", "end")).alias("runs"))
    schema = "key binary, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            own = batch["runs"] if "runs" in batch else [None] * len(batch)
            for key, text, r in zip(batch["key"], batch["text"], own, strict=True):
                words = _WORD.findall(text) if isinstance(text, str) else []
                n, kept = kept_text(words, r)
                out.append((key, len(words), n, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), *([kept] * with_text)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    cut = texts.dropDuplicates(["key"]).join(by_text, "key").mapInPandas(digest, schema)
    own = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), "text")

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d in digest([batch]):
                d.insert(1, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
                yield d

    # texts without a removed word are digested where they are read; the others' digests replace them
    whole = own.mapInPandas(plain, schema.replace("key binary", "key binary, doc_id long"))
    names = ["n_removed", "kept_sha256", *(["kept_text"] * with_text)]
    changed = cut.select("key", *(F.col(c).alias(f"cut_{c}") for c in names))
    return whole.join(changed, "key", "left").select("doc_id", "n_words", *(F.coalesce(f"cut_{c}", c).alias(c) for c in names))
