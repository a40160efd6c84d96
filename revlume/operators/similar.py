"""Similar strings by edit distance: near copies across splits, and the best fuzzy name of a dictionary.

The distance is that of insertions and deletions alone, so the ratio of two strings is twice
their longest common subsequence over both lengths. Subsequences are found bit-parallel, for all
pairs of a batch at once: a string's characters are bits of 64-bit words, and one addition with
carries does the work of a row of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlume.plans.shared import STORE_ROWS, discard, materialize

_A_END, _B_END = 0xFFFFFFFE, 0xFFFFFFFF
#: Bytes of character comparisons held at a time.
_HELD = 1 << 24


def _codes(texts: list[str], width: int, end: int) -> np.ndarray:
    """Code points by row, filled up with a value that no text has."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), width), end, np.uint32)
    out[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    short = [min(p, key=len) for p in zip(a, b, strict=True)]
    long = [max(p[::-1], key=len) for p in zip(a, b, strict=True)]
    order = sorted((i for i in range(len(a)) if short[i]), key=lambda i: (len(short[i]), len(long[i])))
    at = 0
    while at < len(order):
        stop = at + 1
        words = -(-len(short[order[at]]) // 64)
        while stop < len(order) and -(-len(short[order[stop]]) // 64) == words and (stop - at) * words * 64 < _HELD:
            stop += 1
        some = order[at:stop]
        out[some] = _lcs([short[i] for i in some], [long[i] for i in some], words)
        at = stop
    return out


def _lcs(short: list[str], long: list[str], words: int) -> np.ndarray:
    first, second = _codes(short, 64 * words, _A_END), _codes(long, max(map(len, long)), _B_END)
    row = np.full((len(short), words), ~np.uint64(0))
    for j in range(second.shape[1]):
        match = np.packbits(first == second[:, j : j + 1], axis=1, bitorder="little").view("<u8")
        taken = row & match
        total, carry = np.empty_like(row), np.zeros(len(short), np.uint64)
        for w in range(words):
            part = row[:, w] + taken[:, w]
            over = part < taken[:, w]
            total[:, w] = part + carry
            carry = (over | (total[:, w] < part)).astype(np.uint64)
        row = total | (row & ~match)
    # a character of a common subsequence is a zero bit
    return 64 * words - np.bitwise_count(row).sum(axis=1).astype(np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Similarity of each pair, 0 to 1 (1 for two empty strings)."""
    both = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    return np.where(both > 0, 2 * lcs_lengths(a, b) / np.maximum(both, 1), 1.0)


# near copies

_BAND = 11 / 9  # how much longer the other text may be at the ratio of 0.9
#: Fixed values of the check: the least ratio, in tenths.
RATIO = 0.9


def most_edits(n: int, ratio: float = RATIO) -> int:
    """Insertions and deletions, at most, between a text of n characters and a similar one that is not shorter."""
    return int(2 * (1 - ratio) * n / ratio + 1e-9)


@lru_cache(100_000)
def cut_points(n: int, ratio: float = RATIO) -> tuple[int, ...]:
    """Where the pieces of a text of n characters begin, with its end: one piece more than edits can touch."""
    k = most_edits(n, ratio) + 1
    return tuple(i * n // k for i in range(k + 1))


def _band(n: int, ratio: float) -> int:
    return int(np.log(max(n, 1)) / np.log((2 - ratio) / ratio) + 1e-9)


def _width(band: int, ratio: float) -> int:
    """Width of the ranges of positions in a band: no less than any shift between similar texts of it."""
    return most_edits(int(((2 - ratio) / ratio) ** (band + 1)) + 1, ratio) + 1


@lru_cache(100_000)
def _piece_lengths(n: int, ratio: float) -> tuple[int, ...]:
    """Lengths of the pieces of all texts that a text of n characters may be similar to and not shorter than."""
    out: set[int] = set()
    for m in range(max(1, int(n * ratio / (2 - ratio) - 1e-9)), n + 1):
        points = cut_points(m, ratio)
        out.update(y - x for x, y in zip(points, points[1:]))
    return tuple(sorted(out))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _keys(codes: np.ndarray, at: np.ndarray, length: int, band: int, place: np.ndarray) -> np.ndarray:
    h = np.full(len(at), length * 1000003 + band, np.uint64)
    for i in range(length):
        h = _scramble(h * np.uint64(1099511628211) + codes[at + i])
    return _scramble(h ^ place.astype(np.uint64)).view(np.int64)


def pieces_and_runs(text: str, ratio: float = RATIO) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and positions of a text's pieces (for its own and the next band of lengths, and the ranges of positions
    that a shift may reach), and of all its runs of characters that may be a piece of a shorter text."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    own, reach = _band(n, ratio), most_edits(n, ratio)
    starts, lengths = np.array(cut_points(n, ratio)[:-1]), np.diff(cut_points(n, ratio))
    keys, places = [], []
    for band in (own, own + 1):
        width = _width(band, ratio)
        low, high = np.maximum(starts - reach, 0) // width, (starts + reach) // width
        for step in range(3):
            for length in set(lengths.tolist()):
                some = (lengths == length) & (low + step <= high)
                keys.append(_keys(codes, starts[some], length, band, (low + step)[some]))
                places.append(starts[some])
    pieces = [np.concatenate(keys), np.concatenate(places)]
    keys, places = [], []
    for length in _piece_lengths(n, ratio):
        at = np.arange(n - length + 1)
        keys.append(_keys(codes, at, length, own, at // _width(own, ratio)))
        places.append(at)
    return pieces, [np.concatenate(keys), np.concatenate(places)]


def near_copies(rows: DataFrame, order: list[str], ratio: float = RATIO) -> DataFrame:
    """(id, split, other_split) of rows (id, split, text) with a near copy in a split that comes later in ``order``.

    Texts count trimmed and in lower case; null and empty ones, and equal ones, don't. A text that is similar enough
    is cut in one piece more than insertions and deletions can touch, so that one piece stands unchanged in any longer
    or equally long similar text, not farther off than their number: pieces and runs of characters meet by an equi-join
    on content, band of lengths and range of positions, and pairs that meet are compared exactly. Complete for any
    texts; selective for short ones such as reviews and names, whose pieces (four or five characters) are told apart by
    their places.
    """
    clean = rows.select("id", "split", F.lower(F.trim("text")).alias("text")).where("text <> ''")
    texts = materialize(clean.groupBy("text").agg(F.array_sort(F.collect_set("split")).alias("splits")).withColumn("key", F.unhex(F.md5("text"))), "texts")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for i, text in enumerate(batch["text"]):
                for side, (found, at) in enumerate(pieces_and_runs(text, ratio)):
                    held.append((found, at, side, i, len(text)))
                    size += len(found)
                if size >= _HELD >> 6 or i == len(batch) - 1:
                    many = [len(h[0]) for h in held]
                    side, row, n = (np.repeat([h[k] for h in held], many) for k in (2, 3, 4))
                    yield pd.DataFrame({"hit": np.concatenate([h[0] for h in held]), "side": side, "key": batch["key"].to_numpy()[row], "n": n, "at": np.concatenate([h[1] for h in held])})
                    held, size = [], 0

    hits = texts.select("key", "text").mapInPandas(emit, "hit long, side int, key binary, n int, at int")
    short = hits.where("side = 0").select("hit", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    long = hits.where("side = 1").select("hit", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    edits = F.lit(1 - ratio) * (F.col("n_a") + F.col("n_b")) + 1e-9
    met = (
        short.join(long, "hit").where((F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
        .where((F.col("n_b") - F.col("n_a") <= edits) & (F.abs(F.col("at_a") - F.col("at_b")) <= edits)).select("a", "b").distinct()
    )

    @F.pandas_udf(T.BooleanType())
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.tolist(), y.tolist()
        both = np.array([len(s) + len(t) for s, t in zip(x, y, strict=True)], np.int64)
        return pd.Series(both - 2 * lcs_lengths(x, y) <= (1 - ratio) * both + 1e-9)

    one = lambda name: texts.select(F.col("key").alias(name), F.col("text").alias(f"text_{name}"), F.col("splits").alias(f"splits_{name}"))
    # texts of one split alone, the same, aren't compared
    compared = met.join(one("a"), "a").join(one("b"), "b").where(F.size(F.array_union("splits_a", "splits_b")) > 1)
    pairs = materialize(compared.where(alike("text_a", "text_b")).select("text_a", "splits_a", "text_b", "splits_b"), "pairs")
    turned = pairs.select(F.col("text_b").alias("text"), F.col("splits_b").alias("own"), F.col("splits_a").alias("other"))
    both = pairs.select(F.col("text_a").alias("text"), F.col("splits_a").alias("own"), F.col("splits_b").alias("other")).union(turned)
    turn = F.create_map(*(x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))))
    hit = both.select("text", F.explode("own").alias("split"), "other").select("text", "split", F.explode("other").alias("other_split")).where(turn[F.col("split")] < turn[F.col("other_split")]).distinct()
    found = materialize(clean.join(hit, ["text", "split"]).select("id", "split", "other_split"), "found")
    discard(texts, pairs)
    return found


# fuzzy names

# fixed values: what scores of other forms count for, and the least score of a match
UNBASED, PARTLY, BARELY = 0.95, 0.9, 0.6
MATCH = 0.85


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of the shorter string with a stretch of the longer one of its length, or a shorter one at either end."""
    needles, stretches, owner = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        for s, t in ((x, y), (y, x)) if len(x) == len(y) else ((min(x, y, key=len), max(x, y, key=len)),):
            m = len(s)
            if not m:
                continue
            some = {t[max(k, 0) : k + m] for k in range(1 - m, len(t))}
            needles += [s] * len(some)
            stretches += sorted(some)
            owner += [i] * len(some)
    out = np.array([1.0 if not x and not y else 0.0 for x, y in zip(a, b, strict=True)])
    if needles:
        np.maximum.at(out, owner, ratios(needles, stretches))
    return out


def _tokens(text: str) -> list[str]:
    return sorted(text.split())


def _set_forms(x: str, y: str) -> tuple[str, str, str]:
    """The words of both, of the first alone and of the second alone."""
    s, t = set(x.split()), set(y.split())
    return " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))


def token_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The better of the ratios of the sorted words, and of the words of both with those of one or the other."""
    best = ratios([" ".join(_tokens(x)) for x in a], [" ".join(_tokens(y)) for y in b])
    forms = [_set_forms(x, y) for x, y in zip(a, b, strict=True)]
    edits = np.array([len(s) + len(t) for _, s, t in forms]) - 2 * lcs_lengths([s for _, s, _ in forms], [t for _, _, t in forms])
    for i, (both, s, t) in enumerate(forms):
        if both and (not s or not t):
            best[i] = 1.0
            continue
        gap = 1 if both else 0
        first, second = len(both) + gap + len(s), len(both) + gap + len(t)
        if first + second:
            best[i] = max(best[i], 1 - edits[i] / (first + second))
        if both:
            best[i] = max(best[i], 1 - (gap + len(s)) / (len(both) + first), 1 - (gap + len(t)) / (len(both) + second))
    return best


def partial_token_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """1 with a word in common, else the best partial ratio of the sorted words, repeated or once each."""
    forms = [_set_forms(x, y) for x, y in zip(a, b, strict=True)]
    best = np.maximum(partial_ratios([" ".join(_tokens(x)) for x in a], [" ".join(_tokens(y)) for y in b]), partial_ratios([s for _, s, _ in forms], [t for _, _, t in forms]))
    return np.where([bool(both) for both, _, _ in forms], 1.0, best)


def weighted_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best of the plain ratio and the scaled ratios of other forms: of words for strings of like lengths, of parts for
    others. A string without a character is like none."""
    out = np.zeros(len(a))
    some = [i for i in range(len(a)) if a[i] and b[i]]
    x, y = [a[i] for i in some], [b[i] for i in some]
    if not some:
        return out
    best = ratios(x, y)
    times = np.array([max(len(s), len(t)) / min(len(s), len(t)) for s, t in zip(x, y, strict=True)])
    for chosen, scale, forms in ((times < 1.5, 1.0, (token_ratios,)), ((times >= 1.5) & (times <= 8), PARTLY, (partial_ratios, partial_token_ratios)), (times > 8, BARELY, (partial_ratios, partial_token_ratios))):
        at = np.flatnonzero(chosen)
        if len(at):
            p, q = [x[i] for i in at], [y[i] for i in at]
            for form in forms:
                best[at] = np.maximum(best[at], form(p, q) * scale * (1.0 if form is partial_ratios else UNBASED))
    out[some] = best
    return out


class Dictionary:
    """Candidate names with what bounds their scores: lengths, counts of characters and words."""

    _BINS = 97

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.lengths = np.array([len(x) for x in self.names], np.int64)
        self.counts = self._counted(self.names)
        self.by_word: dict[str, list[int]] = {}
        for i, x in enumerate(self.names):
            for w in set(x.split()):
                self.by_word.setdefault(w, []).append(i)

    def _counted(self, names: list[str]) -> np.ndarray:
        out = np.zeros((len(names), self._BINS), np.int64)
        for i, x in enumerate(names):
            out[i] = np.bincount([ord(c) % self._BINS for c in "".join(x.split())], minlength=self._BINS)
        return out

    def best(self, query: str, enough: float = MATCH) -> tuple[str, float] | None:
        """The best candidate of ``enough`` or more, the least of equally good ones."""
        query = query.lower().strip()
        if not query or not self.names:
            return None
        counts = self._counted([query])[0]
        # no form has a longer common subsequence than there are characters in common (blanks apart, one of which stands
        # between any two words), and none is compared with less than the characters of its words
        spaces = np.minimum(len(query), self.lengths) - np.minimum(counts.sum(), self.counts.sum(axis=1))
        common = np.minimum(counts, self.counts).sum(axis=1) + np.maximum(spaces, 0) + 1
        least = np.maximum(np.minimum(len(query), self.lengths), 1)
        bound = np.minimum(1.0, 2 * common / (least + np.minimum(common, least)))
        worth = bound >= enough
        for w in query.split():
            worth[self.by_word.get(w, [])] = True
        some = np.flatnonzero(worth)
        if not len(some):
            return None
        scores = weighted_ratios([query] * len(some), [self.names[i] for i in some])
        top = int(scores.argmax())  # names are sorted, so the least of equal ones
        return (self.names[some[top]], float(scores[top])) if scores[top] >= enough - 1e-12 else None


def best_match(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, candidate, score) of each distinct query with a candidate of MATCH or more: the best, of equal ones the least.

    ``candidates`` is a reviewed dictionary of at most STORE_ROWS distinct names, more are refused; it goes to all tasks,
    queries are dealt out. Null and empty strings match nothing.
    """
    names = [r[0] for r in candidates.select("candidate").where("candidate <> ''").distinct().limit(STORE_ROWS + 1).collect()]
    if len(names) > STORE_ROWS:
        raise ValueError(f"more than {STORE_ROWS} candidates")
    sent = queries.sparkSession.sparkContext.broadcast(names)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Dictionary(sent.value)
        for batch in batches:
            found = [(q, *hit) for q in batch["query"] for hit in [store.best(q)] if hit]
            yield pd.DataFrame(found, columns=["query", "candidate", "score"])

    return queries.select("query").where("query is not null").distinct().mapInPandas(match, "query string, candidate string, score double")
