"""Alignment of two tokenizers' tokens over the same bytes.

Each text, with a space before it, is encoded by a byte-level vocabulary (A) and
by a piece vocabulary (B). The byte offsets where tokens end are two sorted
lists; the shorter one drives a galloping search in the longer one (exponential
steps from the place that the driver's own rank suggests, then binary search),
for all driving ends at once. Common ends cut the text into groups; differences
of ranks give each group's range of A and of B tokens, and the two tokens that
end together at a cut are linked.

How often a pair of ids is linked is counted over the whole corpus. Of two tokens
that end together one's bytes are the end of the other's, so the longer one and
the shorter one's length tell the pair: pairs are numbered by that, and there are
no more numbers than bytes in both vocabularies (``Vocabularies.pairs``, about
700,000 for vocabularies of 50,000 and 32,000). Counts by pair are therefore
bounded whatever the corpus; they are summed in tasks, then in Spark, and sent to
all tasks. Links themselves stay in the written table.

Nulls and edges: a text that is null or empty, or whose tokens don't give back its
bytes (a piece vocabulary may change characters), has no tokens: all counts are 0
and ``groups_sha256`` is ''. Special tokens' strings in a text are plain text.
Equal texts and rows with equal or null ids are rows of their own and all count;
an id pair that ties for its B id's highest count is a best one; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .tokens import _RUNS, _SPACE, ChunkEncoder
from .vector import chunks

#: Word encodings that a worker keeps for each vocabulary (memory against time, not results).
CACHE_ENTRIES = 600_000
#: Characters of text that are aligned at a time, if they are of more than one document.
TOGETHER = 1 << 20

_STRANGE = 0xFFFFFFFF  # stands for a chunk whose pieces don't give back its bytes
_DIGITS = 8
_B_CHUNK = re.compile(r" +[^ \n]+|\n[^ \n]*| +")


class SpacedEncoder(ChunkEncoder):
    """Byte-level ids of a text with a space before it; special tokens' strings are plain text."""

    def __init__(self, path: str, entries: int):
        super().__init__(path, True, entries)
        self.tokenizer.encode_special_tokens = True

    def _odd(self, text: str) -> bool:
        return "\x00" in text

    def _whole(self, text: str) -> str:
        return " " + text

    def _cut(self, text: str) -> list[str]:
        if any(r in text for r in _RUNS) or text[0] in _SPACE or text[-1] in _SPACE:
            return super()._cut(" " + text)
        return text.replace("\n", " \n").split(" ")


class PieceEncoder(ChunkEncoder):
    """Piece ids of a text, cut before spaces and line ends, which no piece spans.

    A chunk's key is the chunk without the first space (which the library adds); a chunk that
    begins with a line end is its own key. A vocabulary with pieces that span such a step
    encodes whole texts."""

    def __init__(self, path: str, entries: int):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entries = entries
        self.chunks, self.old = {}, {}
        self.bytes = piece_bytes(self.library)
        own = [self.library.id_to_piece(i) for i in range(len(self.bytes)) if not self.library.is_byte(i)]
        self.spans = any(re.search("[^▁]▁|\n", p) for p in own)
        self.space = self.library.piece_to_id("▁")
        self.apart = self.library.encode("\n")[:1] == [self.space] and self.library.encode(" ", out_type=str) == ["▁▁"]

    def _odd(self, text: str) -> bool:
        return self.spans or not self.apart

    def _cut(self, text: str) -> list[str]:
        if "  " not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        return [c if c[0] == "\n" else c[1:] for c in _B_CHUNK.findall(" " + text)]

    def _ids(self, text: str) -> bytes:
        return self._sound(self.library.encode(text), " " + text)

    def _sound(self, ids: list[int], text: str) -> bytes:
        same = b"".join([self.bytes[i] for i in ids]) == text.encode("utf-8", "replace")
        return np.array(ids if same else [_STRANGE], dtype="<u4").tobytes()

    def _learn(self, keys: set[str]) -> None:
        for key in keys:
            if not key:
                self.chunks[key] = np.array([self.space], dtype="<u4").tobytes()
            elif key[0] == "\n":
                self.chunks[key] = self._sound(self.library.encode(key)[1:], key)
            else:
                self.chunks[key] = self._ids(key)


def piece_bytes(library) -> list[bytes]:
    """The bytes of each id of a piece vocabulary."""
    out = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))
    return out


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable Latin-1 characters stand for their
    own byte, the characters from U+0100 for the other bytes in rising order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in plain]
    value = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    tokens = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(tokens.values()) + 1)
    for token, i in tokens.items():
        out[i] = bytes([value[c] for c in token]) if all(c in value for c in token) else token.encode("utf-8")
    return out


class Vocabularies:
    """Both vocabularies of a worker: encoders, byte lengths, digits of ids and the numbers of pairs."""

    def __init__(self, a_path: str, b_path: str, entries: int = CACHE_ENTRIES):
        self.a_path, self.b_path, self.entries = a_path, b_path, entries

    def __reduce__(self):
        return _worker, (self.a_path, self.b_path, self.entries)

    @cached_property
    def a(self) -> SpacedEncoder:
        return SpacedEncoder(self.a_path, self.entries)

    @cached_property
    def b(self) -> PieceEncoder:
        return PieceEncoder(self.b_path, self.entries)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        return byte_level_bytes(self.a.tokenizer)

    @cached_property
    def a_length(self) -> np.ndarray:
        return np.array([len(x) for x in self.a_bytes], np.int64)

    @cached_property
    def b_length(self) -> np.ndarray:
        return np.array([len(x) for x in self.b.bytes], np.int64)

    @cached_property
    def b_is_byte(self) -> np.ndarray:
        return np.array([self.b.library.is_byte(i) for i in range(len(self.b.bytes))], bool)

    @cached_property
    def a_base(self) -> np.ndarray:
        """Where the numbers of pairs begin whose A token is the longer one."""
        return np.cumsum(self.a_length + 1) - self.a_length - 1

    @cached_property
    def b_base(self) -> np.ndarray:
        return int(self.a_base[-1] + self.a_length[-1] + 1) + np.cumsum(self.b_length) - self.b_length

    @property
    def pairs(self) -> int:
        """How many numbers of pairs there are."""
        return int(self.b_base[-1] + self.b_length[-1])

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair's number: the longer token's place and the shorter one's length (0 for a byte of its own)."""
        of_a, of_b = self.a_length[a], self.b_length[b]
        return np.where(of_b <= of_a, self.a_base[a] + np.where(self.b_is_byte[b], 0, of_b), self.b_base[b] + of_a)

    def second(self, numbers: np.ndarray) -> np.ndarray:
        """The B id of each pair's number."""
        own = {x: i for i, x in enumerate(self.b.bytes) if not self.b_is_byte[i]}
        byte = {x: i for i, x in enumerate(self.b.bytes) if self.b_is_byte[i]}
        first_b = int(self.b_base[0])
        out = np.searchsorted(self.b_base, numbers, side="right") - 1
        low = np.flatnonzero(numbers < first_b)
        longer = np.searchsorted(self.a_base, numbers[low], side="right") - 1
        for at, a, length in zip(low.tolist(), longer.tolist(), (numbers[low] - self.a_base[longer]).tolist(), strict=True):
            out[at] = own[self.a_bytes[a][-length:]] if length else byte[self.a_bytes[a][-1:]]
        return out

    @cached_property
    def digits(self) -> np.ndarray:
        """Decimal digits of each id, with zero bytes before them and one place after."""
        most = max(len(self.a_length), len(self.b_length))
        return np.frombuffer(b"".join(str(i).encode().rjust(_DIGITS - 1, b"\0") + b"\0" for i in range(most)), np.uint8).reshape(most, _DIGITS)


_loaded: dict[tuple[str, str, int], Vocabularies] = {}


def _worker(*key) -> Vocabularies:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabularies(*key)
    return _loaded[key]


def gallop(driver: np.ndarray, longer: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of the rising values ``driver`` its rank in the rising list ``longer``: how many are less.

    Each search begins at its place ``start``, doubles its step away from there until the value is
    between two places, and halves the range that is left."""
    n = len(longer)
    if not n:
        return np.zeros(len(driver), np.int64)
    start = np.clip(start, 0, n - 1)
    up = longer[start] < driver
    low, high = np.where(up, start, -1), np.where(up, n, start)  # longer[low] < value <= longer[high]
    rest, step = np.arange(len(driver)), 1
    while len(rest):
        rising = up[rest]
        probe = start[rest] + np.where(rising, step, -step)
        inside = (probe >= 0) & (probe < n)
        rest, rising, probe = rest[inside], rising[inside], probe[inside]
        less = longer[probe] < driver[rest]
        low[rest[less]] = probe[less]
        high[rest[~less]] = probe[~less]
        rest = rest[less == rising]
        step *= 2
    rest = np.flatnonzero(high - low > 1)
    while len(rest):
        middle = (low[rest] + high[rest]) >> 1
        less = longer[middle] < driver[rest]
        low[rest[less]] = middle[less]
        high[rest[~less]] = middle[~less]
        rest = rest[high[rest] - low[rest] > 1]
    return high


def common_ends(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ends in either list; ``a_first`` and ``b_first`` say where each document's tokens begin."""
    swap = len(a_end) > len(b_end)
    driver, longer, first, far = (b_end, a_end, b_first, a_first) if swap else (a_end, b_end, a_first, b_first)
    start = np.arange(len(driver)) + np.repeat(far[:-1] - first[:-1], np.diff(first))
    rank = gallop(driver, longer, start)
    hit = np.flatnonzero((rank < len(longer)) & (longer[np.minimum(rank, len(longer) - 1)] == driver)) if len(longer) else np.zeros(0, np.int64)
    return (rank[hit], hit) if swap else (hit, rank[hit])


class Aligned:
    """The tokens, groups and links of some texts."""

    def __init__(self, vocabularies: Vocabularies, texts: list[str | None]):
        v = self.vocabularies = vocabularies
        a = [np.frombuffer(x, "<u4") for x in v.a.encode_bytes(texts)]
        b = [np.frombuffer(x, "<u4") for x in v.b.encode_bytes(texts)]
        none = np.zeros(0, "<u4")
        for i, t in enumerate(texts):
            if not t or (b[i] == _STRANGE).any() or not (v.a_length[a[i]].sum() == v.b_length[b[i]].sum() == len(t.encode("utf-8", "replace")) + 1):
                a[i] = b[i] = none
        self.a, self.b = np.concatenate([none, *a]).astype(np.int64), np.concatenate([none, *b]).astype(np.int64)
        self.a_first, self.b_first = (np.cumsum([0] + [len(x) for x in y]) for y in (a, b))
        # one space of offsets for all texts: each has the same bytes on either side
        self.a_end, self.b_end = np.cumsum(v.a_length[self.a]), np.cumsum(v.b_length[self.b])
        self.at_a, self.at_b = common_ends(self.a_end, self.b_end, self.a_first, self.b_first)
        self.first = np.searchsorted(self.at_a, self.a_first)  # each text's first group
        self.links = v.number(self.a[self.at_a], self.b[self.at_b]).astype("<u4")

    def written(self) -> tuple[bytes, np.ndarray]:
        """All groups as ``a1,a2|b1;...`` and where each text's groups begin, the end after the last."""
        groups_before_a = np.searchsorted(self.at_a, np.arange(len(self.a)))
        groups_before_b = np.searchsorted(self.at_b, np.arange(len(self.b)))
        a_in, b_in = self.at_a + 1, self.at_b + 1  # tokens up to the end of each group
        to_a = np.arange(len(self.a)) + np.append(0, b_in)[groups_before_a]
        to_b = np.arange(len(self.b)) + a_in[groups_before_b]
        cells = np.zeros((len(self.a) + len(self.b), _DIGITS), np.uint8)
        cells[to_a], cells[to_b] = self.vocabularies.digits[self.a], self.vocabularies.digits[self.b]
        cells[:, -1] = ord(",")
        cells[to_a[self.at_a], -1] = ord("|")
        cells[to_b[self.at_b], -1] = ord(";")
        flat = cells.ravel()
        widths = (cells != 0).sum(1)
        ends = np.append(0, np.cumsum(widths))
        return flat[flat != 0].tobytes(), ends[self.a_first + self.b_first]

    def digests(self) -> list[str]:
        data, edges = self.written()
        edges = edges.tolist()
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edges, edges[1:])]


def _some(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[str | None]]]:
    texts = [x if isinstance(x, str) else None for x in batch["text"]]
    for x, y in chunks([t or "" for t in texts], TOGETHER):
        yield batch.iloc[x:y], texts[x:y]


def links(docs: DataFrame, a_path: str, b_path: str, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, groups_sha256 and the numbers of its links' pairs (32 bits each)."""
    vocabularies = Vocabularies(a_path, b_path, cache_entries)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, texts in _some(batch):
                got = Aligned(vocabularies, texts)
                groups, first = np.diff(got.first), got.first.tolist()
                yield pd.DataFrame(
                    {
                        "doc_id": rows["doc_id"].astype("Int64").to_numpy(), "n_a": np.diff(got.a_first), "n_b": np.diff(got.b_first),
                        "n_groups": groups, "n_links": groups, "groups_sha256": got.digests(),
                        "pairs": [got.links[x:y].tobytes() for x, y in zip(first, first[1:])],
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(apply, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary")


def _lists(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pd.Series:
    return pd.Series([ids[x:y].tolist() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=object)


def groups(docs: DataFrame, a_path: str, b_path: str, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """The groups themselves: doc_id, group, bytes [start, end) of the text with its space, ids of both sides
    and their ranges [a_from, a_to) and [b_from, b_to) in the document."""
    vocabularies = Vocabularies(a_path, b_path, cache_entries)
    schema = "doc_id long, `group` long, start long, end long, a_from long, a_to long, b_from long, b_to long, a_ids array<int>, b_ids array<int>"

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, texts in _some(batch):
                got = Aligned(vocabularies, texts)
                of = np.repeat(np.arange(len(texts)), np.diff(got.first))
                a_to, b_to = got.at_a + 1, got.at_b + 1
                a_from, b_from = np.append(0, a_to)[:-1], np.append(0, b_to)[:-1]
                end = got.a_end[got.at_a]
                base = np.append(0, got.a_end)[got.a_first[:-1]][of]
                yield pd.DataFrame(
                    {
                        "doc_id": rows["doc_id"].astype("Int64").to_numpy()[of], "group": np.arange(len(of)) - got.first[:-1][of],
                        "start": np.append(0, end)[:-1] - base, "end": end - base,
                        "a_from": a_from - got.a_first[of], "a_to": a_to - got.a_first[of], "b_from": b_from - got.b_first[of], "b_to": b_to - got.b_first[of],
                        "a_ids": _lists(got.a, a_from, a_to), "b_ids": _lists(got.b, b_from, b_to),
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(apply, schema)


def pair_counts(linked: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """pair (its number) and n, over all links: a row for each pair and task goes to the sum."""
    most = vocabularies.pairs

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(most, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["pairs"]), "<u4"), minlength=most)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"pair": seen, "n": total[seen]})

    return linked.select("pairs").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Per document the numbers of tokens, groups and links, of links whose pair is the best of its B id,
    the sum of its links' counts, and the digest of its groups."""
    vocabularies = Vocabularies(a_path, b_path, cache_entries)
    linked = materialize(links(docs, a_path, b_path, cache_entries), "links")
    found = pair_counts(linked, vocabularies).toPandas()  # at most vocabularies.pairs rows
    counts, best = np.zeros(vocabularies.pairs, np.int64), np.zeros(vocabularies.pairs, bool)
    if len(found):
        pair, n = found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
        second = vocabularies.second(pair)
        highest = np.zeros(len(vocabularies.b.bytes), np.int64)
        np.maximum.at(highest, second, n)
        counts[pair], best[pair] = n, n == highest[second]
    sent = docs.sparkSession.sparkContext.broadcast((counts, best))

    @F.pandas_udf("n_best long, count_sum long")
    def looked_up(pairs: pd.Series) -> pd.DataFrame:
        count, top = sent.value
        got = [np.frombuffer(x, "<u4") for x in pairs]
        return pd.DataFrame({"n_best": [int(top[x].sum()) for x in got], "count_sum": [int(count[x].sum()) for x in got]})

    return linked.withColumn("looked", looked_up("pairs")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "looked.n_best", "looked.count_sum", "groups_sha256")
