"""Toxicity by a subsequence string kernel machine with Nystroem landmarks.

The kernel of two words counts their common subsequences of SUBSEQUENCE
characters that span at most SPAN, each weighed by DECAY to the power of the
spans in both words, and divides by the norms that words of these lengths have:
gaps and inserted characters lower it but do not hide a word, and words of one
stem are alike whatever they end in. A word's features are its kernels with the
landmarks times the inverse square root of the landmarks' own kernel matrix
(Nystroem). A linear support vector machine on these features is trained on
labelled sentences: first every word of a sentence bears its label, then, in
ROUNDS, a toxic document stands for the worst words of its worst sentences, also
shown with gaps and inserted characters, and a clean sentence for its worst
word. A document is judged by its WORST worst words (different ones); Platt
scaling over them, on documents that the machine was not trained on and on the
toxic ones of these with their words disguised, gives a probability.

The machine is linear in subsequences, so its weights are folded into one table
of subsequences and a word costs the same whatever the number of landmarks.

Words are runs without white space, in lower case, without marks at their ends.
A word with marks between letters is also scored by its letters alone, and so
are runs of single letters; a word longer than WORD_CHARS is scored in windows
of WINDOW characters. Whole texts are scored. Characters outside the ALPHABET
most frequent letters and digits match nothing.

The machine is trained on a sample: at most about SAMPLE_TOXIC toxic and
SAMPLE_CLEAN other labelled documents, of at most SAMPLE_CHARS characters, by a
hash of their ids.

Nulls and edges: null and empty texts have the score of a text without any
word; so has every text, at half, when the labels hold no toxic or no clean
document; null labels teach nothing; equal texts get equal scores; rows with
equal doc_id are scored one by one; an empty table gives no rows. Other columns
pass where asked for, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import chunks
from .workers import freed, give_back

SUBSEQUENCE, DECAY, SPAN = 3, 0.7, 8
LANDMARKS, COMMON_LANDMARKS = 200, 40
#: Kernel above which a word is too like a landmark to be another.
ALIKE = 0.85
WORD_CHARS, WINDOW, STEP, ALPHABET = 24, 16, 4, 61
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 900, 1800, 16_000
#: One of so many documents of the sample is kept for calibration.
CALIBRATION = 3
PENALTY = 1e-4
#: Rounds in which the worst words of documents and sentences are chosen again.
ROUNDS = 4
#: Words that the machine is first trained on.
FIRST_WORDS = 30_000
#: Worst words that a document stands for.
WORST = 2
#: How much of a clean word's weight the next round keeps.
KEPT = 0.3
CUTOFF = 0.7
#: Characters of text that are scored at a time.
TEXT_CHARS = 1 << 20

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_SPACE, _MARK, _OTHER, _FIRST = 0, 1, 2, 3
_K = 64


def learner(doc_id: Column) -> Column:
    """Whether a label may teach."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


@lru_cache(maxsize=4)
def _classes(alphabet: str) -> np.ndarray:
    """The class of every code point: white space, mark, other letter or digit, or its place in the alphabet."""
    out = np.full(0x110000, _MARK, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace():
            out[c] = _SPACE
        elif x.isalnum():
            out[c] = _OTHER
    for i, x in enumerate(alphabet):
        out[ord(x)] = _FIRST + i
    return out


def units(texts: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is scored of texts together: classes of characters, and starts, lengths and text of each unit among them."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _classes(alphabet)[codes]
    ends_of_texts = np.cumsum([len(t) + 1 for t in lowered])
    letter = codes >= _OTHER
    # words, cut at their first and last letter
    space = codes == _SPACE
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    starts, ends = edge[::2], edge[1::2]
    at = np.flatnonzero(letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return codes, none, none, none
    low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
    some = high > low
    low, high = low[some], high[some]
    starts, ends, letters = at[low], at[high - 1] + 1, high - low
    owner = np.searchsorted(ends_of_texts, starts, side="right")
    lengths = ends - starts
    out = [(starts, lengths, owner)]
    # letters alone of words with marks in between, and of runs of single letters
    alone = codes[at]
    marked = np.flatnonzero((letters < lengths) & (letters >= SUBSEQUENCE))
    out.append((len(codes) + low[marked], letters[marked], owner[marked]))
    single = np.concatenate([[False], lengths == 1, [False]])
    turn = np.flatnonzero(np.diff(single.astype(np.int8)))
    first, last = turn[::2], turn[1::2]
    same = last - first >= SUBSEQUENCE
    first, last = first[same], last[same]
    if len(first):
        same = owner[first] == owner[last - 1]
        first, last = first[same], last[same]
        out.append((len(codes) + low[first], last - first, owner[first]))
    starts, lengths, owner = (np.concatenate(x) for x in zip(*out, strict=True))
    long = lengths > WORD_CHARS
    if long.any():
        # windows STEP apart, the last one ends with its word
        number = -(-(lengths[long] - WINDOW) // STEP) + 1
        turn = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        cut = np.minimum(turn * STEP, np.repeat(lengths[long] - WINDOW, number))
        starts = np.concatenate([starts[~long], np.repeat(starts[long], number) + cut])
        owner = np.concatenate([owner[~long], np.repeat(owner[long], number)])
        lengths = np.concatenate([lengths[~long], np.full(len(cut), WINDOW)])
    return np.concatenate([codes, alone]), starts, lengths, owner


def _norms() -> np.ndarray:
    """The norm of a word of each length whose characters differ."""
    out = np.ones(WORD_CHARS + 1)
    for n in range(SUBSEQUENCE, WORD_CHARS + 1):
        out[n] = sum((n - s + 1) * (s - 2) * DECAY ** (2 * s) for s in range(3, min(SPAN, n) + 1)) ** 0.5
    return out


NORMS = _norms()


def _triples(n: int) -> Iterator[tuple[int, int, int]]:
    for i in range(n - 2):
        for j in range(i + 1, min(n - 1, i + SPAN - 1)):
            for k in range(j + 1, min(n, i + SPAN)):
                yield i, j, k


def _by_length(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units of one length, SUBSEQUENCE or more: which, and their characters, a row for each place."""
    order = np.argsort(lengths, kind="stable")
    bound = np.searchsorted(lengths[order], np.arange(SUBSEQUENCE, WORD_CHARS + 2))
    for n in range(SUBSEQUENCE, WORD_CHARS + 1):
        for at in range(bound[n - SUBSEQUENCE], bound[n - SUBSEQUENCE + 1], block):
            which = order[at : min(at + block, bound[n - SUBSEQUENCE + 1])]
            yield which, codes[starts[which] + np.arange(n)[:, None]].astype(np.int32)


def subsequences(word: bytes) -> dict[int, float]:
    """The weights of a word's subsequences, normalised; those with characters that match nothing are left out."""
    out: dict[int, float] = {}
    for i, j, k in _triples(len(word)):
        if min(word[i], word[j], word[k]) >= _FIRST:
            key = (word[i] * _K + word[j]) * _K + word[k]
            out[key] = out.get(key, 0.0) + DECAY ** (k - i + 1) / NORMS[len(word)]
    return out


def kernels(words: list[bytes], others: list[bytes], root: np.ndarray | None = None) -> np.ndarray:
    """Kernels of words with others, times ``root`` if given."""
    rows: dict[int, int] = {}
    maps = [subsequences(w) for w in others]
    for m in maps:
        for key in m:
            rows.setdefault(key, len(rows) + 1)
    table = np.zeros((len(rows) + 1, len(others)), np.float32)
    place = np.zeros(_K**3, np.int32)
    for n, m in enumerate(maps):
        for key, value in m.items():
            table[rows[key], n] = value
    for key, row in rows.items():
        place[key] = row
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros((len(words), len(others)), np.float32)
    for which, c in _by_length(codes, starts, lengths, 1 << 13):
        own = np.zeros((len(which), len(others)), np.float32)
        for i, j, k in _triples(len(c)):
            row = place[(c[i] * _K + c[j]) * _K + c[k]]
            hit = np.flatnonzero(row)
            if len(hit):
                own[hit] += np.float32(DECAY ** (k - i + 1)) * table[row[hit]]
        own = own / np.float32(NORMS[len(c)])
        out[which] = own if root is None else own @ root.astype(np.float32)
    return out


def fold(landmarks: list[bytes], weights: np.ndarray) -> np.ndarray:
    """One table of subsequences for all landmarks with their weights."""
    table = np.zeros(_K**3)
    for w, a in zip(landmarks, weights, strict=True):
        for key, value in subsequences(w).items():
            table[key] += a * value
    return table.astype(np.float32)


def folded_margins(table: np.ndarray, bias: float, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Margins of units, those of their kernels with the folded landmarks."""
    got = np.full(len(starts), bias, np.float32)
    for which, c in _by_length(codes, starts, lengths):
        own = np.zeros(len(which), np.float32)
        for i in range(len(c) - 2):
            for j in range(i + 1, min(len(c) - 1, i + SPAN - 1)):
                pair = (c[i] * _K + c[j]) * _K
                for k in range(j + 1, min(len(c), i + SPAN)):
                    own += np.float32(DECAY ** (k - i + 1)) * table[pair + c[k]]
        got[which] += own / np.float32(NORMS[len(c)])
    return got


@dataclass
class Model:
    alphabet: str
    landmarks: list[bytes]
    weights: np.ndarray  # of subsequences, all landmarks together
    bias: float
    slopes: np.ndarray  # of a text's worst words
    shift: float

    def margins(self, texts: list[str]) -> np.ndarray:
        """The margins of each text's worst words."""
        codes, starts, lengths, owner = units(texts, self.alphabet)
        return worst(folded_margins(self.weights, self.bias, codes, starts, lengths), owner, len(texts), self.bias)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        own = [t if isinstance(t, str) else "" for t in texts]
        parts = [self.margins(own[a:b]) for a, b in chunks(own, TEXT_CHARS)]
        return sigmoid(np.concatenate([np.zeros((0, WORST)), *parts]) @ self.slopes + self.shift)


def worst(margins: np.ndarray, owner: np.ndarray, texts: int, least: float) -> np.ndarray:
    """For each text the WORST largest margins; equal ones, as of equal words, count once."""
    out = np.full((texts, WORST), least)
    order = np.argsort(owner, kind="stable")
    margins, owner = margins[order], owner[order]
    for n in range(WORST):
        if not len(owner):
            break
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first], n] = np.maximum.reduceat(margins, first)
        less = margins < out[owner, n] - 1e-5
        margins, owner = margins[less], owner[less]
    return np.maximum(out, least)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _svm(x: np.ndarray, bad: np.ndarray, good: np.ndarray, block: int = 4096) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the support vectors (few features, so
    that each step is a small linear system). A row weighs ``bad`` as a toxic and ``good`` as a clean case."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(30):
        left, right = PENALTY * np.eye(len(w)), np.zeros(len(w))
        for at in range(0, len(x), block):
            part = np.hstack([x[at : at + block], np.ones((len(x[at : at + block]), 1))]).astype(np.float64)
            margin = part @ w
            for y, cost in ((1.0, bad[at : at + block]), (-1.0, good[at : at + block])):
                hit = (cost > 0) & (y * margin < 1)
                near, c = part[hit], cost[hit]
                left += (near * c[:, None]).T @ near
                right += y * (c @ near)
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-5):
            break
        w = new if not w.any() else (w + new) / 2
    return w[:-1], float(w[-1])


def _platt(margins: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes (none below zero) and shift of the logistic curve, by damped Newton steps with smoothed targets."""
    yes, no = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (yes + 1) / (yes + 2), 1 / (no + 2))
    used = list(range(margins.shape[1]))
    while True:
        x = np.hstack([margins[:, used], np.ones((len(margins), 1))])
        w = np.zeros(x.shape[1])
        loss = lambda w: (np.logaddexp(0, x @ w) - target * (x @ w)).sum() + 1e-3 * (w[:-1] ** 2).sum()  # noqa: E731, B023
        for _ in range(60):
            p = sigmoid(x @ w)
            ridge = np.append(np.full(len(used), 2e-3), 1e-9)
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - target) + ridge * w)
            while loss(w - step) > loss(w) and abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
        if (w[:-1] >= 0).all() or len(used) == 1:
            slopes = np.zeros(margins.shape[1])
            slopes[used] = np.maximum(w[:-1], 1e-3)
            return slopes, float(w[-1])
        used.remove(used[int(np.argmin(w[:-1]))])


def _disguised(word: bytes, turn: int) -> list[bytes]:
    """A word with a gap, and with one and two inserted characters; where, goes by turns."""
    if not 4 <= len(word) <= WORD_CHARS - 2:
        return []
    at = 1 + turn % (len(word) - 1)
    two = 1 + (turn * 7 + 3) % (len(word) - 1)
    letter, other = bytes([_OTHER]), bytes([_FIRST + turn % 20])
    return [word[:at] + bytes([_MARK]) + word[at:], word[:at] + other + word[at:], word[:two] + letter + other + word[two:]]


def _unlike(words: list[bytes], most: int, chosen: list[bytes]) -> list[bytes]:
    """The first words that are unlike each other and those chosen."""
    found: list[bytes] = []
    some = words[: 8 * most]
    if not some:
        return found
    gram = kernels(some, some + chosen)
    norm = np.sqrt(np.maximum(np.diagonal(gram), 1e-9))
    own = np.concatenate([norm, np.sqrt(np.maximum([kernels([c], [c])[0, 0] for c in chosen], 1e-9))])
    alike = gram / (norm[:, None] * own[None])
    taken = list(range(len(some), len(some) + len(chosen)))
    for i, w in enumerate(some):
        if len(found) == most:
            break
        if not taken or alike[i, taken].max() < ALIKE:
            found.append(w)
            taken.append(i)
    return found


def _train(rows: list[tuple[int, bool, str]]) -> Model | None:
    toxic = np.array([t for _, t, _ in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    letters = Counter()
    for *_, text in rows:
        letters.update(text.lower())
    alphabet = "".join(sorted(sorted((c for c in letters if c.isalnum()), key=lambda c: (-letters[c], c))[:ALPHABET]))
    # sentences, their words, and their documents
    texts, doc_of = [], []
    for n, (*_, text) in enumerate(rows):
        own = [s for s in _SENTENCE.split(text) if s]
        texts += own
        doc_of += [n] * len(own)
    known: dict[bytes, int] = {}
    found, own = [], []
    for first, last in chunks(texts, TEXT_CHARS):
        codes, starts, lengths, owner = units(texts[first:last], alphabet)
        data = codes.tobytes()
        found.append(np.array([known.setdefault(data[s : s + n], len(known)) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)], np.int64))
        own.append(owner + first)
    word, sentence = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found, own))
    del found, own
    vocabulary = list(known)
    doc = np.array(doc_of, np.int64)[sentence] if len(sentence) else sentence
    # documents of a word, toxic and clean
    pairs = np.unique(doc * len(vocabulary) + word)
    of_doc, of_word = pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary))
    bad = np.bincount(of_word[toxic[of_doc]], minlength=len(vocabulary)).astype(np.float64)
    good = np.bincount(of_word[~toxic[of_doc]], minlength=len(vocabulary)).astype(np.float64)
    fits = np.array([SUBSEQUENCE < len(w) <= 16 for w in vocabulary], bool)
    ratio = (bad + 0.05) / (good * toxic.sum() / (~toxic).sum() + bad + 1.0)
    order = [i for i in np.lexsort((np.arange(len(vocabulary)), -bad, -ratio)).tolist() if fits[i] and bad[i] > 0]
    landmarks = _unlike([vocabulary[i] for i in order], LANDMARKS, [])
    common = [i for i in np.lexsort((np.arange(len(vocabulary)), -good)).tolist() if fits[i] and good[i] > 0]
    landmarks += _unlike([vocabulary[i] for i in common], COMMON_LANDMARKS, landmarks)
    if not landmarks:
        return None
    gram = kernels(landmarks, landmarks)
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    own_lengths = np.array([len(w) for w in vocabulary], np.int64)
    own_starts, own_codes = np.cumsum(own_lengths) - own_lengths, np.frombuffer(b"".join(vocabulary), np.uint8)

    taught = np.array([i % CALIBRATION for i in _turns(toxic)]) > 0  # others calibrate
    if not (taught & toxic).any() or not (taught & ~toxic).any():
        taught[:] = True
    use = taught[doc]
    pairs = np.unique(doc[use] * len(vocabulary) + word[use])
    of_doc, of_word = pairs // len(vocabulary), pairs % len(vocabulary)
    bad = np.bincount(of_word[toxic[of_doc]], minlength=len(vocabulary)).astype(np.float64)
    good = np.bincount(of_word[~toxic[of_doc]], minlength=len(vocabulary)).astype(np.float64)
    # at first all words bear their documents' labels: of rare words a bounded number, by turns
    common_first = np.lexsort((np.arange(len(vocabulary)) * 2654435761 % (1 << 32), -(bad + good)))[:FIRST_WORDS]
    weights, bias = _fit([(vocabulary[i], bad[i], good[i]) for i in common_first.tolist()], landmarks, root)
    against = np.zeros(len(vocabulary))
    for turn in range(ROUNDS):
        margin = folded_margins(fold(landmarks, weights), bias, own_codes, own_starts, own_lengths)
        # a clean sentence's worst word; a toxic document's worst words of different sentences
        top = np.lexsort((word, margin[word], sentence))
        last = np.flatnonzero(np.diff(sentence[top], append=-1))
        sent_doc, sent_word = doc[top][last], word[top][last]
        clean = taught[sent_doc] & ~toxic[sent_doc]
        against = np.bincount(sent_word[clean], minlength=len(vocabulary)) + KEPT * against
        mine = taught[sent_doc] & toxic[sent_doc]
        md, mw = sent_doc[mine], sent_word[mine]
        by = np.lexsort((mw, -margin[mw], md))
        md, mw = md[by], mw[by]
        first = np.flatnonzero(np.diff(md, prepend=-1))
        place = np.arange(len(md)) - np.repeat(first, np.diff(np.append(first, len(md))))
        bad = np.bincount(mw[place < WORST], minlength=len(vocabulary))
        shown = [(vocabulary[i], bad[i], 0.0) for i in np.flatnonzero(bad).tolist()]
        shown += [(d, n / 3, 0.0) for turns, (w, n, _) in enumerate(shown) for d in _disguised(w, turns + turn)]
        shown += [(vocabulary[i], 0.0, against[i]) for i in np.flatnonzero(against).tolist()]
        weights, bias = _fit(shown, landmarks, root)
    table = fold(landmarks, weights)
    margin = folded_margins(table, bias, own_codes, own_starts, own_lengths)
    points = worst(margin[word], doc, len(rows), bias)
    held = ~taught if (~taught & toxic).any() and (~taught & ~toxic).any() else taught
    # the held toxic documents once more, with their worst words disguised
    veiled, veils = _veiled(margin[word], doc, vocabulary, word, held & toxic)
    told = kernels(veiled, landmarks) @ weights.astype(np.float32) + bias if veiled else np.zeros(0)
    again = worst(told, veils, len(rows), bias)[held & toxic]
    slopes, shift = _platt(np.vstack([points[held], again]), np.concatenate([toxic[held], np.ones(len(again), bool)]))
    return Model(alphabet, landmarks, table, bias, slopes, shift)


def _veiled(margins: np.ndarray, doc: np.ndarray, vocabulary: list[bytes], word: np.ndarray, wanted: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Disguised forms of the worst words of the documents wanted, and their documents."""
    order = np.lexsort((word, -margins, doc))
    order = order[wanted[doc[order]]]
    words, docs, seen = [], [], {}
    for w, d in zip(word[order].tolist(), doc[order].tolist(), strict=True):
        own = seen.setdefault(d, set())
        if len(own) < WORST and w not in own:
            own.add(w)
            forms = _disguised(vocabulary[w], len(words) + d)
            words += forms[(d + len(own)) % 3 :][:1] or [vocabulary[w]]
            docs.append(d)
    return words, np.array(docs, np.int64)


def _turns(toxic: np.ndarray) -> list[int]:
    """Each document's number among those of its label."""
    seen = [0, 0]
    out = []
    for t in toxic.tolist():
        out.append(seen[int(t)])
        seen[int(t)] += 1
    return out


def _fit(cases: list[tuple[bytes, float, float]], landmarks: list[bytes], root: np.ndarray) -> tuple[np.ndarray, float]:
    """The machine of words with weights as toxic and as clean ones (each label weighs half): weights of landmarks and bias."""
    x = kernels([w for w, *_ in cases], landmarks, root)
    bad, good = np.array([b for _, b, _ in cases], np.float64), np.array([g for *_, g in cases], np.float64)
    weights, bias = _svm(x, bad / max(bad.sum(), 1e-9) / 2, good / max(good.sum(), 1e-9) / 2)
    return root @ weights, bias


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on labels that may teach; None without both classes."""
    marks = labels.where(learner(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE_TOXIC / counts[1]))).otherwise(F.lit(min(1.0, SAMPLE_CLEAN / counts[0])))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) / float(1 << 20) < share)
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= SAMPLE_CHARS)
    # bounded by the sample's documents and characters (one text for each doc_id), so it may be broadcast and collected
    rows = small.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return _train(sorted((r["doc_id"], r["toxic"] == 1, r["text"]) for r in rows))


def score(docs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """doc_id, score and predicted of each row, and the columns named."""
    model = fit(docs, labels)
    kept = [docs.schema[c] for c in columns]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = model.score(batch["text"]) if model else np.full(len(batch), 0.5)
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": points, "predicted": (points >= CUTOFF).astype(np.int32)})
            for f in kept:
                out[f.name] = batch[f.name]
            yield out

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(F.col("doc_id").cast("long"), "text", *(c for c in columns if c not in ("doc_id", "text"))).mapInPandas(freed(apply), "doc_id long, score double, predicted int" + extra)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns alone."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts) if model else np.full(len(texts), 0.5))
        give_back()

    return docs.where(probability("text") < CUTOFF)
