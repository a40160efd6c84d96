"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes,
inside a word and at its edges); a linear softmax gives the language. Both are
trained together by stochastic gradient descent in numpy on a bounded sample,
then a temperature and a rejection level are fitted on a part that was held
back. As all is linear, a trained model is one table of n-gram scores, which the
tasks apply to whole texts.

Sample: at most about SAMPLE_PER_LANGUAGE labelled documents of a language, by a
hash of their ids; of up to LANGUAGES languages, the most frequent first.

Nulls and edges: a null text, or one without a letter, is ``und`` with score 0
and counts as rejected; so is every text when nothing could be learned; rows
with a null lang teach nothing; equal texts get equal results; columns besides
doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import chunks

SAMPLE_PER_LANGUAGE = 700
#: Longer texts teach nothing, so that the sample's size is bounded; they are predicted whole.
SAMPLE_CHARS = 50_000
LANGUAGES = 256
BUCKETS, DIMENSIONS = 1 << 15, 16
EPOCHS, RATE = 6, 0.5
#: The share of accepted texts that are right, on the part held back, at the rejection level.
PRECISION = 0.995
UNKNOWN = "und"

_GRAMS = (2, 3, 4)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket, language: score of an n-gram
    bias: np.ndarray
    temperature: float
    reject_below: float


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, and how many each text has."""
    # a text ends in white space, so no n-gram reaches into the next one
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(parts) + b"   ", np.uint8)
    flat = np.where(data <= 0x20, 0x20, data).astype(np.uint32)
    space = flat == 0x20
    n, size = len(flat) - 3, np.array([len(x) for x in parts])
    text = np.repeat(np.arange(len(parts)), size)
    found, owner = [], []
    h, inner = flat[:n].copy(), np.zeros(n, bool)
    for k in range(2, max(_GRAMS) + 1):
        h = h * np.uint32(0x01000193) + flat[k - 1 : n + k - 1]
        if k > 2:
            inner |= space[k - 2 : n + k - 2]
        keep = ~inner & ~(space[:n] & space[k - 1 : n + k - 1])
        found.append(((h[keep] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int32))
        owner.append(text[:n][keep])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(parts))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def learner(doc_id: Column) -> Column:
    """Whether a document may teach."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, may_teach: Column) -> Model | None:
    """Train on the documents that may teach; None if they hold no language."""
    usable = docs.where(may_teach & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "lang", "text")
    counted = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counted:
        return None
    share = F.create_map(*(F.lit(x) for r in counted for x in (r["lang"], min(1.0, SAMPLE_PER_LANGUAGE / r["count"]))))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    rows = usable.where(place < F.coalesce(share[F.col("lang")], F.lit(0.0))).mapInPandas(_features, "lang string, draw long, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"]))
    return _train(rows, sorted(r["lang"] for r in counted))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True):
            found, _ = _buckets([text])
            if len(found):
                b, c = np.unique(found, return_counts=True)
                out.append((lang, 0 if pd.isna(doc) else int(doc) * 2654435761 % (1 << 31), b.astype("<i4").tobytes(), c.astype("<i4").tobytes()))
        yield pd.DataFrame(out, columns=["lang", "draw", "buckets", "counts"])


def _train(rows: list, languages: list[str]) -> Model | None:
    data = [(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4"), languages.index(r["lang"])) for r in rows]
    data = [(b, (c / c.sum()).astype(np.float32), y) for b, c, y in data]
    if not data:
        return None
    held, taught = data[::5], [x for i, x in enumerate(data) if i % 5] or data
    rng = np.random.default_rng(11)
    emb = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, at = EPOCHS * len(taught), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(taught)):
            b, c, y = taught[i]
            rate = RATE * (1 - at / steps)
            at += 1
            x = c @ emb[b]
            error = _softmax(x @ out + bias)
            error[y] -= 1
            back = out @ error
            out -= rate * np.outer(x, error)
            bias -= 0.05 * rate * error
            emb[b] -= (rate * len(b)) ** 0.5 * c[:, None] * back * 4
    table = emb @ out
    logits = np.array([c @ table[b] + bias for b, c, _ in held])
    truth = np.array([y for *_, y in held])
    losses = {t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in 2.0 ** np.arange(-4, 4.5, 0.5)}
    temperature = float(min(losses, key=losses.get))
    best = _softmax(logits / temperature)
    score, right = best.max(1), best.argmax(1) == truth
    order = np.argsort(-score, kind="stable")
    precise = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    level = float(score[order[precise[-1]]]) if len(precise) else 1.0
    return Model(languages, table, bias, temperature, level)


def score(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The best language and its probability for each text."""
    logits = np.zeros((len(texts), len(model.languages)))
    for a, b in chunks(texts, 1 << 19):
        found, sizes = _buckets(texts[a:b])
        ends = np.cumsum(sizes)
        for j in range(len(model.languages)):
            sums = np.concatenate([[0.0], np.cumsum(model.table[found, j], dtype=np.float64)])
            logits[a:b, j] = (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1) + model.bias[j]
    p = _softmax(logits / model.temperature)
    best = p.argmax(1)
    return [model.languages[k] for k in best], p[np.arange(len(texts)), best]


def identify(docs: DataFrame, may_teach: Column) -> DataFrame:
    """doc_id, lang_pred, score and rejected (score below the fitted level) of each row."""
    model = fit(docs, may_teach)
    letter = F.col("text").rlike(r"\p{L}")

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["letter"].fillna(False).astype(bool)
            lang, points = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if model and known.any():
                lang[known], points[known] = score(model, batch["text"][known].tolist())
            level = model.reject_below if model else 1.0
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": lang, "score": points, "rejected": (lang == UNKNOWN) | (points < level)})

    return docs.select(F.col("doc_id").cast("long"), "text", letter.alias("letter")).mapInPandas(predict, "doc_id long, lang_pred string, score double, rejected boolean")
