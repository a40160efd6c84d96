"""Pairs of aspect and sentiment from generated texts of several loose forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlume.functions import text as X

# fixed values: sentiment words and what they stand for, words that make no aspect, and words that make none alone
SENTIMENTS = {
    "pos": "positive", "positive": "positive", "good": "positive", "great": "positive", "excellent": "positive", "neg": "negative", "negative": "negative",
    "bad": "negative", "poor": "negative", "terrible": "negative", "neu": "neutral", "neutral": "neutral", "mixed": "neutral",
}
STOP = (
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "to", "of", "in", "on", "for", "with", "it", "this", "that",
    "during", "very", "really", "just", "too", "also", "so", "as", "at", "from", "by", "be", "been", "being",
)
JUNK_ALONE = ("excellent", "good", "bad", "great", "phone", "product", "service", "delivery")
EDGE_SIGNS = " -•*:\t\"'"
LONGEST, MOST_WORDS = 255, 8

QUOTED = r'(?U)"([^"]+)"\s*:\s*"([^"]+)"'
LINE_END = r"[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
BULLET = r"(?U)^[\-*•\d).\s]+"


def sentiment_of(x: Column) -> Column:
    """The sentiment that the letters of ``x`` name, null if none."""
    return F.try_element_at(F.create_map(*(F.lit(w) for pair in SENTIMENTS.items() for w in pair)), F.regexp_replace(F.lower(x), "[^a-z]", ""))


def aspect_of(x: Column) -> Column:
    """``x`` with single spaces and no signs at its ends, null if it makes no aspect."""
    name = F.substring(F.trim(X.squash(x), F.lit(EDGE_SIGNS)), 1, LONGEST)
    words = F.filter(F.split(F.lower(name), " "), lambda w: w != "")
    alone = (F.size(words) == 1) & words[0].isin(*JUNK_ALONE)
    return F.when(F.exists(words, lambda w: ~w.isin(*STOP)) & ~alone & (F.size(words) <= MOST_WORDS), name)


def _sound(sides: Column) -> Column:
    """Of array<array<string>> with two sides each, those that name an aspect and a sentiment."""
    pairs = F.transform(sides, lambda s: F.struct(aspect_of(s[0]).alias("aspect"), sentiment_of(s[1]).alias("sentiment")))
    return F.filter(pairs, lambda p: p["aspect"].isNotNull() & p["sentiment"].isNotNull())


def _line_sides(line: Column) -> Column:
    bare = F.regexp_replace(line, BULLET, "")
    cuts = F.when(bare.contains("|"), F.split(bare, r"\|", 2)).when(bare.contains(":"), F.split(bare, ":", 2))
    return cuts.when(bare.contains("-"), F.split(bare, "-", 2))


def pairs_of(text: Column) -> Column:
    """array<struct<aspect, sentiment>> by the first of these forms that fits: ``"aspect": "sentiment"`` anywhere, ``aspect: sentiment``
    between commas, an object whose ``pairs`` are listed, and else lines, with or without bullets, cut at ``|``, ``:`` or ``-``.

    The listed form fits if it can be read, even without a sound pair; the two before only with one. Null and empty texts have no pairs.
    """
    quoted = F.arrays_zip(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)).alias("l"), F.regexp_extract_all(text, F.lit(QUOTED), F.lit(2)).alias("r"))
    mapped = _sound(F.transform(quoted, lambda q: F.array(q["l"], q["r"])))
    chunks = F.filter(F.split(text, r"(?U)\s*,\s*"), lambda c: c.contains(":"))
    plain = _sound(F.transform(chunks, lambda c: F.split(c, ":", 2)))
    listed = F.from_json(text, "pairs array<struct<aspect:string,sentiment:string>>")["pairs"]
    by_line = F.filter(F.transform(F.split(text, LINE_END), _line_sides), lambda s: s.isNotNull())
    first = F.when(F.size(mapped) > 0, mapped).when(F.size(plain) > 0, plain)
    return first.when(listed.isNotNull(), _sound(F.transform(listed, lambda p: F.array(p["aspect"], p["sentiment"])))).otherwise(_sound(by_line))


def parsed(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, aspect, sentiment): the pairs of each text, those that differ in case alone once, as first written; place counts from 0
    over all that the text holds. Repeated keys count as one text."""
    flat = texts.select(key, F.posexplode(pairs_of(F.col(text))).alias("place", "p")).select(key, "place", "p.*")
    first = flat.groupBy(key, F.lower("aspect").alias("same"), "sentiment").agg(F.min(F.struct("place", "aspect")).alias("first"))
    return first.select(key, "first.place", "first.aspect", "sentiment")
