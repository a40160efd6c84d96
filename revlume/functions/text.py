"""Text functions of the opinion model, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry a polarity, matched as substrings
POSITIVE = ("great", "good", "amazing", "excellent", "fast", "long", "happy", "love", "perfect")
NEGATIVE = ("bad", "poor", "terrible", "slow", "short", "dim", "lag", "broken", "worst", "hate")
SENTENCE_END = r"[.!?]"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def squash(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def singular(token: Column) -> Column:
    n = F.length(token)
    return F.when(token.endswith("ies") & (n > 4), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y"))).when(token.endswith("s") & ~token.endswith("ss") & (n > 3), F.substring(token, F.lit(1), n - 1)).otherwise(token)


def normalize(x: Column) -> Column:
    """Lower case, separators as spaces, no trailing ``quality``, tokens in the singular."""
    plain = squash(F.translate(F.lower(x), "_-", "  "))
    plain = F.regexp_replace(plain, " quality$", "")
    return F.array_join(F.transform(F.split(plain, " "), singular), " ")


def aspect_key(x: Column) -> Column:
    return F.replace(normalize(x), F.lit(" "), F.lit("_"))


def aspect_label(x: Column) -> Column:
    return F.initcap(normalize(x))


def canonical_aspect(canonical: Column, normalized: Column, cluster: Column, raw: Column) -> Column:
    """The label of the first that is not blank."""
    return aspect_label(F.coalesce(*(blank_to_null(c) for c in (canonical, normalized, cluster, raw)), F.lit("unknown")))


def slug(x: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("unknown"))


def stable_id(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws("|", *(F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, 16))


def tokens(x: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)))


def overlap_share(a: Column, b: Column) -> Column:
    """The share of a's tokens that b has."""
    return F.when(F.size(tokens(a)) > 0, F.size(F.array_intersect(tokens(a), tokens(b))).cast("double") / F.size(tokens(a))).otherwise(0.0)


def is_token_subset(a: Column, b: Column) -> Column:
    return (F.size(tokens(a)) > 0) & (F.size(F.array_except(tokens(a), tokens(b))) == 0)


def keyword_polarity(x: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """positive, negative or neutral, by how many of the words a text contains anywhere."""
    def polarity(low: Column) -> Column:
        hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        return F.sign(hits(positive) - hits(negative))

    # the text is lowered once, and its words are counted once
    return let(let(F.lower(F.coalesce(x, F.lit(""))), polarity), lambda s: F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral"))


def polarity_hint(a: Column, b: Column) -> Column:
    """One sentiment of two: equal, else mixed if they oppose, else the one that is not neutral."""
    opposed = F.array_contains(F.array(a, b), "positive") & F.array_contains(F.array(a, b), "negative")
    return F.when(a == b, a).when(opposed, "mixed").when(a == "neutral", b).otherwise(a)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(lengths: Column, first: Column) -> Column:
    """Where parts that follow each other begin: sums of the lengths before each, from ``first`` on.

    The sums are taken in blocks of the root of the number of parts, so that a text of n parts takes about n to the 1.5
    steps and no array is copied for each part.
    """
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)

    def within(block: Column, base: Column) -> Column:
        return F.transform(block, lambda _, i: base + total(F.slice(block, 1, i)))

    def blocks(own: Column, width: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(own) - 1) / width).cast("int")), lambda b: F.slice(own, b * width + 1, width))
        return let(parts, lambda p: let(F.transform(p, total), lambda sums: F.flatten(F.transform(p, lambda block, b: let(first + total(F.slice(sums, 1, b)), lambda base: within(block, base))))))

    return let(lengths, lambda own: F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(let(F.ceil(F.sqrt(F.size(own))).cast("int"), lambda width: blocks(own, width))))


def sentence_spans(x: Column, end: str = SENTENCE_END) -> Column:
    """array<struct<sentence, start, stop>>: sentences with their places, without white space around."""
    # the parts follow each other without a gap, after stops at the beginning
    parts = F.regexp_extract_all(x, F.lit(rf"(?s)[^.!?]+{end}*"), F.lit(0))
    first = F.length(F.regexp_extract(x, rf"^{end}*", 0))

    def span(p: Column, at: Column) -> Column:
        own, begin = F.trim(p), (at + F.length(p) - F.length(F.ltrim(p))).cast("int")
        return F.struct(own.alias("sentence"), begin.alias("start"), (begin + F.length(own)).cast("int").alias("stop"))

    spans = let(parts, lambda all_: F.zip_with(all_, starts(F.transform(all_, F.length), first), span))
    return F.filter(spans, lambda s: F.length(s["sentence"]) > 0)


def phrase_span(x: Column, phrase: Column) -> Column:
    """[start, end] of a phrase in any case, else [-1, -1]."""
    span = lambda at: F.when((at > 0) & (F.length(phrase) > 0), F.array(at - 1, at - 1 + F.length(phrase))).otherwise(F.array(F.lit(-1), F.lit(-1)))
    return let(F.instr(F.lower(x), F.lower(phrase)), span)


def joint_aspect(label: Column, separator: str = "__") -> Column:
    return F.substring_index(label, separator, 1)
