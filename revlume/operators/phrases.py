"""Phrases of a reviewed pattern store in texts: each text is read once by one automaton of all phrases.

The automaton (Aho-Corasick) holds the phrases as they are, their forms and their single words.
Where a phrase stands is decided by what it found first of each: the phrase itself anywhere in the
text, else a form of it between word limits, else enough of its words, with a window around them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlume.plans.shared import STORE_ROWS

# fixed values: words that say nothing alone, the least length of one that does, and how far a window reaches
STOP_WORDS = frozenset("the and was for with that this but not are from they have been will your very when into some".split())
WORD_LENGTH, REACH = 3, 24
#: Texts whose matches a worker holds at a time: a text may have one of each pattern.
TEXTS = 128
# fixed values: forms that stand for each other
KEEPS = ("keeps ", "keep ", "kept ")
DOES_NOT = (" does not ", " doesn't ")

STORE = ["pattern_id", "phrase", "aspect_canonical", "latent_family", "status", "domain_scope", "domains", "confidence", "precision_estimate"]
HITS = "pattern_id string, matched_pattern string, matched_text string, start_char int, end_char int, aspect_canonical string, latent_family string, confidence double, match_type string"


def forms(phrase: str) -> list[str]:
    """Other forms of a phrase in lower case, in order."""
    out = {phrase}
    if phrase.startswith(KEEPS[0]):
        out.update(other + phrase[len(KEEPS[0]) :] for other in KEEPS[1:])
    out.update(phrase.replace(a, b) for a, b in (DOES_NOT, DOES_NOT[::-1]))
    return sorted(out)


def telling_words(phrase: str) -> list[str]:
    return [w for w in re.findall(r"[a-z0-9']+", phrase) if len(w) >= WORD_LENGTH and w not in STOP_WORDS]


def words_needed(n: int) -> int:
    """Both of two words, all but one of more; a single word is never enough."""
    return max(2, n - 1 if n > 2 else n)


class Automaton:
    """All phrases of a store, to be found in texts."""

    def __init__(self, patterns: list[dict]):
        import ahocorasick

        self.patterns = patterns
        self.needles: dict[str, int] = {}
        self.whole, self.form, self.word = defaultdict(list), defaultdict(list), defaultdict(list)
        self.needed: dict[int, int] = {}
        for p, pattern in enumerate(patterns):
            phrase = (pattern["phrase"] or "").strip()
            low = phrase.lower()
            if not low:
                continue
            self.whole[self._needle(low)].append((p, len(phrase)))
            for rank, other in enumerate(forms(low)):
                self.form[self._needle(other)].append((rank, p))
            words = telling_words(low)
            if words:
                self.needed[p] = words_needed(len(words))
                for w in words:  # a word that the phrase repeats counts each time
                    self.word[self._needle(w)].append(p)
        self.trie = ahocorasick.Automaton()
        for needle, i in self.needles.items():
            self.trie.add_word(needle, (i, len(needle)))
        if self.needles:
            self.trie.make_automaton()

    def _needle(self, text: str) -> int:
        return self.needles.setdefault(text, len(self.needles))

    def spans(self, text: str) -> list[tuple[int, int, int, str, str]]:
        """(pattern, start, end, words of the text, kind) of each pattern that stands in the text, in the order of the store."""
        if not text or not self.needles:
            return []
        low = text.lower()
        anywhere: dict[int, int] = {}
        apart: dict[int, tuple[int, int]] = {}
        joins = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        for last, (i, size) in self.trie.iter(low):
            start = last - size + 1
            anywhere.setdefault(i, start)
            if i not in apart and not joins(start - 1) and not joins(last + 1):
                apart[i] = (start, last + 1)
        found: dict[int, tuple[int, int, str, str]] = {}
        for i, start in anywhere.items():
            for p, size in self.whole.get(i, ()):
                found[p] = (start, start + size, text[start : start + size], "exact")
        best: dict[int, tuple[int, int, int]] = {}
        parts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (start, end) in apart.items():
            for rank, p in self.form.get(i, ()):
                if p not in found:
                    best[p] = min(best.get(p, (rank, start, end)), (rank, start, end))
            for p in self.word.get(i, ()):
                if p not in found:
                    parts[p].append((start, end))
        for p, (_, start, end) in best.items():
            found[p] = (start, end, text[start:end], "lemma")
        for p, places in parts.items():
            if p not in found and len(places) >= self.needed[p]:
                start, end = self._window(text, min(s for s, _ in places), max(e for _, e in places))
                found[p] = (start, end, text[start:end].strip(), "phrase_window")
        return [(p, *found[p]) for p in sorted(found)]

    @staticmethod
    def _window(text: str, start: int, end: int) -> tuple[int, int]:
        """From the last space before to the first space after, as far as a window reaches."""
        first, last = max(0, start - REACH), min(len(text), end + REACH)
        before, after = text.rfind(" ", first, start), text.find(" ", end, last)
        return (first if before < 0 else before + 1), (last if after < 0 else after)

    def matches(self, text: str, domain: str | None, resolve: bool) -> list[tuple]:
        """Hits of the patterns that hold for the domain; with ``resolve`` the surest first, those that overlap one before
        left out."""
        domain = (domain or "").strip().lower()
        out = []
        for p, start, end, words, kind in self.spans(text):
            own = self.patterns[p]
            if own["domain_scope"] == "domain_scoped" and domain not in {(x or "").lower() for x in own["domains"] or ()}:
                continue
            confidence = max(own["confidence"] or 0.0, own["precision_estimate"] or 0.0)
            out.append((own["pattern_id"], own["phrase"], words, start, end, own["aspect_canonical"], own["latent_family"], confidence, kind))
        if not resolve:
            return out
        taken: list[tuple[int, int]] = []
        kept = []
        for hit in sorted(out, key=lambda h: (-h[7], h[3], h[4])):
            at = bisect_right(taken, (hit[3], len(text) + 1))
            if (at and taken[at - 1][1] > hit[3]) or (at < len(taken) and taken[at][0] < hit[4]):
                continue
            taken.insert(at, (hit[3], hit[4]))
            kept.append(hit)
        return kept


def found_in(store: Automaton, batches: Iterator[pd.DataFrame], resolve: bool) -> Iterator[pd.DataFrame]:
    """Matches in batches of id, domain and text, of TEXTS texts at a time."""
    names = ["id", *(x.split(" ")[0] for x in HITS.split(", "))]
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            some = batch.iloc[at : at + TEXTS]
            found = [(i, *hit) for i, domain, text in zip(some["id"], some["domain"], some["text"], strict=True) if isinstance(text, str) for hit in store.matches(text, domain if isinstance(domain, str) else None, resolve)]
            yield pd.DataFrame(found, columns=names)


def match_patterns(texts: DataFrame, patterns: DataFrame, resolve: bool = True) -> DataFrame:
    """Matches of promoted patterns in texts (id, domain, text): with ``resolve`` those that stand beside each other, else all.

    ``patterns`` (STORE) is a reviewed store of at most STORE_ROWS promoted patterns with distinct ids, in whose order ties
    stand; more, or an id twice, are refused. It goes to all tasks; texts stay where they are. Null and empty texts and
    phrases match nothing; a pattern whose domains are null holds for no domain if it is scoped.
    """
    rows = [r.asDict() for r in patterns.where("status = 'promoted'").select(*STORE).orderBy("pattern_id").limit(STORE_ROWS + 1).collect()]
    if len(rows) > STORE_ROWS:
        raise ValueError(f"more than {STORE_ROWS} patterns")
    if len({r["pattern_id"] for r in rows}) < len(rows) or any(not (r["pattern_id"] or "").strip() for r in rows):
        raise ValueError("patterns need ids of their own")
    sent = texts.sparkSession.sparkContext.broadcast(rows)
    kind = texts.schema["id"].dataType.simpleString()

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from found_in(Automaton(sent.value), batches, resolve)

    return texts.select("id", F.col("domain").cast("string").alias("domain"), "text").where("id is not null").mapInPandas(match, f"id {kind}, {HITS}")
