"""Pattern matches against each phrase looked for by itself."""

import random
import re

import pytest

from revlume.operators import phrases as P

STORE = "pattern_id string, phrase string, aspect_canonical string, latent_family string, status string, domain_scope string, domains array<string>, confidence double, precision_estimate double"


def pattern(i, phrase, status="promoted", scope="global", domains=("laptop",), confidence=0.5, precision=0.0):
    return {"pattern_id": i, "phrase": phrase, "aspect_canonical": "a", "latent_family": "f", "status": status, "domain_scope": scope, "domains": list(domains), "confidence": confidence, "precision_estimate": precision}


def alone(phrase, text):
    """One phrase in one text: regular expressions instead of the automaton."""
    phrase, low = phrase.strip(), text.lower()
    if not phrase or not text:
        return None
    if phrase.lower() in low:
        at = low.index(phrase.lower())
        return at, at + len(phrase), text[at : at + len(phrase)], "exact"
    for form in P.forms(phrase.lower()):
        m = re.search(rf"(?<!\w){re.escape(form)}(?!\w)", low)
        if m:
            return m.start(), m.end(), text[m.start() : m.end()], "lemma"
    words = P.telling_words(phrase.lower())
    hits = [m for m in (re.search(rf"(?<!\w){re.escape(w)}(?!\w)", low) for w in words) if m]
    if words and len(hits) >= (max(2, len(words)) if len(words) <= 2 else len(words) - 1):
        start, end = min(m.start() for m in hits), max(m.end() for m in hits)
        while start > 0 and text[start - 1] != " " and min(m.start() for m in hits) - start < 24:
            start -= 1
        top = end
        while end < len(text) and text[end] != " " and end - top < 24:
            end += 1
        return start, end, text[start:end].strip(), "phrase_window"
    return None


def window_as_written(text, start, end):
    low, high = max(0, start - 24), min(len(text), end + 24)
    a, b = text.rfind(" ", low, start), text.find(" ", end, high)
    return (low if a == -1 else a + 1), (high if b == -1 else b)


def test_spans_are_those_of_each_phrase_alone():
    rng = random.Random(2)
    words = ["keeps", "keep", "kept", "crashing", "battery", "does", "not", "doesn't", "last", "the", "app", "launch", "x", "under", "load", "screen,", "(fan)"]
    store = [pattern(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(120)] + [pattern("blank", " "), pattern("cased", "Keeps Crashing")]
    machine = P.Automaton(store)
    kinds = set()
    for _ in range(400):
        text = " ".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 14)))
        got = {p: tuple(rest) for p, *rest in machine.spans(text)}
        wanted = {i: hit for i, s in enumerate(store) for hit in [alone(s["phrase"], text)] if hit}
        assert {p: x for p, x in got.items() if x[3] != "phrase_window"} == {p: x for p, x in wanted.items() if x[3] != "phrase_window"}
        assert set(got) == set(wanted)
        for p, (start, end, own, kind) in got.items():
            kinds.add(kind)
            if kind == "phrase_window":
                hits = [m for m in (re.search(rf"(?<!\w){re.escape(w)}(?!\w)", text.lower()) for w in P.telling_words(store[p]["phrase"].lower())) if m]
                assert (start, end) == window_as_written(text, min(m.start() for m in hits), max(m.end() for m in hits)) and own == text[start:end].strip()
    assert kinds == {"exact", "lemma", "phrase_window"}


def test_known_sentences(spark):
    texts = spark.createDataFrame([(1, "laptop", "This app keeps crashing on launch."), (2, "x", "It kept crashing on launch."), (3, "laptop", "The screen is bright, but the battery doesn't last through lunch."), (4, None, ""), (5, "laptop", None), (None, "x", "keeps crashing")], "id long, domain string, text string")
    store = spark.createDataFrame([pattern("p1", "keeps crashing", precision=0.87), pattern("p2", "battery does not last", scope="domain_scoped", confidence=0.9), pattern("p3", "crashing on launch", confidence=0.6), pattern("p4", "launch", status="candidate"), pattern("p5", "app", scope="domain_scoped", domains=())], STORE)
    got = {(r["id"], r["pattern_id"]): (r["start_char"], r["end_char"], r["matched_text"], r["match_type"], r["confidence"]) for r in P.match_patterns(texts, store).collect()}
    assert got == {(1, "p1"): (9, 23, "keeps crashing", "exact", 0.87), (2, "p1"): (3, 16, "kept crashing", "lemma", 0.87), (3, "p2"): (30, 50, "battery doesn't last", "lemma", 0.9)}
    every = P.match_patterns(texts, store, resolve=False).collect()
    assert {(r["id"], r["pattern_id"]) for r in every} == {*got, (1, "p3"), (2, "p3")}


def test_overlaps_are_resolved_like_one_by_one():
    rng = random.Random(7)
    words = ["a1b", "c2d", "e3f", "g4h"]
    store = [pattern(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), confidence=rng.choice([0.5, 0.7, 0.9])) for i in range(30)]
    machine = P.Automaton(store)
    for _ in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        kept = []
        for hit in sorted(machine.matches(text, "", False), key=lambda h: (-h[7], h[3], h[4])):
            if all(hit[4] <= k[3] or hit[3] >= k[4] for k in kept):
                kept.append(hit)
        assert machine.matches(text, "", True) == kept


def test_stores_that_are_refused(spark):
    texts = spark.createDataFrame([], "id int, domain string, text string")
    with pytest.raises(ValueError):
        P.match_patterns(texts, spark.createDataFrame([pattern("p", "x"), pattern("p", "y")], STORE))
    assert P.match_patterns(texts, spark.createDataFrame([], STORE)).collect() == []
