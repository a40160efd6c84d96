"""The seven steps of the dictionary: by hand-made cases, and against a plain version over generated items."""

import random

import pytest

from revlume.operators import mapping as M
from revlume.operators.similar import weighted_ratios

NAMES = [("generic", "price", "value"), ("generic", "battery", "battery"), ("generic", "screen quality", "display"), ("laptop", "battery", "battery_life"), ("laptop", "hinge", "build"), ("laptop", "speaker", "audio"), ("restaurant", "food", "food_quality")]
MODIFIERS = [("generic", "battery", "weak", "battery"), ("generic", "screen", "dim", "display"), ("laptop", "battery", "weak", "battery_life"), ("laptop", "battery", "hot", "heat"), ("laptop", "laptop", "portable", "portability"), ("laptop", "screen", "bright", "display")]
BROAD = [("generic", "customer service"), ("generic", "delivery"), ("laptop", "performance"), ("laptop", "customer support")]
ITEM = "id long, domain string, source_type string, aspect_canonical string, aspect_raw string, aspect_anchor string, modifier_terms array<string>, latent_family string"


@pytest.fixture(scope="module")
def mapped(spark):
    names, modifiers, broad = spark.createDataFrame(NAMES, "domain string, key string, canonical string"), spark.createDataFrame(MODIFIERS, "domain string, anchor string, modifier string, canonical string"), spark.createDataFrame(BROAD, "domain string, label string")

    def run(items, mode="full"):
        df = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], ITEM)
        out = M.map_aspects(df, names, modifiers, broad, mode)
        assert out.columns == [*df.columns, "canonical", "mapping_source", "confidence", "matched_key", "ambiguous", "layers", "scope"]
        return [tuple(r)[8:] for r in out.orderBy("id").collect()]

    return run


def item(domain, raw=None, anchor=None, mods=(), family=None, source="explicit", canonical=None):
    return domain, source, canonical, raw, anchor, list(mods) if mods is not None else None, family


def test_steps(mapped):
    items = [
        item("laptop", "x", source="implicit_learned", canonical="own"), item("laptop", "price", source="implicit_learned", canonical="unknown"),
        item("Laptop", "battery weak", " Battery", [" WEAK"]), item("laptop", "battery", "battery", ["hot", "weak"]), item("restaurant", "battery", "battery", ["weak"]), item("laptop", "screen", "screen", ["dim"]),
        item("laptop", " Screen Quality "), item("laptop", "the hinge", "hinge"), item("laptop", "my battery thing"), item("shop", "my battery thing"), item(None, "food"),
        item("laptop", "customer suport"), item("restaurant", "customer servce"), item("laptop", "speekers"), item("laptop", "zzzz", family="Performance"), item("shop", "qqqq", family="performance"), item("laptop", None, family="hinge"), item("laptop", "qqqq", family="custmer support"),
        item("laptop", None, None, None), item("laptop", " ", " ", [None, ""], " "), item(None, None, family="unknown"),
    ]
    got = mapped(items)
    assert got[:11] == [
        ("own", "trusted_learned", 1.0, None, False, ["learned_store"], "learned_store"), ("value", "exact_phrase", 1.0, "price", False, ["generic"], "generic"),
        ("battery_life", "anchor_modifier", 0.85, "battery.weak", False, ["generic", "domain_specific"], "generic+domain_specific"), ("battery_life", "anchor_modifier", 0.7, "battery.hot", True, ["domain_specific"], "domain_specific"),
        ("battery", "anchor_modifier", 0.85, "battery.weak", False, ["generic"], "generic"), ("display", "anchor_modifier", 0.85, "screen.dim", False, ["generic"], "generic"),
        ("display", "exact_phrase", 1.0, "screen quality", False, ["generic"], "generic"), ("build", "anchor_only", 0.8, "hinge", False, ["domain_specific"], "domain_specific"),
        ("battery_life", "token_fallback", 0.55, "battery", False, ["generic", "domain_specific"], "generic+domain_specific"), ("battery", "token_fallback", 0.55, "battery", False, ["generic"], "generic"), (None, "no_match", 0.0, None, False, [], "unmapped_internal"),
    ]
    assert [g[:2] for g in got[11:]] == [
        ("customer support", "fuzzy_canonical"), ("customer service", "fuzzy_canonical"), ("audio", "fuzzy_alias"), ("performance", "latent_family_inference"), (None, "no_match"), ("build", "latent_family_map"), ("customer support", "fuzzy_family_inference"),
        (None, "no_match"), (None, "no_match"), (None, "no_match"),
    ]
    # a label that is no key belongs to the item's domain; a similar key to those that know it
    assert got[11][5:] == (["domain_specific"], "domain_specific") and got[13][5:] == (["domain_specific"], "domain_specific") and got[17][2] < 0.45


def test_modes(mapped):
    items = [item("laptop", "battery weak", "battery", ["weak"]), item("laptop", "hinge"), item("laptop", "x", source="implicit_learned", canonical="own"), item("laptop", "customer service")]
    for mode in ("generic_only", "generic_plus_learned"):
        got = mapped(items, mode)
        assert [g[:2] for g in got] == [("battery", "anchor_modifier"), (None, "no_match"), ("own", "trusted_learned"), ("customer service", "fuzzy_canonical")]
        assert [g[6] for g in got] == ["generic", "unmapped_internal", "learned_store", "generic"]


def plainly(x):
    """One item by the stated steps, without joins."""
    domain, source, canonical, raw, anchor, mods, family = x
    if source == "implicit_learned" and canonical and canonical != "unknown":
        return canonical, "trusted_learned", 1.0
    at = (domain or "generic").lower()
    keys = {k: c for d, k, c in NAMES if d == "generic"} | {k: c for d, k, c in NAMES if d == at}
    mod = {(a, m): c for d, a, m, c in MODIFIERS if d == "generic"} | {(a, m): c for d, a, m, c in MODIFIERS if d == at}
    labels = [b for d, b in BROAD if d == at] or [b for d, b in BROAD if d == "generic"]
    raw, anchor, family = ((v or "").strip().lower() for v in (raw, anchor, family))
    found = {mod[anchor, m.strip().lower()] for m in mods or [] if m and (anchor, m.strip().lower()) in mod}
    if found:
        return min(found), "anchor_modifier", 0.7 if len(found) > 1 else 0.85
    if raw in keys:
        return keys[raw], "exact_phrase", 1.0
    if anchor in keys:
        return keys[anchor], "anchor_only", 0.8
    for t in raw.split():
        if len(t) > 2 and t in keys:
            return keys[t], "token_fallback", 0.55

    def best(query, among, least):
        among = sorted(among)
        scores = list(weighted_ratios([query] * len(among), among))
        i = max(range(len(among)), key=lambda j: (scores[j], -j))
        return (among[i], scores[i]) if scores[i] >= least - 1e-12 else None

    if raw and (hit := best(raw, labels, 0.85)):
        return hit[0], "fuzzy_canonical", hit[1]
    if raw and (hit := best(raw, keys, 0.8)):
        return keys[hit[0]], "fuzzy_alias", 0.9 * hit[1]
    if family and family != "unknown":
        if family in labels:
            return family, "latent_family_inference", 0.55
        if family in keys:
            return keys[family], "latent_family_map", 0.5
        if hit := best(family, labels, 0.9):
            return hit[0], "fuzzy_family_inference", 0.45 * hit[1]
    return None, "no_match", 0.0


def test_equals_the_plain_version(mapped):
    rng = random.Random(3)
    words = ["battery", "batery", "screen", "hinge", "hinges", "price", "speaker", "food", "customer", "service", "servise", "delivery", "performance", "perform", "quality", "dim", "weak", "ab", "xyz", "support"]
    some = lambda n: " ".join(rng.choices(words, k=rng.randint(1, n)))
    items = [item(rng.choice(["laptop", "Laptop", "restaurant", "shop", None, ""]), rng.choice([some(3), some(1), None, ""]), rng.choice([some(1), None]), rng.choices(["weak", "dim", "hot", None, "Bright", ""], k=rng.randint(0, 3)), rng.choice([some(2), None, "unknown"]), rng.choice(["explicit", "implicit_learned"]), rng.choice([None, "unknown", "", "own"])) for _ in range(600)]
    items += items[:50]
    got = mapped(items)
    want = [plainly(x) for x in items]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))
    assert len({g[1] for g in got}) >= 9


def test_empty_and_too_large(spark, mapped, monkeypatch):
    assert mapped([]) == []
    monkeypatch.setattr(M, "STORE_ROWS", 2)
    with pytest.raises(ValueError, match="more than 2 rows"):
        mapped([item("laptop", "price")])
