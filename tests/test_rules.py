"""Rules by hand-made fixtures and plain versions: novelty, mining, memory, graphs, joins of vectors, curves, episodes."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from revlume.operators import episodes as EP
from revlume.operators import etl as E
from revlume.operators import graphs as G
from revlume.operators import vectors as V


def test_novelty(spark):
    rows = [("battery_life", True, 1.0, "none", True), ("screen_eye_strain", False, 0.35, "none", True), ("hinge_sparks", False, 0.0, "none", True), (" Unknown", True, 1.0, "none", True), (None, False, 0.9, None, True), ("x", True, 0.74, "none", True), ("x", True, 0.75, "provisional", False), ("x", False, 0.9, "unmapped", True), ("x", False, 0.9, "exact", False), ("x", True, 0.0, "exact", True)]
    df = spark.createDataFrame(rows, "name string, known boolean, c double, source string, ok boolean")
    got = [tuple(r["n"]) for r in df.select(E.novelty(*(F.col(c) for c in df.columns)).alias("n")).collect()]
    assert [g[:2] for g in got] == [("known", 0.0), ("boundary", 0.6), ("novel", 0.9), ("boundary", 0.4), ("boundary", 0.4), ("boundary", 0.6), ("known", 0.0), ("boundary", 0.6), ("boundary", 0.5), ("novel", 1.0)]


def test_mined_and_validated_patterns(spark):
    rows = [("It keeps crashing and keeps crashing", "a", None), ("they keep crashing", "b", None), ("It stopped working. does not  charge", "a", None), ("does not charge", "a", None), ("slow under load", "a", None), ("no", "a", "Does  Not charge"), (None, None, None), ("x quality", "a", "Quality"), ("quality", "b", "quality")]
    found = E.mined_patterns(spark.createDataFrame(rows, "text string, domain string, symptom_phrase string"))
    got = {r["phrase"]: (r["pattern_id"], r["support_count"], r["domains"], r["evidence_valid_count"], r["domain_entropy"]) for r in found.collect()}
    assert got == {"keeps crashing": ("mined_keeps_crashing", 3, ["a", "b"], 3, 1.0), "does not charge": ("mined_does_not_charge", 3, ["a"], 1, 0.0), "quality": ("mined_quality", 2, ["a", "b"], 2, 1.0)}
    judged = {r["phrase"]: (r["status"], r["reason_codes"], r["domain_scope"]) for r in E.validated_patterns(found, ("quality",), support=3).collect()}
    assert judged == {"keeps crashing": ("promoted", [], "global"), "does not charge": ("review_queue", ["invalid_evidence", "low_precision"], "domain_scoped"), "quality": ("review_queue", ["insufficient_support", "broad_phrase"], "global")}


def plain_memory(rows, promote):
    """Evidence by evidence, as it comes."""
    entries = {}
    for name, review, domain, context, cue, _ in sorted(rows, key=lambda r: (r[5], r[1], r[3])):
        e = entries.setdefault((name or "").strip().lower(), {"support": 0, "reviews": set(), "domains": set(), "cue": None, "examples": [], "status": None, "canonical": None})
        key = (name or "").strip().lower()
        e["support"] += 1
        e["reviews"].add(review)
        e["domains"].add(domain)
        e["cue"] = cue or e["cue"]
        if len(e["examples"]) < 5:
            e["examples"].append(context)
        known = {x["canonical"] for x in entries.values() if x["canonical"]}
        parent = next((p for p, hints in E.PARENT_HINTS.items() if any(h in key for h in hints)), None)
        if not key or key in E.BAD_NAMES:
            e["status"] = "rejected"
        elif promote and len(e["reviews"]) >= 3 and e["support"] >= 5:
            e["canonical"] = key.replace(" ", "_")
            e["status"] = "review_queue" if e["canonical"] in known else "promoted"
        elif e["support"] >= 5 and len(e["reviews"]) >= 3 and len({c.lower().strip() for c in e["examples"]}) >= 2 and key not in E.BROAD_OBJECTS and (parent or e["cue"] in E.STRONG_CUES):
            e["status"] = "review_queue"
        else:
            e["status"] = "candidate"
    return {k: (e["support"], len(e["reviews"]), len(e["domains"]), e["cue"], e["examples"], e["status"]) for k, e in entries.items()}


def test_memory_is_that_of_evidence_one_by_one(spark):
    statuses = Counter()
    for seed in range(4):
        rng = random.Random(seed)
        names = ["Battery", "battery ", "screen size", "screen_size", "thing", "", None, "hinge", "fit of lid", "computer", "lone", "late x"]
        weights = [3, 3, 2, 2, 1, 1, 1, 1, 2, 2, 0.3, 1]
        rows = [(rng.choices(names, weights)[0], rng.randint(1, 5), rng.choice("de"), rng.choice(["a", "A ", "b"]), rng.choice(["failure_event", "unknown", "", None]), seq) for seq in range(rng.choice([14, 40, 90]))]
        rows += [("lens", review, "d", "x", None, 100 + review) for review in (1, 1, 2, 2, 3)]  # enough with its last evidence
        df = spark.createDataFrame(rows, "aspect_raw string, review_id long, domain string, context string, cue_type string, seq long").repartition(3)
        for promote in (False, True):
            got = {r["aspect"]: (r["support"], r["reviews"], r["domains"], r["cue"], r["examples"], r["status"]) for r in E.memory(df, promote).collect()}
            assert got == plain_memory(rows, promote)
            statuses.update(g[-1] for g in got.values())
    assert set(statuses) == {"rejected", "candidate", "review_queue", "promoted"}
    assert E.memory(df.limit(0)).collect() == []


def test_components_are_named_by_their_shortest(spark):
    edges = spark.createDataFrame([("battery life", "batteries"), ("batteries", "zz"), ("a long name", "another"), ("x", "x")], "a string, b string")
    assert {r["node"]: r["root"] for r in G.components(edges).collect()} == {"battery life": "zz", "batteries": "zz", "zz": "zz", "a long name": "another", "another": "another", "x": "x"}


def test_pagerank_stops_at_its_tolerance(spark):
    edges = [("a", "b", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("c", "d", 1.0)]
    nodes = "abcd"
    w = np.zeros((4, 4))
    for a, b, x in edges:
        w[nodes.index(a), nodes.index(b)] = w[nodes.index(b), nodes.index(a)] = x
    share, rank = w / w.sum(1, keepdims=True), np.full(4, 0.25)
    while True:
        new = 0.15 / 4 + 0.85 * rank @ share
        far, rank = np.abs(new - rank).sum(), new
        if far < 4e-6:
            break
    got = {r["node"]: r["rank"] for r in G.pagerank(spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
    assert np.abs(np.array([got[n] for n in nodes]) - rank).max() < 1e-12


def test_similar_pairs_are_those_of_all(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[7] = vectors[3]
    cosine = vectors @ vectors.T
    wanted = {(a, b) for a in range(60) for b in sorted((j for j in range(60) if j != a and cosine[a, j] >= 0.3), key=lambda j: (-cosine[a, j], j))[:4] if a < b}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, v array<double>")
    assert {(r["a"], r["b"]) for r in V.similar_pairs(df, 0.3, 4).collect()} == wanted
    assert V.similar_pairs(df.limit(0), 0.3, 4).collect() == []


def test_curves(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9) / 10, rng.random() < 0.4) for _ in range(80)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    p = sum(y for _, y in rows)
    at = {t: (sum(y for s, y in rows if s >= t), sum(not y for s, y in rows if s >= t)) for t in {s for s, _ in rows}}
    got = {r["score"]: (r["precision"], r["recall"]) for r in V.precision_recall(df, "s", "y").collect()}
    assert all(abs(got[t][0] - a / (a + b)) < 1e-12 and abs(got[t][1] - a / p) < 1e-12 for t, (a, b) in at.items()) and len(got) == len(at)
    assert abs(V.fpr_at_recall(df, "s", "y", 0.8).first()[0] - min(b / (80 - p) for a, b in at.values() if a >= 0.8 * p)) < 1e-12
    steps, last, area = sorted(at, reverse=True), 0, 0.0
    for t in steps:
        area += (at[t][0] - last) / p * at[t][0] / sum(at[t])
        last = at[t][0]
    assert abs(V.average_precision(df, "s", "y").first()[0] - area) < 1e-12
    scores = np.array([s for s, _ in rows])
    for r in V.risk_coverage(df, "s", "y", [0.1, 0.33, 0.5, 1.0]).collect():
        threshold = np.quantile(scores, r["quantile"])
        inside = [y for s, y in rows if s <= threshold + 1e-12]
        assert abs(r["threshold"] - threshold) < 1e-12 and abs(r["coverage"] - len(inside) / 80) < 1e-12 and abs(r["risk"] - (1 - sum(inside) / len(inside))) < 1e-12


EXAMPLE = "id long, label string, parent long, `group` string, weight double, hardness double, domain string"


def test_episodes_have_their_sizes_and_share_nothing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abcdef"), i // 2, f"g{i % 40}" if i % 4 == 0 else None, rng.choice([None, 0.5, 3.0]), rng.random(), rng.choice(["x", "y", None])) for i in range(300)]
    rows += [(900, "rare", 900, None, 1.0, 0.0, "x"), (None, "a", 1, None, 1.0, 0.0, "x"), (901, None, 1, None, 1.0, 0.0, "x")]
    df = spark.createDataFrame(rows, EXAMPLE)
    similar = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.7)], "a string, b string, cosine double")
    for alike in (None, similar):
        got = EP.build(df, 3, 2, 3, 8, seed=7, similar=alike).collect()
        by = {r[0]: r for r in rows}
        assert Counter(r["episode"] for r in got) == {e: 15 for e in range(1, 9)}
        roles = defaultdict(lambda: defaultdict(set))
        for (e, label, role), n in Counter((r["episode"], r["label"], r["role"]) for r in got).items():
            assert n == {"support": 2, "query": 3}[role] and label != "rare"
        for r in got:
            assert by[r["id"]][1] == r["label"]
            roles[r["episode"]][by[r["id"]][3] or by[r["id"]][2]].add(r["role"])
        assert all(len(x) == 1 for e in roles.values() for x in e.values())
        again = EP.build(df.repartition(5), 3, 2, 3, 8, seed=7, similar=alike).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sorted(map(tuple, EP.build(df, 3, 2, 3, 8, seed=8).collect())) != sorted(map(tuple, got))
    assert EP.build(df.limit(0), 3, 2, 3, 8).collect() == [] and EP.build(df, 20, 2, 3, 8).collect() == []


def test_hard_labels_follow_their_pivot(spark):
    labels = spark.createDataFrame([(x, 9, 1.0) for x in "abcdefgh"], "label string, parents long, weight double")
    similar = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.9), ("e", "f", 0.9), ("g", "h", 0.9)], "a string, b string, cosine double")
    drafts = spark.range(1, 101).withColumnRenamed("id", "episode")
    pairs = defaultdict(set)
    for r in EP.choose_labels(labels, drafts, 2, 3, similar, hard_ratio=1.0, top=1).collect():
        pairs[r["episode"]].add(r["label"])
    assert all("".join(sorted(p)) in ("ab", "cd", "ef", "gh") for p in pairs.values()) and len(pairs) == 100


def test_heavy_labels_come_more_often(spark):
    labels = spark.createDataFrame([("a", 9, 3.0), ("b", 9, 1.0)], "label string, parents long, weight double")
    got = Counter(r["label"] for r in EP.choose_labels(labels, spark.range(1, 1001).withColumnRenamed("id", "episode"), 1, 3).collect())
    assert 690 < got["a"] < 810


def test_spans_of_long_texts(spark):
    """Sentences and clauses stand where their spans say, in texts of no part, of few and of very many."""
    import time

    from revlume.functions import text as X
    from revlume.operators import gates as GT

    rng = random.Random(1)
    texts = [None, "", " ", "..! a", "One. Two!  three", "a, b; c. d"] + ["".join(rng.choices("ab .!?,;\n", k=rng.randint(0, 90))) for _ in range(300)] + ["Some words, and more. " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    began = time.time()
    for r in df.select("text", X.sentence_spans(F.col("text")).alias("s"), GT.clauses(F.col("text")).alias("c")).collect():
        if r["text"] is None:
            assert r["s"] is None and r["c"] == []
            continue
        assert all(r["text"][x["start"] : x["stop"]] == x["sentence"] for x in r["s"])
        plain = " ".join(r["text"].split())
        assert all(plain[x["start"] : x["stop"]] == x["snippet"] for x in r["c"])
        flat = lambda xs: "".join("".join(xs).split())
        assert flat(x["sentence"] for x in r["s"]) == flat([r["text"].lstrip(".!?")]) or r["text"][:1] in ".!?"
    assert time.time() - began < 60
    assert len(r["s"]) == 40_000 and len(r["c"]) == 80_000
