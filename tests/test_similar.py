"""Edit-distance operators against plain dynamic programming and all pairs."""

import random

import numpy as np

from revlume.operators import similar as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a, b):
    best = 1.0 if not a and not b else 0.0
    for s, t in [(a, b), (b, a)] if len(a) == len(b) else [(min(a, b, key=len), max(a, b, key=len))]:
        if s:
            best = max([best] + [ratio(s, t[max(i, 0) : i + len(s)]) for i in range(1 - len(s), len(t))])
    return best


def weighted(a, b):
    """The published definition, written out."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    x, y = a.split(), b.split()
    one, two = " ".join(sorted(set(x) - set(y))), " ".join(sorted(set(y) - set(x)))
    both = " ".join(sorted(set(x) & set(y)))
    if times < 1.5:
        token = ratio(" ".join(sorted(x)), " ".join(sorted(y)))
        if both and (not one or not two):
            token = 1.0
        else:
            first, second = (f"{both} {one}", f"{both} {two}") if both else (one, two)
            gap = len(one) + len(two) - 2 * lcs(one, two)
            if first or second:
                token = max(token, 1 - gap / (len(first) + len(second)))
            if both:
                token = max(token, 2 * len(both) / (len(both) + len(first)), 2 * len(both) / (len(both) + len(second)))
        return max(ratio(a, b), 0.95 * token)
    scale = 0.9 if times <= 8 else 0.6
    token = 1.0 if both else max(partial(" ".join(sorted(x)), " ".join(sorted(y))), partial(one, two))
    return max(ratio(a, b), scale * partial(a, b), scale * 0.95 * token)


def strings(n, most, signs, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_longest_common_subsequences():
    a, b = strings(300, 70, "ab c", 1) + strings(40, 400, "abcé🙂", 2) + ["", "x", ""], strings(300, 70, "abd ", 3) + strings(40, 300, "abcé🙂", 4) + ["", "", "y"]
    assert S.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)]
    assert S.lcs_lengths(["ab" * 64], ["ba" * 64]).tolist() == [127] and S.lcs_lengths([], []).tolist() == []


def test_weighted_ratios_of_random_names():
    rng = random.Random(5)
    words = ["battery", "life", "screen", "a", "of", "keybord", "keyboard", "service", "x1", "price"]
    a = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(400)] + strings(60, 8, "ab ", 6)
    b = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(400)] + strings(60, 30, "ab ", 7)
    got = S.weighted_ratios(a, b)
    assert np.abs(got - [weighted(x, y) for x, y in zip(a, b)]).max() < 1e-12


def test_scores_known_by_hand():
    pairs = [("battery life", "battery life"), ("battery lif", "battery life"), ("life battery", "battery life"), ("battery", "battery life span"), ("screen", "price"), ("", "x")]
    assert [round(100 * x, 1) for x in S.weighted_ratios(*zip(*pairs))] == [100.0, 95.7, 95.0, 90.0, 36.4, 0.0]


def test_best_name_is_that_of_all_pairs(spark):
    rng = random.Random(9)
    words = ["battery", "life", "screen", "of", "keyboard", "service", "x1", "price", "staff", "wait time"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(80)})
    queries = [q[: rng.randint(2, 20)].title() for q in names] + [q.replace("e", "") for q in names[:20]] + ["", "  ", "zzz", None, "life", "life"]
    got = {r["query"]: (r["candidate"], round(r["score"], 10)) for r in S.best_match(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(n,) for n in names + names[:3] + ["", None]], "candidate string")).collect()}
    wanted = {}
    for q in {q for q in queries if q and q.strip()}:
        score, name = min((-weighted(q.lower().strip(), n), n) for n in names)
        if -score >= 0.85 - 1e-12:
            wanted[q] = (name, round(-score, 10))
    assert got == wanted and len(wanted) > 40


def near_texts(seed, n, low, high):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh  é") for _ in range(rng.randint(low, high))) for _ in range(n)]
    out = []
    for text in base:
        out.append(text)
        for _ in range(2):
            chars = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 8))):
                if rng.random() < 0.5 and chars:
                    del chars[rng.randrange(len(chars))]
                else:
                    chars.insert(rng.randrange(len(chars) + 1), rng.choice("abcdefgh "))
            out.append("".join(chars))
    return out


def test_near_copies_are_those_of_all_pairs(spark):
    for seed, low, high in ((1, 0, 12), (2, 20, 60), (3, 100, 260)):
        rng = random.Random(seed)
        rows = [(i, rng.choice(["train", "val", "test"]), t) for i, t in enumerate(near_texts(seed, 25, low, high))]
        rows += [(900, "train", None), (901, "val", ""), (902, "test", "  "), (903, "val", rows[3][2]), (903, "test", rows[3][2]), (None, "train", rows[3][2].upper() + " ")]
        turn = {"train": 0, "val": 1, "test": 2}
        wanted = set()
        for i, s, t in rows:
            for _, r, u in rows:
                x, y = (t or "").strip().lower(), (u or "").strip().lower()
                if x and y and x != y and turn[s] < turn[r] and 10 * (len(x) + len(y) - 2 * lcs(x, y)) <= len(x) + len(y):
                    wanted.add((i, s, r))
        got = S.near_copies(spark.createDataFrame(rows, "id long, split string, text string"), ["train", "val", "test"]).collect()
        assert {tuple(r) for r in got} == wanted and len(got) == len(wanted) and (seed == 1 or len(wanted) > 10)


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, split string, text string, key int, splits int")
    assert S.near_copies(none, ["train", "test"]).collect() == []
    names = spark.createDataFrame([], "query string")
    assert S.best_match(names, names.withColumnRenamed("query", "candidate")).collect() == []
