"""Token alignment against a plain double loop over the two libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from revlume.llm import alignment
from revlume.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs string, looked int, n_a string"
ODD = [
    "a b", None, "", "  a", "a ", "a  b\n\n c\t\td \r\n x", " ", "\n", "\n\n", "a▁b", "<s> </s> <|endoftext|> <unk> <0x41>", "é ü 　 z", "\x00 q", "a\x00b c",
    "日本語 テスト 🙂🙂", "...;\r\n  {\r\n", "x" * 3000, "ab " * 700, "\ta", "a\t\n b", "a \nb", "a\n b", "\n a", "  \u0085x", "ﬁ ½ Ⅷ", "a b", "a b",
]


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.Vocabularies(A, B)


def brute(texts):
    """Per text the groups as (A ids, B ids), by merging the two lists of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    decode = {}
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    for i, b in enumerate([b for b in range(256) if b not in keep]):
        decode[chr(256 + i)] = b
    decode |= {chr(b): b for b in keep}
    out = []
    for text in texts:
        out.append([])
        if not text:
            continue
        a = first.encode(" " + text, add_special_tokens=False)
        a_bytes = [bytes(decode[c] for c in t) for t in a.tokens]
        b = second.encode(text)
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        i = j = x = y = 0
        group = ([], [])
        while i < len(a.ids) or j < len(b):
            if x <= y and i < len(a.ids):
                x += len(a_bytes[i])
                group[0].append(a.ids[i])
                i += 1
            else:
                y += len(b_bytes[j])
                group[1].append(b[j])
                j += 1
            if x == y:
                out[-1].append(group)
                group = ([], [])
    return out


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""


def check(vocabularies, texts):
    got = alignment.Aligned(vocabularies, texts)
    wanted = brute(texts)
    assert got.digests() == [digest(g) for g in wanted]
    assert np.diff(got.a_first).tolist() == [sum(len(a) for a, _ in g) for g in wanted]
    for i, groups in enumerate(wanted):
        links = got.links[got.first[i] : got.first[i + 1]]
        assert len(links) == len(groups)
        if groups:
            a, b = np.array([x[-1] for x, _ in groups]), np.array([y[-1] for _, y in groups])
            assert links.tolist() == vocabularies.number(a, b).tolist()
            assert vocabularies.second(links.astype(np.int64)).tolist() == b.tolist()


def test_groups_of_odd_texts(vocabularies):
    check(vocabularies, ODD)


def test_groups_of_random_texts(vocabularies):
    rng = random.Random(3)
    signs = list(" \n\t\rab,.é日 '<|>sx1▁") + ["  ", "the ", "ing"]
    check(vocabularies, ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(1500)])


def test_galloping_gives_ranks():
    rng = np.random.default_rng(5)
    for _ in range(200):
        longer = np.unique(rng.integers(0, 400, rng.integers(0, 120)))
        driver = np.unique(rng.integers(0, 400, rng.integers(0, 60)))
        start = rng.integers(-5, 130, len(driver))
        assert alignment.gallop(driver, longer, start).tolist() == np.searchsorted(longer, driver).tolist()


def test_pair_numbers_are_one_to_one(vocabularies):
    by_bytes = {}
    for i, x in enumerate(vocabularies.b.bytes):
        by_bytes.setdefault(x, []).append(i)
    pairs = set()
    for a, x in list(enumerate(vocabularies.a_bytes))[:4000]:
        for k in range(1, len(x) + 1):
            pairs.update((a, b) for b in by_bytes.get(x[-k:], []))
    a, b = (np.array(v) for v in zip(*pairs))
    numbers = vocabularies.number(a, b)
    assert len(set(numbers.tolist())) == len(pairs) and numbers.max() < vocabularies.pairs
    assert vocabularies.second(numbers).tolist() == b.tolist()


def test_counts_over_the_corpus(spark):
    rng = random.Random(8)
    texts = ODD + [" ".join(rng.choice(["tokenization", "unbelievable", "xqz", "don't", "naïve", "12345", "the"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = [(None if i == 4 else i % 70, t, "x", 1, "y") for i, t in enumerate(texts)]
    got = alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B).collect()
    groups = brute(texts)
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    wanted = [
        (rows[i][0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(count[a[-1], b[-1]] == best[b[-1]] for a, b in g), sum(count[a[-1], b[-1]] for a, b in g), digest(g))
        for i, g in enumerate(groups)
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


def test_groups_as_rows(spark):
    texts = ["unbelievable naïve tokens", None, "a▁b", "x  y"]
    got = alignment.groups(spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA), A, B).orderBy("doc_id", "group").collect()
    wanted = brute(texts)
    assert [(r["doc_id"], r["group"], r["a_ids"], r["b_ids"]) for r in got] == [(i, k, a, b) for i, g in enumerate(wanted) for k, (a, b) in enumerate(g)]
    for r in got:
        assert r["a_to"] - r["a_from"] == len(r["a_ids"]) and r["b_to"] - r["b_from"] == len(r["b_ids"]) and r["end"] > r["start"]
    assert [r["end"] for r in got if r["doc_id"] == 0][-1] == len((" " + texts[0]).encode())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert alignment.align(none, A, B).collect() == [] and alignment.groups(none, A, B).collect() == []
