"""Repeated passages in rows whose key or words are unlucky for a hash."""

import hashlib

from revlume.llm import substring


def test_a_key_that_ends_with_a_zero_byte_keeps_its_row(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    ids = [i for i in range(4000) if hashlib.md5(f"{i} +{passage}".encode()).digest()[-1] == 0][:3]
    docs = spark.createDataFrame([(i, passage) for i in ids], "doc_id long, text string")
    assert len(ids) == 3 and {r["doc_id"]: r["n_removed"] for r in substring.without_repeats(docs).collect()} == dict.fromkeys(ids, 40)


def test_long_words_of_two_letters_in_turns_stay_apart(spark):
    turns = "a"
    for _ in range(11):
        turns += turns.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(34)]
    texts = [" ".join([*around[:17], word, *around[17:]]) for word in (turns, turns.translate(str.maketrans("ab", "ba")))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in substring.without_repeats(docs).collect()] == [0, 0]
