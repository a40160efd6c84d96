"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revlume.llm import langid, mixing, neardup, neighbours, packing, pii, quality, substring, toxicity, wavelet
from revlume.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside.
CLASHES = "toxic labelled score predicted key root member band seed first n a b piece part own base length rank level levels cutoff stratum quality start tie block v ids q tree leaf word label parts planned pseudonym_key kept_row_key runs words stretches row mix_position mix_tie mix_of_doc_id mix_source mix_block".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = text(30_000)
    rows = [(i, text(60 + i), "en" if i % 2 else "de", f"s{i % 3}", i) for i in range(40)]
    rows += [(None, rows[1][1], "en", "s1", 1), (None, text(50), None, None, None), (40, None, "en", "s0", 0), (41, "", None, "s1", 0), (42, " \n\t ", "de", None, 3), (43, long, "en", "s2", 9), (44, long + " end", "en", "s2", 9)]
    rows += [rows[3], rows[3], (5, "another text of document five", "de", "s0", 2), (None, None, None, None, None), (None, None, None, None, None), (45, "x" * 300_000, "en", "s0", 1)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.select("*", *(F.lit(f"c{i}").alias(c) for i, c in enumerate(CLASHES))).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")


def operators(labels):
    byte, word = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
    return {
        "toxicity": lambda d: toxicity.score(d, labels), "substring": substring.without_repeats, "mixing": mixing.mix, "langid": lambda d: langid.identify(d, langid.learner(F.col("doc_id"))),
        "shards": lambda d: wavelet.token_shards(d, byte, 2), "quality": lambda d: quality.judge(d, labels), "pii": lambda d: pii.pseudonymize(d, "k" * 16), "mixed": mixing.mixed,
    }, {"clean": lambda d: toxicity.keep_clean(d, labels), "one": neardup.keep_one, "classes": neardup.classes, "packing": lambda d: packing.pack(d, word, 1)}


def test_every_row_has_a_result(docs, labels):
    each, _ = operators(labels)
    for name, run in each.items():
        assert run(docs).count() == docs.count(), name


def test_equal_rows_get_equal_results(docs, labels):
    each, _ = operators(labels)
    for name in ("toxicity", "substring", "langid", "quality"):
        got = [r.asDict() for r in each[name](docs).where("doc_id = 3").collect()]
        assert len(got) == 3 and got[0] == got[1] == got[2], name


def test_columns_pass_unchanged(docs, labels):
    each, some = operators(labels)
    for run in (each["pii"], each["mixed"], some["clean"], some["one"]):
        assert run(docs).dtypes == docs.dtypes


def test_near_duplicates_and_packing(docs, labels):
    _, some = operators(labels)
    distinct = docs.select("doc_id", "text").distinct().count()
    assert some["classes"](docs).count() == distinct
    kept = some["one"](docs)
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.select("doc_id").collect())
    # of each repeated row one, of the two long texts one, document 1 and its copy without an id are one
    assert ids.count(3) == 1 and (43 in ids) != (44 in ids) and ids.count(5) == 2 and {40, 41, 42, 45} <= set(ids) and ids.count(-1) + ids.count(1) == 3
    pieces = some["packing"](docs)
    assert pieces.where("piece = 0").count() == docs.count() and pieces.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def test_empty_tables_give_no_rows(docs, labels):
    each, some = operators(labels)
    for name, run in (each | some).items():
        assert run(docs.limit(0)).count() == 0, name


def test_vectors_with_clashing_columns_and_repeated_rows(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(0, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (50, [0.0, 1.0, 2.0]), (50, [0.0, 1.0, 2.0]), (70, [1.0, 2.0]), (71, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clash = vectors.select("*", *(F.lit(1).alias(c) for c in ("v", "ids", "group", "check", "q", "tree", "leaf", "score", "query_id", "width", "cell")))
    got = [tuple(r) for r in neighbours.nearest(clash, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(tuple(r) for r in neighbours.nearest(vectors, F.col("vec_id") % 50 == 0).collect())
    assert all(q != v for q, _, v, _ in got) and {q for q, *_ in got} == {0, 50}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_on_odd_rows(spark, docs):
    for rows in (docs, docs.limit(0)):
        at = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.materialize(stage(spark, at, SF), f"odd-{name}")
            assert after.dtypes == rows.dtypes and after.count() <= at.count(), name
            assert name in ("toxicity", "near_duplicates") or after.count() == at.count()
            at = after
        assert corpus_pipeline.STAGES[-1][1](spark, at, SF).where("piece = 0").count() == at.count()
