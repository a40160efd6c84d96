"""The pipeline on the smallest tables: what each stage must keep and change."""

import os
import re

import pytest

import corpus_pipeline
from revlume.llm.queries import QUERIES
from revlume.llm.storage import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert [n for n, *_ in stages] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_stages_keep_what_they_should(stages):
    ids = {n: ({r["doc_id"] for r in b.select("doc_id").collect()}, {r["doc_id"] for r in a.select("doc_id").collect()}) for n, b, a in stages}
    assert ids["toxicity"][1] <= ids["toxicity"][0] and ids["near_duplicates"][1] < ids["near_duplicates"][0]
    for n in ("pii", "mixing", "packing"):
        assert ids[n][0] == ids[n][1]


def test_no_e_mail_is_left_as_it_was(stages):
    _, before, after = next(s for s in stages if s[0] == "pii")
    mail = re.compile(r"[\w.]+@[\w.]+\.com")
    old = {m for r in before.collect() for m in mail.findall(r["text"])}
    assert old and not old & {m for r in after.collect() for m in mail.findall(r["text"])}


def test_pieces_cover_all_tokens(stages):
    *_, pieces = stages[-1]
    rows = pieces.collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= sum(fill.values()) // 4096 + 2


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
