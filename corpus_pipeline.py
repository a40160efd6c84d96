"""The training-data pipeline over ``documents``: five stages, each one operator of ``revlume.llm``.

Each stage works on all that the one before it kept; the stages but the last
return the columns of documents. The stages are no SQL (a trained classifier,
hashed signatures, keyed permutations, a tokenizer), so ORACLE_SQL is None; the
operators are tested against brute-force versions.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, empty tables and extra columns of any name without failing:

- toxicity: a text without words is clean; equal texts share a verdict; labels
  that are null or of absent documents teach nothing; without both kinds of
  labels nothing goes.
- near_duplicates: texts without a word stay, each by itself; of repeated rows
  one stays; of a class the row with the smallest doc_id (null first), of equal
  ids that with the smallest hash.
- pii: null and empty texts stay as they are; equal values get equal pseudonyms.
- mixing: a null source is a source; null doc_ids go first; all rows stay.
- packing: a null text counts as empty and is one piece with the end id alone.

An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlume.llm import mixing, neardup, packing, pii, toxicity
from revlume.llm.queries import PII_KEY, table, tokenizer_path
from revlume.llm.storage import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject, with their columns; labels come from ``sf_dir``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, similarity 0.8), with its columns."""
    return neardup.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced; n_chars follows the text."""
    changed = pii.pseudonymize(docs, PII_KEY)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their columns, in the order of the mixture of their sources."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of at most 4,096 tokens."""
    # the workers still hold memory of the stages before, so they keep fewer encodings
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096, cache_entries=600_000)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each_class),
    ("pii", pseudonyms),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
