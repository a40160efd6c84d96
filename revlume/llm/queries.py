"""The registered queries of the training-data operators and their SQL, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The tokenizer's file: below REVLUME_TOKENIZERS, else from the installed vocabulary package."""
    root = os.environ.get("REVLUME_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classes

    return classes(table(spark, sf_dir, "documents")).drop("key").withColumn("root", F.hex("root"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learner, score

    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (~learner(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("mix_tie")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learner

    found = identify(table(spark, sf_dir, "documents"), learner(F.col("doc_id")))
    return found.select("doc_id", (~learner(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import token_shards

    return token_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: The key of the registered query and the pipeline: that of a deployment, from its environment, else one for demonstration.
PII_KEY = os.environ.get("REVLUME_PII_KEY") or "revlume-demonstration-key"


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    docs = table(spark, sf_dir, "documents")
    return pseudonymize(docs, PII_KEY)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_toxicity": op2_toxicity,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_mix_sources": op4_mix_sources,
    "op5_language_id": op5_language_id,
    "op6_token_shards": op6_token_shards,
    "op7_quality_rules": op7_quality_rules,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_whitening": op12_whitening,
    "op13_main_text": op13_main_text,
}

ORACLE_SQL: dict[str, str] = {}
