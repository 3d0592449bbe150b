"""Registered corpus queries with the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import context, exact, lines, minhash, licenses, mixing, phrases, pieces, private, quality, runs, shards, vectors
from .shared import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_private(spark: SparkSession, folder: str) -> DataFrame:
    return private.digests(table(spark, folder, "documents"))


def op2_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


# The largest source gets the share of four others.
WEIGHTS = {"src0": 4.0}
SEED = 20


def op3_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.linked_vectors(table(spark, folder, "embeddings"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), WEIGHTS, seed=SEED)


def op5_shards(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    return shards.materialised(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"), path, seed=SEED)


def op6_context(spark: SparkSession, folder: str) -> DataFrame:
    return context.scores(table(spark, folder, "documents"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digests(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.deduplicated_lines(docs)


def op9_minmax(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_groups(table(spark, folder, "documents"), words=3, percent=85)


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pieces.encoded(
        docs, tokenizer("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256")
    )
    return found.drop("text")


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digests(table(spark, folder, "documents"))


def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_labels(table(spark, folder, "documents"))


CASES = {
    "op1_private": (op1_private, private.ORACLE),
    "op2_exact": (op2_exact, exact.ORACLE),
    "op3_vectors": (op3_vectors, vectors.ORACLE),
    "op4_mixing": (op4_mixing, mixing.oracle(WEIGHTS, seed=SEED)),
    "op5_shards": (op5_shards, None),
    "op6_context": (op6_context, None),
    "op7_quality": (op7_quality, None),
    "op8_lines": (op8_lines, None),
    "op9_minmax": (op9_minmax, None),
    "op10_pieces": (op10_pieces, None),
    "op11_phrases": (op11_phrases, phrases.ORACLE),
    "op12_runs": (op12_runs, None),
    "op13_licenses": (op13_licenses, licenses.ORACLE),
}
