"""A training corpus from raw documents: quality, duplicates, near duplicates, mix, token ids.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame; all but the last return the columns of `documents`. Null
columns, empty and repeated rows, empty tables and extra columns behave as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.llm import bpe_tree, exact, hyperminhash, mix, quality
from worktrace.llm.common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language's reference go.

    Null and empty texts fail; repeated rows share their verdict; a null language
    is a language. An empty table gives an empty one.
    """
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays.

    Null text equals empty text; of rows that repeat an id and a text one stays,
    that with the largest values in the other columns; rows without id stay if no
    row of their text has one. An empty table gives an empty one.
    """
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Null, empty and wordless texts and rows without id are in no group and stay. An
    empty table gives an empty one.
    """
    return hyperminhash.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources come near their target weights.

    A null source is a source; null and empty texts have no words and weigh nothing,
    but are drawn like others; equal rows draw alike. An empty table gives an empty one.
    """
    return mix.mix(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token ids of each document of the mix (binary, little-endian 32-bit), and digests of ids and decoded text.

    Null and empty texts have no ids; repeated rows each get theirs; the columns
    doc_id and source pass through, nulls included. An empty table gives an empty one.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe_tree.encode(docs, tokenizer)
    return rows.select(
        "row.doc_id", "row.source", bpe_tree.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "ids"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_encode", bpe_encode),
]

#: The last stage is a tokenizer's merges; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
