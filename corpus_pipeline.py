"""From documents to packed token ids: five stages, each over all that its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, columns of any names and empty tables; what it makes of them is said
below.  All but the last give rows as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisloom.llm import decontamination, language_id, mixing, near_duplicates, token_output
from jurisloom.llm.common import drop_path, scratch_path

#: Share of noise in its mixture from which a text counts as no language.
MOST_NOISE = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose trigrams fit noise better than any language.

    So null and empty texts go; rows without an id stay if their text does, repeated
    rows share one fate; with no labelled row only texts without a letter go.
    """
    langs, model, bits = language_id.train(language_id.learned_part(docs))
    names = docs.columns
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text").alias("text"))
    found = language_id.predict(found, langs, model, bits)
    stays = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_noise") <= MOST_NOISE)
    return (found.filter(stays) if langs else found.filter(F.col("text").rlike(r"\p{L}"))).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id (null: largest; then by its text's hash), stays of each class of near copies.

    Repeated rows are copies; texts without a word are nobody's.
    """
    return near_duplicates.one_of_each(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; null and empty texts contain none."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_inside=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents to their sources' target weights.

    A null source is one of its own, a null text has size 0, rows that tie in
    source, id and size share one decision.
    """
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token shards and give what the files hold for each document: ``doc_id, start, n_tokens, ids_crc32``.

    Null ids come first, equal ids by their tokens; a null text has its end id only.
    """
    import public_tokenizers

    return token_output.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Similarity classes, language models and a tokenizer can't be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
