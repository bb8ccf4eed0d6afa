"""A pipeline from raw documents to token ids: five stages, each a written table that the next one reads.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colkit.llm import bpe, dedup_exact, lang_id, mixing, ngram_join
from colkit.llm.common import Scratch, numbered, picked, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's own labels teach; texts without letters and of unknown language go.

    Null and empty texts go with those without letters.  Repeated rows share one decision; an empty table stays empty.
    """
    return lang_id.keep_determined(docs, lang_id.fit(docs))


def _only(table: DataFrame, rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """The rows of a numbered table whose number is in ``rows`` (__row), ``copies`` times each."""
    copy = F.lit(0) if copies is None else F.explode(F.sequence(F.lit(0), copies - 1))
    return picked(table, rows.select("__row", copy.alias("__copy")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal up to white space: that with the smallest doc_id.

    Null ids come last; of rows that share text and id one stays; null and empty texts are one group.
    """
    with Scratch(spark) as scratch:
        table = numbered(docs, "pipeline-exact")
        result = _only(table, dedup_exact.exact_dedup(table, row_col="__row").where("kept").select(F.col("rid").alias("__row")))
        return scratch.keep(result, table, *result._colkit_reads)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, similarity 0.8): that with the smallest doc_id.

    Null ids come last; rows are told apart by their number, so rows that share an id, or have none, are judged one by one.  Texts without
    words stay.
    """
    with Scratch(spark) as scratch:
        table = numbered(docs, "pipeline-near")
        key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row"))
        found = ngram_join.similar_components(table.withColumn("__key", key), width=5, threshold=(80, 100), id_col="__key")
        result = _only(table, found.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id.row").alias("__row")))
        return scratch.keep(result, table, *result._colkit_reads)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document that the mix takes twice is two rows, one that it does not take is none.

    Rows are told apart by their number, whatever their ids; texts without words are never taken.
    """
    with Scratch(spark) as scratch:
        table = numbered(docs, "pipeline-mix")
        taken = mixing.mix(table, also=("__row",)).where("taken > 0")
        result = _only(table, taken, (F.col("taken") / F.col("size")).cast("int"))
        return scratch.keep(result, table, *result._colkit_reads)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the token ids, and the digest of the text that they decode to.

    Null and empty texts have no tokens and decode to the empty text.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.encode(docs, path, decoded=True)
    return both.select("doc_id", "n_tokens", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("mix_sources", mixed),
    ("bpe", tokens),
]

#: Signature joins, merge rounds and the language filter are beyond SQL: the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:  # what a stage's result reads is needed no longer once that is written
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            scratch.keep(docs, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
