"""The thin opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the URL query: (verdict, host and path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n: the folds of the learning queries (null for a null id, which is never learned from)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    back = round_trip(table(spark, sf_dir, "pages"))
    whole = F.col("record_type") == "response"
    return back.select(
        F.col("row_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(~whole, F.col("refers_to").cast("long")).alias("refers_to"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"), width=4, threshold=(85, 100))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup_exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("rid")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import learn, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(5) == 0
    model = learn(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    held_out = remainder(4) == 2
    model = fit(docs.where(~held_out))
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from .bpe import encode

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    both = encode(table(spark, sf_dir, "documents"), tokenizer_path, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_mix_sources": op6_mix_sources,
    "op7_url_filter": op7_url_filter,
    "op8_nearest": op8_nearest,
    "op9_language_id": op9_language_id,
    "op10_bpe": op10_bpe,
}
