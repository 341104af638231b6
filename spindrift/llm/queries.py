"""The queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontamination, license_scans, ngram_join, piece_counts, piece_sampling, quality_classifier, quality_rules, sharding, token_output, url_filters
from spindrift.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where a vocabulary file of the public tokenizers is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_output.encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), partitions(spark))
    coded, frequencies = token_output.opened(spark, folder)
    starts = F.broadcast(token_output.part_starts(coded))  # a row for each range partition
    read = token_output.digests(coded, frequencies).join(starts, "part")
    return read.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.predictions(quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels"))))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.round_trips(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


#: Shards of the sharding query, of equal weight.
SHARDS = {f"shard-{k:03d}": 1 for k in range(64)}


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS, ["doc_id"], ["doc_id"])


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_quality_rules,
        op2_token_output,
        op3_quality_classifier,
        op4_token_counts,
        op5_benchmark_decontamination,
        op6_url_filters,
        op7_piece_sampling,
        op8_sharding,
        op9_ngram_jaccard_join,
        op10_license_scans,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; tests hold the others against brute force."""
    return {"op6_url_filters": url_filters.oracle_sql()}
