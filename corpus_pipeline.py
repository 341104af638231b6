"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what it keeps of docs.

quality rules and quality classifier drop the documents that they reject, the n-gram Jaccard join keeps the
first document of each group of near copies, benchmark decontamination drops the documents that an item
contaminates, and piece encoding returns doc_id, n_tokens and ids (little-endian u16) of the rest.

Defined results: a null, empty or short text (under ten words) goes in the first stage; texts of any length are read whole;
of ties (documents of one group of near copies) the smallest doc_id stays; rows that repeat an id go or stay together in
the third and fourth stage and are judged one by one in the others; rows with a null doc_id have no group and no item,
and stay if their text passes; an empty table stays empty; all columns but the last stage's are kept as they are, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontamination, ngram_join, piece_sampling, quality_classifier, quality_rules
from spindrift.llm.common import table, written
from spindrift.llm.queries import tokenizer_file


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The net learns from all documents: the rules have left hardly any bad ones in docs.
    return quality_classifier.keep(docs, quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_groups(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", by_rules),
    ("quality classifier", by_classifier),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("SentencePiece encoding", as_pieces),
]

#: The forest, the net and the sampled segmentations are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written to the shared folder and reread for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
