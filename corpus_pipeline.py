"""From raw documents to training pieces: five stages, each one operator of tidemark.llm.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last keep the
columns of documents, whatever else the table has. Between stages the rows are written as Parquet and read again.

Nulls: a null or empty text fails the quality rules; the later stages take it as a text without words, which
near-dedup holds for a copy of other such texts and the mix never takes. A null id is never dropped for a
copy and never a reason to cut a passage. Null languages and sources are groups of their own. Repeated rows and
ties: rows of one id stay or go together in near-dedup; the mix takes rows, not ids. Very long texts are
processed whole. An empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table, stage_table
from tidemark.llm.mixing import mix
from tidemark.llm.phrases import phrase_dedup
from tidemark.llm.pieces import MODEL, encode_texts, read_model
from tidemark.llm.quality import quality_filter
from tidemark.llm.jaccard import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that the base rules or their group's fences reject."""
    return quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each class: SimHash candidates, linked at five-word Jaccard 0.8 or more."""
    return near_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages that a smaller id has too; a text left without a word goes."""
    return phrase_dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and piece_ids of each row of the mix."""
    encoded = encode_texts(docs.select("doc_id", "lang", "source", "text"), read_model(spark, MODEL))
    return encoded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", source_mixing),
    ("SentencePiece", sentencepiece),
]

#: Near-duplicate classes and pieces have no SQL form; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, f"stage-{k}")
    return docs
