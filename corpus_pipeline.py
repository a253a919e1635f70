"""A corpus through five stages: documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Cases: documents with null or empty text, or without a letter, go in the first stage; null ids and labels are kept as they
are, and a null id counts as the last one; of repeated rows one stays; an empty benchmark drops nothing; no documents, or
none that stay, give no rows; further columns of documents, whatever their names, pass to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, language_id, packing, similarity_join, substring_dedup
from ledgerloom.llm._common import written
from ledgerloom.llm.queries import table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: without a letter, or long and mostly of trigrams that no learned language has (language_id.in_language). Short texts, and texts of which the label is unsure, stay; without a model all with letters stay. Documents without lang get the predicted one where its calibrated score is 0.9 or more."""
    model = language_id.fit(docs, ~language_id.held_out("doc_id"))
    return language_id.in_learned_languages(docs, model, label_col="lang")


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return similarity_join.keep_one(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that occur before; other documents keep their text as it is. n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = substring_dedup.remove_repeats(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), id_col=f"c{docs.columns.index('doc_id')}", text_col=f"c{docs.columns.index('text')}", keep=tuple(f"c{docs.columns.index(c)}" for c in rest), as_is=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[own[c].alias(c) if c in own else F.col(f"c{docs.columns.index(c)}").alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and their sequences."""
    return packing.pack_documents(docs, tokenizer_path(), special=True)


STAGES = [("language ID", identify_language), ("n-gram Jaccard join", join_near_copies), ("substring dedup", remove_passages), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]

#: SQL cannot express a trained model or a tokenizer; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
