"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets; all but the last return the
columns of documents. run() applies them to the documents table, writing each result to the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import crf, decontam, line_dedup, minhash, piece_table
from tagloom.llm.common import materialize, remove, table, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content; the field is trained on labelled documents among docs.

    Null and empty texts have no words and go. Repeated rows are judged alike and stay or go together, null ids are no hindrance. Without
    labels of both kinds only the base rules decide; an empty table gives an empty one.
    """
    return crf.keep(docs, crf.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the boilerplate lines of its source. n_chars follows the text.

    Null texts stay null, null sources are one source, repeated rows count as pages each. A text of nothing but boilerplate stays, empty.
    """
    out = line_dedup.drop_boilerplate(docs)
    n = F.when(F.col("lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one of smallest id, and all documents without a near copy.

    Texts without words, null ones, and rows without id stay; repeated rows of the id that stays all stay, as the id names them all. An
    empty table gives an empty one.
    """
    out = minhash.near_duplicates(docs)
    gone = out.where(~F.col("kept")).select("doc_id").distinct()
    return without(docs, gone, "doc_id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: without a whole window of any item, and without passages of two items.

    Null and empty texts hold none and stay, as do rows without id; repeated rows stay or go together. Items without words match nothing,
    so an empty benchmark drops nothing.
    """
    return decontam.annotate(docs, table(spark, sf_dir, "benchmark")).where(~decontam.leaked()).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number and digest of the ids of each text, and the digest of what they decode to.

    A null text is an empty one, with the begin and end ids only. One row for each row, repeated or without id; none for an empty table.
    """
    return piece_table.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), packed=True).select("doc_id", *piece_table.digests())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", decontaminate), ("sentencepiece", encode)]
#: Training, near-duplicate components and encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs, path = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove(spark, *before)  # a stage's table is done with once the next one stands
        before = [path]
    return docs
