"""A corpus pipeline of five stages. Each stage reads what the one before wrote; all but the last keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.common import dropping_tables, table, word_tokenizer_path, written
from strataframe.llm.decontaminate import decontaminate
from strataframe.llm.jaccard_join import one_of_each_class
from strataframe.llm.line_dedup import line_dedup
from strataframe.llm.packing import pack_documents
from strataframe.llm.quality import quality_rules, train_line_field


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the base rules and the line labels accept. The field learns from this stage's input."""
    field = train_line_field(docs, table(spark, sf_dir, "labels"))
    # The whole row rides along under one name, so that no column of it can clash with the rules' own.
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return quality_rules(rows, field, columns=("__row",)).where("kept").select("__row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop common lines; a document keeps its row even if no line is left. n_chars follows the text."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the smallest doc_id, a null one last; of repeated rows one. Texts without words all stay."""
    return one_of_each_class(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go; null and empty texts hold none, repeated rows are decided alike."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place; null and empty texts are one piece, repeated rows have pieces of their own."""
    return pack_documents(docs, word_tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: The line labels and the tokenizer are not SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes inside is removed once its result is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with dropping_tables(spark):
            result = stage(spark, docs, sf_dir)
            docs = written(result, name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
