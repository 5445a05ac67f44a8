"""A training corpus from raw documents: five operators in a row, each on all that the one before has kept.

All stages but the last return the columns of their input, whatever these are called; columns beside doc_id, text, source
and n_chars are carried along unread. An empty table gives an empty one at every stage. Null and empty texts are texts of no
words: their quality is that of an empty text, they are linked with nothing, have no passages and no benchmark words, and
the mix takes nothing of them. Texts of any length are taken whole. Rows that repeat another are one document from the
second stage on. Rows without an id go through all stages but are never linked or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketloom.llm import compression, fm_index, mixing, paragraphs, prefix_tree
from marketloom.llm.common import documents, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be of label 1. Rows with one text go or stay together; without
    labels of both kinds the share of label 1 decides for all."""
    model = compression.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression.score(docs, model).where("predicted = 1").select(*docs.columns)


def keep_one_of_linked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of least doc_id; documents without an id can't be linked.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Of rows that agree in id
    and text any one stays, with its own other columns; different texts under one id all stay if that id leads.
    """
    joined = prefix_tree.join_documents(docs, size=5, link=(80, 100))
    leads = joined.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(leads, docs["doc_id"].cast("long") == leads["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def cut_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs and passages that an earlier document has; a document that consists of such goes. n_chars
    is counted anew where something was cut; a text without repeats stays as it is."""
    cut = paragraphs.dedup_paragraphs(docs)
    left = (F.col("removed_words") == 0) | (F.regexp_count("text", F.lit(mixing.WORD)) > 0)
    n_chars = [F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return cut.where(left).select(*[c for c in docs.columns if c != "n_chars"], *n_chars).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text; rows are judged one by one, without a benchmark all stay."""
    found = fm_index.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how often each document is taken, and how many of its words in all. A null source is a source of its own."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("ngram_join", keep_one_of_linked),
    ("substring_dedup", cut_repeated_paragraphs),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier and MinHash can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
