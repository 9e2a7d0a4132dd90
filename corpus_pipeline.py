"""The corpus pipeline: quality, toxicity, near-duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whole rows only. A stage looks at
whole texts and at all that the stage before it kept. A null text counts as empty, an empty table gives an empty one, further
columns are carried and may have any name but that of a score; what a stage does with nulls, empty texts, ties and repeated
rows stands in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import decontaminate, ngram_join, packing, quality, toxicity
from recallgrid.llm.queries import CAPACITY, END_ID, table, tokenizer_path
from recallgrid.llm.shared import shared_root


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; a tie stays.

    Null and empty texts get the score of the bias alone. Rows that repeat are scored alike, and so stay or go together, with
    or without an id; rows without an id teach nothing. Without labels every score is 0.5 and all rows stay.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).where(F.col("quality_score") >= 0.3).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; a tie goes.

    Null and empty texts hold no word and get the score of the bias. Rows that repeat stay or go together.
    """
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).where(F.col("toxicity_score") < 0.5).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of linked documents.

    Null and empty texts are one group; a null id comes last; of rows that repeat id and text one stays.
    """
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts hold none, rows that repeat stay or go together."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 4096 tokens.

    Null and empty texts are a piece of the end id alone; rows without an id, or that repeat one, are documents of their own.
    """
    return packing.pack(packing.cut_pieces(docs, tokenizer_path(), END_ID, CAPACITY), CAPACITY)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # training, MinHash classes, tokenization and packing are beyond SQL; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written as Parquet and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_root(spark)}/recallgrid/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
