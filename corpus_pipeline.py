"""A corpus cleaned in five stages, each one of the training-data operators with production parameters.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  ``run`` writes each stage's rows to the shared folder and reads them
again, so a lost executor never costs more than a stage.  SQL cannot express the
learned stages, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import op1_pack, op3_quality, op4_jaccard, op7_decontaminate, op8_pii
from gridframe.llm.queries import held_out
from gridframe.llm.shared import discard, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among these, scores at least LEAST_QUALITY."""
    model = op3_quality.train(docs, table(spark, sf_dir, "labels"), learn=~held_out(4, 2))
    return op3_quality.scored(docs.select(*COLUMNS), model).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, that of the least id, null ids last; of rows with that id, the first by content.
    Rows without words link with nothing, so all of them stay."""
    return op4_jaccard.first_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a window of a benchmark item, however small its share of the document."""
    rows = op7_decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    # a run has at least one word; counting them by report() would take a second worker for each task
    return rows.where(F.size("runs") == 0).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the kind's name in brackets."""
    return op8_pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return op1_pack.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("private", private), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if done is not None:
            discard(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
