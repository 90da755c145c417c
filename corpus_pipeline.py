"""From raw documents to training sequences: quality, toxicity, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import mixing, near_duplicates, packing, quality, toxicity
from ledgerloom.llm.common import new_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep.

    Null, empty and blank texts have no words and go; repeated rows are judged alike and stay repeated; an
    empty table stays empty; other columns, whatever their names, are carried along.
    """
    return quality.keep(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, trained on labelled documents of this input, does not call toxic.

    Labels of documents that earlier stages dropped teach nothing. Without labelled documents of both
    kinds all stay. Null and blank texts get the score of no evidence; equal texts share their fate.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class.

    Of rows with that id the one with the least text stays (null first); documents without words are in
    no class, and those without an id are all kept.
    """
    return near_duplicates.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their targets.

    A null source is one of its own; documents of a source without words are left out, as its rate is 0; rows
    with equal ids share one decision.
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences.

    Null and empty texts are one piece with the end id; a document taken twice is packed twice; a null
    id stays null; an empty table gives no pieces.
    """
    return packing.digest(packing.pack(docs, with_ids=False))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Training, connected components and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
