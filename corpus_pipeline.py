"""The training-data pipeline: five stages over documents, each written and read again.

Each stage function takes (spark, docs, sf_dir) and returns what it keeps, with the
columns of documents; the last returns the training stream.

Defined results: null, empty and very short texts fail the quality rules; in a later stage
on its own they stay (the mix takes no copy of a text without words).  A stage judges each
row by its own whole text, however long; repeated rows are judged alike, and the near-dedup
stage keeps one row of each group: of the smallest doc_id (null last), then of the smallest
text hash.  Other columns of documents pass through under their names, whatever these are,
up to the last stage.  Empty tables give an empty result; without labels of both kinds no
document is toxic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.shared import remove
from lodestone.llm import decontaminate, minhash, mixing, quality, toxicity
from lodestone.llm.text import shared_dir, table

#: Votes, learned taggers, sketches and alignments can't be stated in SQL.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality.kept_by(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a tagger learned from all labels doesn't score as toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return docs.filter(toxicity.tag(model, F.col("text"), spans=False)["score"] < 0.5)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five-word shingles at 0.8 or more."""
    return minhash.distinct_documents(docs, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def curriculum(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: a row for each copy that the mix takes, by position."""
    return mixing.mix(docs.select("doc_id", "text", "source")).select("position", "doc_id", "source", "size", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("toxicity", toxic),
    ("near_dedup", dedup),
    ("decontamination", decontaminated),
    ("mixing", curriculum),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents.  A stage's input goes once its output is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
