"""The training-data pipeline: every stage works on all that the stage before it kept.

language ID, toxicity, near-duplicates, mixing of sources to weights, best-fit packing.

All stages but the last return the columns of their input with their values, whatever the names of further
columns: none is taken for a result. Nulls: a null id takes part as any other, a null text has no language
and goes with the first stage, a null source is a source of its own. Empty texts go with the first stage;
very long ones are scored, compared and packed whole. Ties: the smallest id, then the least key of the row,
stays of a group. Repeated rows are one text of a group and one of them stays; each copy that the mix takes
is packed on its own. An empty table, or one without a row to learn from, gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import give_back, shared_dir, table
from siltstone.llm.language import accepted, remainder
from siltstone.llm.language import train as train_language
from siltstone.llm.mixing import mixed
from siltstone.llm.neardup import representatives
from siltstone.llm.packing import pack_blocks
from siltstone.llm.toxicity import clean
from siltstone.llm.toxicity import train as train_toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no learned language: no letters, or too high a cross-entropy. Without a row that has a
    language and a text, all go."""
    kept = accepted(docs, train_language(docs))
    give_back()
    return kept


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts predicted toxic; learns from the labels of the training fold. Without a toxic one, all stay."""
    labels = table(spark, sf_dir, "labels")
    model = train_toxicity(docs.filter(remainder(docs["doc_id"], 4) != 2), labels.filter(remainder(labels["doc_id"], 4) != 2))
    kept = clean(docs, model)
    del model  # the executors have it
    give_back()
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8. Rows without words all stay."""
    return representatives(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's weight asks for, which may be never."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the words of the mixed documents into sequences of several lengths."""
    return pack_blocks(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: Classifiers, draws and bins can't be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/siltstone/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
