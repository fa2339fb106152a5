"""Corpus pipeline: quality, toxicity, near duplicates, benchmark items, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of ``documents``. Classifiers are
trained on labelled rows of the original documents, so what a stage drops
doesn't depend on the size of what comes in.

Rows that are odd: a null or blank text is rejected by the quality stage, so
later stages see none unless called alone, where they keep it (packing has
nothing to place). A row with a null id goes through as long as its text is
kept, is in no group of near duplicates, and isn't packed. Rows that repeat an
id: the near-duplicate stage keeps one of them. Equal texts under different
ids: the smallest id stays. A text of any length is read whole; one longer than
a window fills several. Further columns, whatever their names, go through all
stages but the last. An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontam, packing, quality, simhash, toxicity
from inkwell.llm.common import load
from inkwell.llm.storage import Written, prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble rejects, and null and blank ones."""
    return quality.accepted(docs, quality.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents at or above the toxicity threshold."""
    return toxicity.clean(docs, toxicity.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id."""
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of lexically related documents; a row per window."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models, connected components and greedy filling aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    prepare(spark)
    docs, held = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        new = Written(stage(spark, docs, sf_dir), name)
        if held is not None:
            held.drop()
        docs, held = new.df, new
    return docs
