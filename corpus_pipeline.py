"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, packing.

Each stage works on what its predecessor kept, and its decisions take effect. All but the last return the columns of
``documents``; the last returns the packed pieces with their token ids. What a stage stores on its way is removed when a
later stage starts from a table that does not read it, so the stored tables of one stage stand at a time.

Defined cases: a null or empty text has no words, fails the quality rules and goes; a text that repeats others whole goes
with line dedup; rows that repeat an id are judged each on its own text, and of equal ones one stays; a null id is an id
of its own that sorts first; a null source is the host ""; further columns pass through the first four stages untouched,
whatever their names; an empty table gives an empty result.
"""
from __future__ import annotations

import functools
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.llm import decontaminate, jaccard, linededup, packing, quality
from courtlake.llm.common import collecting, drop_stored, stored, table

_behind: ContextVar[dict[str, list[str]]] = ContextVar("behind")     # by input folder, tables that the stages before have stored


def _stage(work):
    """``work`` as a stage that first removes what the stages before it have stored and ``docs`` does not read.

    The output of a stage has to be written when the next one starts. The first stage begins anew and removes nothing; a
    pipeline in another thread is not touched."""
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        behind = dict(_behind.get({}))
        left = [] if work.__name__ == STAGES[0][0] else drop_stored(spark, behind.get(sf_dir, []), docs)
        with collecting() as paths:
            out = work(spark, docs, sf_dir)
        _behind.set({**behind, sf_dir: [] if work.__name__ == STAGES[-1][0] else left + paths})
        return out
    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality.keep_good(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of nothing else goes with them."""
    cleaned, removed = linededup.dedup_passages(docs)
    left = cleaned.where((F.col(removed) == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return jaccard.keep_first(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(packing.pieces(docs, with_ids=True))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with collecting() as own:
            docs = stored(stage(spark, docs, sf_dir), name)
        drop_stored(spark, before, docs)                    # the output of the stage before
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
