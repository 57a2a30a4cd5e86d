"""A training corpus from raw documents: five stages, each on what the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetable.llm import decontaminate, line_dedup, packing, shingle_dedup, toxicity
from kinetable.llm.common import collect_garbage, free, held_out, made_since, mark, short_batches, stage
from kinetable.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the last stage's result is read from. The next stage starts when that result was written, so it deletes them.
_left: list[str] = []


def _clean(step: Stage) -> Stage:
    """``step``, which deletes the tables and shuffle files of the stage before it when it starts."""

    @functools.wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free(spark, _left)
        collect_garbage(spark)
        short_batches(spark)
        start = mark()
        out = step(spark, docs, sf_dir)
        _left[:] = made_since(start)
        return out

    return run_stage


@_clean
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels, keep=lambda c: ~held_out(c)))


@_clean
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave all documents but one; n_chars follows the text."""
    return line_dedup.drop_repeated_lines(docs, chars_col="n_chars")


@_clean
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that pairs with a 5-word Jaccard similarity of 0.8 or more link."""
    return shingle_dedup.drop_similar(docs)


@_clean
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_clean
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its place in a sequence."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the tokenizer nor the classifier.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, with the output of each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[str] = []
    for k, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        start = mark()
        docs = stage(out)
        free(spark, written)
        written = made_since(start)
    return docs
