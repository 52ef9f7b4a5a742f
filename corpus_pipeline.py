"""A corpus pipeline: toxic documents go, near-duplicates go but for one, contaminated documents go, sources are mixed to
their target weights, and what stays is written as token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again
for the next.  All but the last return the columns of documents.  When a stage begins, its predecessor's result has been
written, so the intermediates of that are deleted.

Edge cases: null and empty texts pass every stage (they are neither toxic nor near-duplicates nor contaminated, and the mix
gives them copies by their source's rate); rows that repeat an id are documents of their own until the near-duplicates go;
very long texts are read whole by every stage; columns of any name are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, minhash, mixing, postings, toxicity, wavelet

#: SQL can't fit the classifier or encode tokens; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
#: Scratch paths of the stage that ran last.
_left: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after its predecessor's intermediates have gone; the first stage has none."""

    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f.__name__ != "drop_toxic":
            common.discard(spark, _left, docs)
        with common.collected() as made:
            out = f(spark, docs, sf_dir)
        _left[:] = made
        return out

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 stay."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return minhash.deduplicated(docs, words=5, percent=80)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that hold no 13-word window of a benchmark item and have less than a twentieth of their words in shorter items."""
    return postings.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per copy that its source's target weight gives it."""
    return mixing.mix(docs)


@_stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: where its ids stand in the token files, how many, and their crc32."""
    common.ship(spark)
    return wavelet.token_file_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
