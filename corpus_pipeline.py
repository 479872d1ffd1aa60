"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, and its decisions take effect. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import line_dedup, mixing, packing, quality, simhash
from chatloom.llm.common import discard, free_names, materialize, table
from chatloom.plans.written import discard_paths, left_over

#: Near duplicates: shingles of five words, a similarity (Jaccard) of 0.8 or more.
NEAR = {"words": 5, "similarity": 0.8}


_behind: set[str] = set()
#: Whole texts go to Python workers so many rows at a time, which keeps executors' memory low. Set for the session, as results are computed after a stage has returned them;
#: a session that has its own number keeps it.
BATCH, BATCH_KEY, SPARKS_OWN = "512", "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def stage(f: Callable) -> Callable:
    """A stage's result reads tables that its operator has written. They go when a later stage is called with documents that do not come from them, as by then
    the result is written itself."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_KEY) == SPARKS_OWN:
            spark.conf.set(BATCH_KEY, BATCH)
        keep = discard_paths(_behind, docs)
        before = left_over()
        out = f(spark, docs, sf_dir)
        _behind.clear()
        _behind.update(keep, left_over() - before)
        return out

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least one half. Null and empty texts go; repeated rows are judged alike; no documents give none; with no
    label all but empty texts stay. Columns keep their names and values, whatever they are, here and in all stages but the last."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


@stage
def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are cut out; n_chars follows. A text that was nothing else stays as an empty one.
    Nulls and empty texts stay as they are; of repeated rows the first keeps its text; no documents give none."""
    out = line_dedup.dedup_lines(docs)
    n_removed = free_names(docs, ["n_lines", "n_removed"])[1]
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates. Null and empty texts, and all without a word, are one group; of repeated rows one
    stays; rows without an id stay only where their group has no id; no documents give none."""
    return simhash.drop_near_duplicates(docs, **NEAR)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, shared by source weights; a document is repeated or left out as its source's target asks.
    Null and empty texts are never taken; a null source is a source; no documents give none."""
    return mixing.take_mix(docs, share=1.0)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. A null or empty text is its end alone; a repeated document is packed as often as it comes; no documents give
    no pieces."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", cut_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage after the first can be told in SQL: the first depends on a fitted model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
