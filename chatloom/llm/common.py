"""Shared pieces of the corpus operators: table access, tokenisation, column names, graph components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.written import discard
from ..plans.written import written as materialize

#: A word: a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    """The words of a text as UTF-8 bytes. bytes.split and bytes.lower know ASCII alone, which is what WORD asks for."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> DataFrame:
    """docs with every column in one struct `row`: nothing that an operator adds can clash with what came in."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("row"))


def free_names(docs: DataFrame, names: list[str]) -> list[str]:
    """Names for result columns. One that docs has already (upper and lower case alike) gets underscores behind it until it is free: columns that came in keep
    their names and values."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def numbered(docs: DataFrame, **named: str) -> DataFrame:
    """packed() with rid, a number that tells rows apart even where all columns are equal, and columns of docs under given names. Written out, so that rid means the same row
    whenever and wherever it is read; the named columns are read from the struct and not stored twice."""
    rows = materialize(packed(docs).withColumn("rid", F.monotonically_increasing_id()), "rows")
    return rows.select("rid", "row", *[F.col("row")[c].alias(n) for n, c in named.items()])


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 512):
    """Rows of whole texts go to Python workers so many at a time, in what is computed inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_parts(spark: SparkSession, parts: int):
    """Shuffles inside have so many partitions: a join with a table written by its key in as many parts leaves that table where it is."""
    return setting(spark, "spark.sql.shuffle.partitions", str(parts))


def shuffles_end(spark: SparkSession):
    """The files of a shuffle inside go as soon as the query that made it is over, not when the driver's JVM happens to collect garbage: until then they take disk beside all later ones."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Rows of a few longs that a join may send to all executors: 4 to 16 MB. And edges that one task joins up.
BROADCAST_ROWS, FEW_EDGES = 1 << 18, 1 << 17


def if_small(table: DataFrame) -> DataFrame:
    """A written table of a few longs a row, marked for broadcast if it has at most BROADCAST_ROWS rows; else it is left to a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all edges (u, v), by union and find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
            a, c = find(up.setdefault(u, u)), find(up.setdefault(v, v))
            up[max(a, c)] = min(a, c)
    yield pd.DataFrame({"node": np.array(list(up), dtype=np.int64), "root": np.array([find(x) for x in up], dtype=np.int64)})


def components(edges: DataFrame, few: int = FEW_EDGES, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b) as (node, root), root the smallest node reached; nodes without edges are absent.

    At most `few` edges are joined up in one task. More take alternating large-star and small-star rounds: the number of rounds grows with the logarithm of the longest chain, and a
    node's neighbours are only ever reduced to their minimum, so a hub never meets in one task. All is done when no node has edges both up and down.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.count() <= few:
        return e.coalesce(1).mapInPandas(_join_up, "node long, root long")
    for _ in range(max_rounds):
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        by_node = ends.groupBy("node").agg(F.max("up").alias("up"), F.max("down").alias("down"), F.sum("up").alias("n"))
        if by_node.where("(up = 1 and down = 1) or n > 1").isEmpty():
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e, large)
        e = small
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
