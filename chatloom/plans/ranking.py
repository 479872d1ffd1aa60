"""Global order without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .written import written


def _ranges(df: DataFrame, order: tuple[str, ...], size) -> DataFrame:
    """df dealt by range, sorted and written, with _p, _m (the place within the range) and _at: the sum of `size` over all ranges before. Only the ranges' sums, one number a
    partition, meet in one place."""
    cols = [F.col(c).asc_nulls_last() for c in order]
    dealt = written(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("_p", F.shiftright("_m", 33).cast("int"))
    at, rows = 0, [(-1, 0)]
    for p, n in sorted(dealt.groupBy("_p").agg(F.sum(size).cast("long")).collect()):
        rows.append((p, at))
        at += n or 0
    return dealt.join(F.broadcast(df.sparkSession.createDataFrame(rows, "_p int, _at long")), "_p")


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Adds each row's 0-based place in the order of all rows, nulls last. `order` should be total; rank narrow rows, and join what is wide back to them."""
    ranked = _ranges(df, order, F.lit(1))
    return ranked.withColumn(name, F.col("_at") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_m")


def global_offset(df: DataFrame, *order: str, size: str, name: str = "at") -> DataFrame:
    """Adds the sum of `size` over all rows before, in that order."""
    before = F.sum(size).over(W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, -1))
    return _ranges(df, order, F.col(size)).withColumn(name, F.col("_at") + F.coalesce(before, F.lit(0))).drop("_p", "_at", "_m")
