"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code point order (null last) take the weights in turn and share a budget; a target stops at `most`
times its source, and the excess is shared again by weight until none is above. Each source is taken whole as often as its
target allows; the rest of the target is fitted by document length: documents are counted by exact length,
an even share of every length is taken in bulk, and a bounded knapsack (dynamic programming over reachable sums, each length as often
as documents of it are left) hits the words that remain. Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.ranking import global_rank
from .common import discard, if_small, materialize, packed, quoted, table, word_count

SEED = 42


def fill_levels(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds target to (key, source_size, weight). One row comes to the driver for each round of resharing."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, cap, level = share * total, F.col("source_size") * F.lit(float(most)), None
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        held, weight = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if not weight:
            return sources.withColumn("target", cap)
        new = max(0.0, budget - (held or 0.0)) / weight
        if new == level:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        level = new


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below `budget` as can be.

    lengths: distinct, positive, ascending. All but about two of the longest documents' words are spread evenly over the lengths;
    the knapsack's table is then as wide as a few documents, whatever the budget.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.astype(np.int64)
    if budget <= 0 or not len(lengths):
        return take
    part, carry = max(0, budget - 2 * int(lengths[-1])) / total, 0.0
    for i in range(len(lengths) - 1, -1, -1):
        want = int(counts[i]) * int(lengths[i]) * part + carry
        take[i] = min(int(counts[i]), int(want // int(lengths[i])))
        carry = want - int(take[i]) * int(lengths[i])
    rest = budget - int((lengths * take).sum())
    full, reach = (1 << (rest + 1)) - 1, 1
    by = np.full(rest + 1, -1, dtype=np.int64)  # the item that reached a sum first
    items: list[tuple[int, int]] = []
    for i, n in enumerate(lengths.tolist()):
        left, step = min(int(counts[i] - take[i]), rest // n), 1
        while left > 0 and not reach >> rest & 1:
            step = min(step, left)
            new = (reach << (step * n)) & full & ~reach
            if new:
                at = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), dtype=np.uint8), bitorder="little"))
                by[at] = len(items)
                items.append((i, step))
                reach |= new
            left, step = left - step, step * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    while at:
        i, step = items[by[at]]
        take[i] += step
        at -= step * int(lengths[i])
    return take


def _mixed(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """rows (rid, doc, size, source) with source_size, target and copies, and the tables under it. What decides is a row for each length of each source, and the few rows that are ranked:
    `rows` itself, which may carry texts, is not shuffled while those are small."""
    key = F.when(F.col("source").isNotNull(), F.concat(F.lit("="), F.col("source").cast("string"))).otherwise(F.lit("~"))
    rows = rows.withColumn("key", key).withColumn("o", F.xxhash64(F.lit(seed), F.col("doc"))).withColumn("sub", F.shiftright("o", 52))
    sized = materialize(rows.select("rid", "key", "size", "o", "sub"), "sized")
    hist = materialize(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "lengths")
    sources = global_rank(hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "key")
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("rank") % len(weights)).cast("int")]
    sources = materialize(fill_levels(sources.select("key", "source_size", weight.alias("weight")), share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = sources.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    def fit(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("size")
        return pd.DataFrame({"key": p["key"], "size": p["size"], "n": p["n"], "k": fit_lengths(p["size"].to_numpy(), p["n"].to_numpy(), int(p["rest"].iloc[0]))})

    fitted = hist.where("size > 0").join(budgets.select("key", "rest"), "key").groupBy("key").applyInPandas(fit, "key string, size long, n long, k long")
    fitted = materialize(fitted, "fitted")
    # Of each length, the k first by hash: whole ranges of the hash are taken until one range must be cut, and rows are ranked in that alone.
    some = sized.join(fitted.where("k > 0 and k < n").select("key", "size", "k"), ["key", "size"])
    subs = some.groupBy("key", "size", "k", "sub").agg(F.count("*").alias("c"))
    subs = subs.withColumn("upto", F.sum("c").over(W.partitionBy("key", "size").orderBy("sub").rowsBetween(W.unboundedPreceding, 0)))
    # The first range that holds more than are still to be taken; k < n, so there is one.
    cut = materialize(subs.where("upto > k and upto - c <= k").select("key", "size", "sub", (F.col("k") - F.col("upto") + F.col("c")).alias("cut")), "ranges")
    ranked = sized.join(cut.where("cut > 0"), ["key", "size", "sub"]).withColumn("r", F.row_number().over(W.partitionBy("key", "size", "sub").orderBy("o", "rid")))
    last = materialize(ranked.where("r <= cut").select("rid", F.lit(1).alias("last")), "last")
    rules = hist.select("key", "size").join(budgets.select("key", "source_size", "target", "whole"), "key")
    rules = rules.join(fitted.select("key", "size", (F.col("k") == F.col("n")).alias("every")), ["key", "size"], "left")
    rules = materialize(rules.join(cut.select("key", "size", F.col("sub").alias("below")), ["key", "size"], "left"), "rules")
    out = rows.join(if_small(rules), ["key", "size"]).join(if_small(last), "rid", "left")
    first = F.col("every") | (F.col("sub") < F.col("below"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.coalesce(first, F.lit(False)), 1).otherwise(F.coalesce("last", F.lit(0)))).otherwise(0)
    discard(sized, hist, sources, fitted, cut)
    return out.withColumn("copies", copies.cast("long")), [rules, last]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """(rid, doc, size, source_size, target, copies), one row for each row of docs; rid numbers the rows.

    Sizes are word counts (null text: 0). A null source is a source. Documents without words are never taken. Rows with
    equal ids are rows of their own; which of them is taken is immaterial, as they differ in nothing that counts. Other columns take no part,
    whatever their names. No rows give none. Of one length of one source, only documents in the one range of hashes (1 in 4096) that is cut through are ranked.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), quoted(id_col).alias("doc"), word_count(quoted(text_col)).alias("size"), quoted(source_col).alias("source"))
    rows = materialize(rows, "rows")
    out, under = _mixed(rows, weights, share, most, seed)
    out = materialize(out.select("rid", "doc", "size", "source_size", "target", "copies"), "mixed")
    discard(rows, *under)
    return out


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """docs with each row as often as mix() takes it, and docs' own columns and values, whatever their names. Rows are numbered once, in a written copy, so that
    what is counted is what is taken."""
    rows = materialize(packed(docs).withColumn("rid", F.monotonically_increasing_id()).withColumn("size", word_count(F.col("row")[text_col])), "rows")
    rows = rows.select("rid", "row", "size", F.col("row")[id_col].alias("doc"), F.col("row")[source_col].alias("source"))
    taken, _ = _mixed(rows, weights, share, most, seed)
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
