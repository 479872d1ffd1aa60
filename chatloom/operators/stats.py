"""Token statistics: windows, batches, frequencies, unigram baseline, role mask, n-gram overlap, sampling filters, model choice."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import grams, parameter_count, perplexity
from ..plans.ranking import global_offset, global_rank
from ..plans.written import written

CHECKSUM = (1 << 63) - 1
#: Fixed value: positions of the train stream whose n-grams count as known.
FIRST_GRAMS = 2_000_000
#: Distinct n-grams that a join may send to all executors (at 16 numbers each, some 40 MB).
BROADCAST_GRAMS = 1 << 18
#: Rows of an epoch's order that a task hands on at a time.
EPOCH_ROWS = 1 << 18


def token_report(docs: DataFrame, by: str, ids: str = "ids") -> DataFrame:
    """By split: sessions, tokens, and the sum of the ids modulo 2^63 - 1. ids: array of numbers."""
    total = F.aggregate(F.col(ids), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    return docs.groupBy(by).agg(F.count("*").alias("sessions"), F.sum(F.size(ids)).cast("long").alias("tokens"), (F.sum(total) % F.lit(CHECKSUM)).cast("long").alias("checksum"))


def token_stream(docs: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, pos, token): all documents' ids end to end in the order of `key`, which tells rows apart. Only keys and sizes are put in order; the ids are joined
    to their offsets."""
    placed = global_offset(docs.select(key, F.size(ids).cast("long").alias("n")), key, size="n").select(key, "at")
    return docs.select(key, ids).join(placed, key).select(key, "at", F.posexplode(ids).alias("i", "token")).select(key, (F.col("at") + F.col("i")).alias("pos"), "token")


def windows(stream: DataFrame, context: int) -> DataFrame:
    """(window_no, ids) for every full window of context + 1 tokens."""
    n = context + 1
    w = stream.groupBy(F.floor(F.col("pos") / n).alias("window_no")).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return w.where(F.size("x") == n).select("window_no", F.transform("x", lambda x: x["token"]).alias("ids"))


def doc_windows(docs: DataFrame, key: str, context: int, ids: str = "ids") -> DataFrame:
    """windows(token_stream(docs, key, ids), context) from documents cut into one piece for each window they reach into, instead of a row for each token. Sizes tell which windows are
    full, so that counting them, or asking for their numbers alone, leaves the ids unread."""
    n = context + 1
    placed = global_offset(docs.select(key, F.size(ids).cast("long").alias("n")), key, size="n").where("n > 0").select(key, "at", "n")
    end = F.col("at") + F.col("n")
    cut = docs.select(key, F.col(ids).alias("ids")).join(placed, key).select("ids", "at", end.alias("end"), F.explode(F.sequence(F.floor(F.col("at") / n), F.floor((end - 1) / n))).alias("window_no"))
    cut = cut.withColumn("pos", F.greatest("at", F.col("window_no") * n)).withColumn("k", F.least("end", (F.col("window_no") + 1) * n) - F.col("pos"))
    piece = F.struct("pos", F.slice("ids", (F.col("pos") - F.col("at") + 1).cast("int"), F.col("k").cast("int")).alias("piece"))
    w = cut.groupBy("window_no").agg(F.sum("k").alias("k"), F.sort_array(F.collect_list(piece)).alias("x"))
    return w.where(F.col("k") == n).select("window_no", F.flatten(F.transform("x", lambda x: x["piece"])).alias("ids"))


def inputs_targets(packed: DataFrame, context: int) -> DataFrame:
    return packed.select("window_no", F.slice("ids", 1, context).alias("inputs"), F.slice("ids", 2, context).alias("targets"))


def batched(packed: DataFrame, size: int) -> DataFrame:
    """(batch, inputs, targets): windows stacked `size` at a time in their order, the last batch as it comes out; each an array of arrays of int."""
    rows = packed.groupBy(F.floor(F.col("window_no") / size).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("window_no", "ids"))).alias("x"))
    cut = lambda at: F.transform("x", lambda w: F.slice(w["ids"], at, F.size(w["ids"]) - 1).cast("array<int>"))
    return rows.select("batch", cut(1).alias("inputs"), cut(2).alias("targets"))


def _permuted(count: int, seed: int, folder: str) -> np.ndarray:
    """numpy's permutation of `count` by a seed, in a file of `folder`: the system keeps as much of it in memory as it has room for. Narrow numbers where they do; the draws are the same."""
    if count <= 0:
        return np.zeros(0, np.int64)
    order = np.memmap(f"{folder}/order", dtype=np.int32 if count < 1 << 31 else np.int64, mode="w+", shape=(count,)).view(np.ndarray)
    for at in range(0, count, EPOCH_ROWS):
        order[at : at + EPOCH_ROWS] = np.arange(at, min(count, at + EPOCH_ROWS))
    np.random.default_rng(seed).shuffle(order)
    return order


def epoch_batches(spark: SparkSession, count: int, size: int, seed: int, epoch: int, first: int = 0) -> DataFrame:
    """(batch, slot, window_no): an epoch's order of windows, numpy's permutation of `count` by seed + epoch, in batches of `size` from batch `first` on; the last may be smaller. Each
    draw depends on those before, so one task makes the order, in a file of its own temp folder, and hands it on in slices. The driver holds none of it: Spark takes the order for as small
    as the one row it is made from, and would send it through the driver to all executors, so it asks for merge joins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with tempfile.TemporaryDirectory() if len(b) else contextlib.nullcontext("") as folder:
                order = _permuted(count if len(b) else 0, seed + epoch, folder)
                for start in range(first * size, len(order), EPOCH_ROWS):
                    at = np.arange(start, min(len(order), start + EPOCH_ROWS))
                    yield pd.DataFrame({"batch": at // size, "slot": at % size, "window_no": order[at].astype(np.int64)})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "batch long, slot long, window_no long").hint("merge")


def gather(packed: DataFrame, order: DataFrame) -> DataFrame:
    """(batch, slot, window_no, ids): the windows that an order asks for."""
    return order.join(packed.select("window_no", "ids"), "window_no").select("batch", "slot", "window_no", "ids")


def frequencies(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.groupBy(token).agg(F.count("*").alias("n"))


def dense_frequencies(tokens: DataFrame, vocab_size: int, token: str = "token") -> DataFrame:
    """(token, n) of every id below vocab_size, 0 for those that do not occur."""
    ids = tokens.sparkSession.range(vocab_size).select(F.col("id").alias(token))
    return ids.join(frequencies(tokens, token), token, "left").select(token, F.coalesce("n", F.lit(0)).alias("n"))


def split_counts(tokens: DataFrame, test: Column, token: str = "token") -> DataFrame:
    """(token, n, m): counts outside and inside the test part, in one pass."""
    return tokens.groupBy(token).agg(F.count_if(~test).alias("n"), F.count_if(test).alias("m"))


def loss_of_counts(counts: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """loss: mean of -ln((n + 1) / (N + V)) over the m test tokens of counts (token, n, m); and its perplexity. V: the tokens with n > 0, unless given."""
    counts = written(counts, "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    loss = F.try_divide(F.sum(F.col("m") * -F.log((F.col("n") + 1) / F.lit(float(n + (vocab_size or v))))), F.sum("m"))
    out = counts.where("m > 0").agg(loss.alias("loss"), F.coalesce(F.sum("m"), F.lit(0)).alias("test_tokens"))
    return out.withColumn("perplexity", perplexity(F.col("loss")))


def unigram_loss(train: DataFrame, test: DataFrame, vocab_size: int | None = None, token: str = "token") -> DataFrame:
    """loss_of_counts over two tables of tokens."""
    both = train.select(F.col(token), F.lit(False).alias("_test")).unionByName(test.select(F.col(token), F.lit(True).alias("_test")))
    return loss_of_counts(split_counts(both, F.col("_test"), token), vocab_size)


def weighted_mean(batches: DataFrame, loss: str = "loss", rows: str = "rows") -> DataFrame:
    """The mean loss of batches by how many rows they have; null without rows."""
    return batches.agg(F.try_divide(F.sum(F.col(loss) * F.col(rows)), F.sum(rows)).alias("loss"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows"))


def role_mask(tokens: DataFrame, window: list[str], pos: str, token: str, me, other, turn_end) -> DataFrame:
    """Adds mask: whether a position lies in one's own turn. The role token switches it from its own position on, the end token after it."""
    t = F.col(token)
    after = F.when(t == me, True).when(t.isin(other, turn_end), False)
    before = F.last(after, ignorenulls=True).over(W.partitionBy(*window).orderBy(pos).rowsBetween(W.unboundedPreceding, -1))
    return tokens.withColumn("mask", F.when(t == me, True).when(t == other, False).otherwise(F.coalesce(before, F.lit(False))))


def masked_mean(tokens: DataFrame, loss: str, mask: str = "mask") -> DataFrame:
    return tokens.agg(F.avg(F.when(F.col(mask), F.col(loss))).alias("loss"), F.count_if(mask).alias("tokens"))


def gram_rows(stream: DataFrame, most: int = 16, block: int = 4096) -> DataFrame:
    """(at, ids): a stream (pos, token) in rows of `block` tokens and the most - 1 that follow, so that every run of `most` tokens lies in some row. `at` is the first token's place."""
    b = F.floor(F.col("pos") / block)
    homes = F.when((F.col("pos") % block < most - 1) & (b > 0), F.array(b - 1, b)).otherwise(F.array(b))
    rows = stream.select("pos", "token", F.explode(homes).alias("b")).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return rows.select((F.col("b") * block).alias("at"), F.transform("x", lambda x: x["token"]).alias("ids"))


def known_grams(train: DataFrame, n: int, ids: str = "ids", first: int | None = None) -> DataFrame:
    """(g): the distinct n-grams of train; with `first`, of its first so many positions, of which `at` tells each row's first."""
    g = train.select(*([F.col("at")] if first is not None else []), F.posexplode(grams(F.col(ids), n)).alias("i", "g"))
    return (g.where(F.col("at") + F.col("i") < first) if first is not None else g).select("g").distinct()


def ngram_overlap(train: DataFrame, generated: DataFrame, key: str, n: int, ids: str = "ids", first: int | None = None) -> DataFrame:
    """By generated row: possible (n-gram positions) and matched (positions whose n-gram is in train). `first`: see known_grams. Few known n-grams (counted) go to all executors, and
    the generated ones are then not shuffled."""
    known = written(known_grams(train, n, ids, first), "grams")
    if known.count() <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    hits = generated.select(key, F.explode(grams(F.col(ids), n)).alias("g")).join(known, "g", "left_semi").groupBy(key).agg(F.count("*").alias("matched"))
    possible = generated.select(key, F.greatest(F.size(ids) - (n - 1), F.lit(0)).cast("long").alias("possible")).groupBy(key).agg(F.sum("possible").alias("possible"))
    return possible.join(hits, key, "left").select(key, "possible", F.coalesce("matched", F.lit(0)).alias("matched"))


def overlap_totals(overlaps: dict[int, DataFrame]) -> DataFrame:
    """(size, possible, matched): the sums by size."""
    parts = [df.agg(F.coalesce(F.sum("possible"), F.lit(0)).alias("possible"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched")).select(F.lit(n).alias("size"), "possible", "matched") for n, df in sorted(overlaps.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def longest_match(overlaps: dict[int, DataFrame]) -> DataFrame:
    """The largest of the sizes at which anything matched, or 0."""
    return overlap_totals(overlaps).agg(F.coalesce(F.max(F.when(F.col("matched") > 0, F.col("size"))), F.lit(0)).alias("longest_match"))


def softmax(scores: DataFrame, key: str, score: str, temperature: float) -> DataFrame:
    """Adds p; at a temperature of 0 or less the first of the highest scores has it all."""
    w = W.partitionBy(key)
    if temperature <= 0:
        top = F.row_number().over(w.orderBy(F.desc(score), "idx"))
        return scores.withColumn("p", F.when(top == 1, 1.0).otherwise(0.0))
    e = scores.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def repetition_penalty(score: Column, generated: Column, rate: float) -> Column:
    return F.when(generated, F.when(score > 0, score / rate).otherwise(score * rate)).otherwise(score)


def top_p(probabilities: DataFrame, key: str, p: float) -> DataFrame:
    """The most likely entries up to the first at which their sum reaches p; at least one."""
    o = W.partitionBy(key).orderBy(F.desc("p"), "idx")
    x = probabilities.withColumn("_c", F.sum("p").over(o.rowsBetween(W.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(o))
    return x.where((F.col("_c") - F.col("p") < p) | (F.col("_r") == 1)).drop("_c", "_r")


def weighted_draw(probabilities: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, idx): one entry of each key, drawn by its probability p: the first at which the running sum, in the order of idx, is above a number in [0, 1) that a hash
    of seed and key gives. Sums that end short of that number by rounding give the last entry with a probability."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))
    o = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    x = probabilities.where("p > 0").withColumn("_c", F.sum("p").over(o)).withColumn("_u", u)
    hit = F.min(F.when(F.col("_c") > F.col("_u"), F.col("idx")))
    return x.groupBy(key).agg(F.coalesce(hit, F.max("idx")).alias("idx"))


def select_model(candidates: DataFrame, train_tokens: int, ratio: float = 10.0, enough: int = 1_000_000) -> DataFrame:
    """candidates: (place, name, vocab, hidden, layers, intermediate, tied). The largest with `ratio` tokens a parameter, else the first."""
    c = candidates.withColumn("parameters", parameter_count(*[F.col(x) for x in ("vocab", "hidden", "layers", "intermediate", "tied")]))
    c = c.withColumn("eligible", F.coalesce(F.try_divide(F.lit(float(train_tokens)), "parameters") >= ratio, F.lit(False)))
    best = F.max_by("name", F.when(F.col("eligible"), F.col("parameters")))
    return c.agg(F.coalesce(best, F.min_by("name", "place")).alias("selected"), (~F.bool_or("eligible")).alias("memorization_prone"), F.lit(train_tokens >= enough).alias("enough_tokens"))


def _carried(sizes: DataFrame, pick) -> DataFrame:
    """(_k, _c): what `pick` takes from the values _v of all blocks before a block. The blocks, one row for 4096 evaluations, are dealt by thousands."""
    s = sizes.withColumn("_t", F.floor(F.col("_k") / 1024))
    tops = s.groupBy("_t").agg(pick("_v").alias("_v"))
    rows, at, parts = [], None, sorted(tops.collect())
    for t, v in parts:
        rows.append((t, at))
        at = v if at is None else at if v is None else (min if pick is F.min else max)(at, v)
    starts = s.sparkSession.createDataFrame(rows, f"_t long, _a {dict(sizes.dtypes)['_v']}")
    within = pick("_v").over(W.partitionBy("_t").orderBy("_k").rowsBetween(W.unboundedPreceding, -1))
    take = F.least if pick is F.min else F.greatest
    return s.withColumn("_w", within).join(F.broadcast(starts), "_t").select("_k", take("_w", "_a").alias("_c"))


def early_stopping(metrics: DataFrame, patience: int, step: str = "step", loss: str = "loss") -> DataFrame:
    """Adds best (so far) and stale (evaluations since a strict improvement), up to the evaluation at which stale reaches patience. metrics is a training
    log: one row an evaluation. Runs over blocks of 4096 evaluations and carries the smallest loss and the last improvement from block to block."""
    ranked = global_rank(metrics, step, name="_r").withColumn("_k", F.floor(F.col("_r") / 4096))
    o = W.partitionBy("_k").orderBy("_r")
    lows = _carried(ranked.groupBy("_k").agg(F.min(loss).alias("_v")), F.min)
    m = ranked.join(lows, "_k").withColumn("_b", F.least("_c", F.min(loss).over(o.rowsBetween(W.unboundedPreceding, -1)))).drop("_c")
    m = m.withColumn("improved", F.coalesce(F.col(loss) < F.col("_b"), F.lit(True))).withColumn("best", F.least(loss, F.coalesce("_b", F.col(loss))))
    m = m.withColumn("_i", F.when(F.col("improved"), F.col("_r")))
    last = _carried(m.groupBy("_k").agg(F.max("_i").alias("_v")), F.max)
    m = m.join(last, "_k").withColumn("stale", (F.col("_r") - F.greatest("_c", F.max("_i").over(o))).cast("int"))
    end = m.where(F.col("stale") >= patience).agg(F.min("_r")).first()[0]
    m = m if end is None else m.where(F.col("_r") <= end)
    return m.select(*metrics.columns, "improved", "stale", "best")
