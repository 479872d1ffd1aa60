"""The model over tables: losses of windows, replies to prompts, and the held-out evaluation. Weights go to the executors as one broadcast variable of a size known beforehand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import perplexity
from ..functions.text import has_pii
from ..functions.tokens import decoded
from ..operators import stats
from ..schema import ME, OTHER, TURN_END
from .decoder import Params, Shape, forward, token_losses
from .generate import Sampling, reply_ids

BATCH = 16


def window_losses(windows: DataFrame, shape: Shape, p: Params, batch: int = BATCH) -> DataFrame:
    """(window_no, losses) for windows (window_no, ids) of context + 1 tokens: the loss of each token after the first."""
    held = windows.sparkSession.sparkContext.broadcast((shape, p))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape, p = held.value
        for b in batches:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                ids = np.stack(part["ids"].to_list()).astype(np.int64)
                losses = token_losses(forward(shape, p, ids[:, :-1])[0], ids[:, 1:])
                yield pd.DataFrame({"window_no": part["window_no"], "losses": list(losses.astype(np.float64))})

    return windows.select("window_no", "ids").mapInPandas(run, "window_no long, losses array<double>")


def mean_loss(losses: DataFrame) -> DataFrame:
    """Mean over windows of their mean losses, weighted by the windows' sizes; with its perplexity. No windows give null."""
    each = losses.select(F.size("losses").alias("n"), F.aggregate("losses", F.lit(0.0), lambda s, x: s + x).alias("total"))
    out = each.agg(F.try_divide(F.sum("total"), F.sum("n")).alias("loss"), F.count("*").alias("windows"))
    return out.withColumn("perplexity", perplexity(F.col("loss")))


def own_turn_loss(windows: DataFrame, losses: DataFrame, me: int, other: int, turn_end: int) -> DataFrame:
    """Mean loss of the tokens in one's own turns; the state starts off at each window."""
    inputs = windows.select("window_no", F.posexplode(F.slice("ids", 1, F.size("ids") - 1)).alias("pos", "token"))
    masked = stats.role_mask(inputs, ["window_no"], "pos", "token", me, other, turn_end)
    each = losses.select("window_no", F.posexplode("losses").alias("pos", "loss"))
    return stats.masked_mean(masked.join(each, ["window_no", "pos"]), "loss")


def prompts_of(windows: DataFrame, context: int, samples: int) -> DataFrame:
    """(key, prompt) of the first `samples` windows: their first max(8, context / 2) tokens."""
    return windows.where(F.col("window_no") < samples).select(F.col("window_no").alias("key"), F.slice("ids", 1, max(8, context // 2)).alias("prompt"))


def generated(prompts: DataFrame, shape: Shape, p: Params, stop: set[int], how: Sampling = Sampling()) -> DataFrame:
    """(key, ids) for prompts (key, prompt); the seed of a row is how's plus its key, so that no order or partitioning matters."""
    held = prompts.sparkSession.sparkContext.broadcast((shape, p))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape, p = held.value
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "ids": [reply_ids(shape, p, [int(i) for i in x], stop, how.seeded(int(k))) for k, x in zip(b["key"], b["prompt"], strict=True)]})

    return prompts.select("key", "prompt").mapInPandas(run, "key long, ids array<int>")


def memorization(replies: DataFrame, train: DataFrame, tokenizer: str, sizes: tuple[int, ...] = (8, 16)) -> dict:
    """Totals over replies (key, ids) against the train stream's windows of tokens: possible and matching n-grams by size, the largest size that matched, and replies
    with an identifier. No text is kept."""
    out = {"generation_samples": replies.count(), "matched_text_persisted": False}
    totals = {}
    for n in sizes:
        r = stats.ngram_overlap(train, replies, "key", n, first=stats.FIRST_GRAMS).agg(F.coalesce(F.sum("possible"), F.lit(0)).alias("p"), F.coalesce(F.sum("matched"), F.lit(0)).alias("m")).first()
        totals[n] = r.m
        out |= {f"generated_{n}grams": r.p, f"matching_train_{n}grams": r.m}
    out["longest_detected_exact_match_tokens"] = max([0, *(n for n, m in totals.items() if m)])
    out["generations_with_obvious_pii_pattern"] = replies.where(has_pii(decoded(F.col("ids"), tokenizer))).count()
    return out


def evaluate(streams: dict[str, DataFrame], shape: Shape, p: Params, tokenizer: str, ids: dict[str, int | None], samples: int = 20) -> dict:
    """The report on held-out splits. streams: train, validation and test as (pos, token); ids: of the control tokens."""
    context, out = shape.max_sequence_length, {"context_length": shape.max_sequence_length, "parameter_count": sum(a.size for a in p.values())}
    windows = {n: stats.windows(streams[n], context) for n in ("validation", "test")}
    for n, w in windows.items():
        losses = window_losses(w, shape, p)
        r = mean_loss(losses).first()
        if not r.windows:
            raise ValueError(f"{n} has no whole window")
        out |= {f"{n}_loss": r.loss, f"{n}_perplexity": r.perplexity}
        if n == "test":
            roles = [ids.get(t) for t in (ME, OTHER, TURN_END)]
            own = own_turn_loss(w, losses, *roles).first() if None not in roles else None
    out |= {"me_turn_test_loss": own and own.loss, "me_turn_test_tokens": own.tokens if own else 0, "me_turn_test_perplexity": float(np.exp(min(own.loss, 50))) if own and own.loss is not None else None}
    out |= {f"{n}_tokens": s.count() for n, s in streams.items()}
    base = stats.unigram_loss(streams["train"], streams["test"], shape.vocab_size).first()
    out |= {"unigram_test_loss": base.loss, "unigram_test_perplexity": base.perplexity, "beats_unigram_baseline": out["test_loss"] < base.loss}
    stop = {ids[t] for t in ("<|turn_end|>", "<|eos|>") if ids.get(t) is not None}
    replies = generated(prompts_of(windows["test"], context, samples), shape, p, stop, Sampling(max_new_tokens=32))
    return out | {"memorization": memorization(replies, stats.gram_rows(streams["train"]), tokenizer)}
