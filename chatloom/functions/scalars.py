"""Time and number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_2001_S = 978_307_200
#: Plausible results: 2000-01-01 to 2100-01-01, and 0 for a missing value.
EARLIEST_NS, LATEST_NS = 946_684_800 * 10**9, 4_102_444_800 * 10**9


def epoch2001_to_unix_ns(raw: Column, check: bool = True) -> Column:
    """A time since 2001 in seconds, milli-, micro- or nanoseconds, told apart by its size, as nanoseconds since 1970. Null is 0. Seconds are exact; the
    other units go through doubles."""
    x, size = raw.cast("double"), F.abs(raw.cast("double"))
    seconds = F.when(size >= 1e17, x / 1e9).when(size >= 1e14, x / 1e6).when(size >= 1e11, x / 1e3)
    ns = F.when(raw.isNull(), F.lit(0).cast("long")).when(size >= 1e11, ((seconds + EPOCH_2001_S) * 1e9).cast("long")).otherwise((raw.cast("long") + EPOCH_2001_S) * 10**9)
    if not check:
        return ns
    return F.when((ns == 0) | ns.between(EARLIEST_NS, LATEST_NS), ns).otherwise(F.raise_error(F.concat(F.lit("implausible time: "), raw.cast("string"))).cast("long"))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(50.0)))


def learning_rate(step: Column, total: int, warmup: int, peak: float, low: float) -> Column:
    """Linear warm-up, then a cosine down to `low`."""
    share = F.least((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(1.0))
    return F.when(step < warmup, peak * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(low + (peak - low) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share)))


def parameter_count(vocab: Column, hidden: Column, layers: Column, intermediate: Column, tied: Column) -> Column:
    body = layers * (4 * hidden * hidden + 3 * hidden * intermediate + 2 * hidden) + hidden
    return vocab * hidden + body + F.when(tied, F.lit(0)).otherwise(vocab * hidden)


def grams(ids: Column, n: int) -> Column:
    """All runs of n neighbours; none for a shorter array."""
    return F.when(F.size(ids) >= n, F.transform(F.sequence(F.lit(1), F.size(ids) - n + 1), lambda i: F.slice(ids, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))
