"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Grades, from worst to best: 0 toxic, 1 low quality, 2 good. One weight vector is shared by all grades; P(grade >= j) = sigmoid(score - t_j) with
ordered thresholds t_1 < t_2. A word that stands in the text n times adds 1 + ln n times the weights of its hashed features (the word, its first bytes, its end, its
case), over the root of the number of distinct words; shares (distinct words, capitals, symbols) and length add theirs once.
The expected grade is the sum of the tail probabilities; documents are selected by P(grade = 2).

The model is fitted on the driver from at most `sample` labelled documents, those with the smallest hash of their id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, packed, quoted, table

DIM, SAMPLE, EPOCHS, BATCH, RATE, DECAY, THRESHOLD, CACHE, FEWEST_DOCS = 1 << 18, 8192, 12, 128, 1.0, 1e-3, 0.5, 150_000, 8
SYMBOLS = frozenset(b"#*$%&|<>!")


def word_features(word: bytes) -> list[int]:
    low = word.lower()
    out = [crc32(b"w" + low), crc32(b"4" + low[:4]), crc32(b"5" + low[:5]), crc32(b"e" + low[-2:])]
    if len(word) > 1 and low != word and word.upper() == word:
        out.append(crc32(b"capitals"))
    if word[-1] in SYMBOLS:
        out.append(crc32(b"symbol" + word[-1:]))
    return [x % DIM for x in out]


def text_features(words: list[bytes]) -> list[int]:
    """Features of the whole text, one of each kind."""
    n = len(words)
    if not n:
        return [crc32(b"empty") % DIM]
    text = b" ".join(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    caps = sum(text.count(bytes([c])) for c in range(65, 91)) / len(text)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS) / len(text)
    kinds = (b"distinct%d" % (10 * len(set(words)) // n if n > 20 else 99), b"again%d" % min(9, 20 * same // n), b"caps%d" % min(9, int(20 * caps)), b"symbols%d" % min(9, int(40 * symbols)), b"size%d" % n.bit_length())
    return [crc32(k) % DIM for k in kinds]


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: tuple[float, float]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2)."""
        t = np.asarray(self.thresholds)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -60, 60)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 42) -> Ordinal:
    """rows: (grade, feature ids, values). Adagrad on the negative log likelihood; no rows give a model that keeps all."""
    w, g2 = np.zeros(DIM), np.full(DIM, 1e-8)
    theta, tg2 = np.array([-1.0, 1.0]), np.full(2, 1e-8)  # t_1, and the log of what t_2 is above it
    if not rows:
        return Ordinal(w.astype(np.float32), (-10.0, -9.0))
    y = np.array([r[0] for r in rows])
    df = np.bincount(np.concatenate([r[1] for r in rows]), minlength=DIM)
    rare = np.where(df >= FEWEST_DOCS, np.log((1 + len(rows)) / (1 + df)) + 0.1, 0)  # features of few documents count for more, those of hardly any not at all
    kept, kept_theta, n_kept = np.zeros(DIM), np.zeros(2), 0
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            ids, values = np.concatenate([rows[i][1] for i in pick]), np.concatenate([rows[i][2] for i in pick])
            values = values * rare[ids]
            owner = np.repeat(np.arange(len(pick)), [len(rows[i][1]) for i in pick])
            score = np.bincount(owner, values * w[ids], minlength=len(pick))
            gap = math.exp(theta[1])
            s1, s2 = (1 / (1 + np.exp(-np.clip(score - t, -60, 60))) for t in (theta[0], theta[0] + gap))
            mid, grade = np.maximum(s1 - s2, 1e-9), y[pick]
            d = np.select([grade == 0, grade == 1], [-s1, 1 - s1 - s2], 1 - s2)  # of the log likelihood, by score
            d1 = np.select([grade == 0, grade == 1], [s1, -s1 * (1 - s1) / mid], 0.0)
            d2 = np.select([grade == 0, grade == 1], [0.0 * s1, s2 * (1 - s2) / mid], -(1 - s2))
            grad = np.bincount(ids, values * d[owner], minlength=DIM) / len(pick) - DECAY * w
            g2 += grad**2
            w += RATE * grad / np.sqrt(g2)
            tg = np.array([(d1 + d2).mean(), d2.mean() * gap])
            tg2 += tg**2
            theta += RATE * tg / np.sqrt(tg2)
            if epoch >= EPOCHS // 2:  # the mean of the later steps
                kept, kept_theta, n_kept = kept + w, kept_theta + theta, n_kept + 1
    w, theta = kept / n_kept, kept_theta / n_kept
    return Ordinal((w * rare).astype(np.float32), (float(theta[0]), float(theta[0] + math.exp(theta[1]))))


def _counted(words: list[bytes]) -> tuple[list[bytes], list[float]]:
    """The distinct words in the order in which they appear, and what each counts."""
    counts = Counter(words)
    scale = 1 / math.sqrt(max(1, len(counts)))
    return list(counts), [scale if n == 1 else scale * (1 + math.log(n)) for n in counts.values()]


def _vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    feats = [(word_features(w), x) for w, x in zip(*_counted(words), strict=True)]
    ids, at = np.unique(np.array([f for fs, _ in feats for f in fs], dtype=np.int64), return_inverse=True)
    values = np.bincount(at, [x for fs, x in feats for _ in fs], minlength=len(ids))
    whole = np.array(text_features(words), dtype=np.int64)
    return np.concatenate([ids, whole]).astype(np.int32), np.concatenate([values, np.ones(len(whole))]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ordinal:
    """labels: doc_id, quality 0/1, toxic 0/1; rows with a null in any of them are left out. Of labels with one id the worst grade counts, and of documents with
    one id the first text by code points: one row an id comes to the driver."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    grade = F.when(toxic.isNull() | good.isNull(), None).when(toxic, 0).when(good, 2).otherwise(1)
    rated = labels.select(F.col("doc_id").cast("long").alias("doc"), grade.alias("grade")).where("doc is not null and grade is not null").groupBy("doc").agg(F.min("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc"), "doc").limit(sample)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_vector(t) for t in b["text"]]
            yield pd.DataFrame({"doc": b["doc"], "grade": b["grade"], "ids": [i.tobytes() for i, _ in rows], "vals": [v.tobytes() for _, v in rows]})

    found = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text")).join(F.broadcast(rated), "doc")
    found = found.groupBy("doc", "grade").agg(F.min("text").alias("text"))
    rows = found.mapInPandas(features, "doc long, grade int, ids binary, vals binary").toLocalIterator()
    seen = {r.doc: (r.grade, np.frombuffer(r.ids, dtype=np.int32), np.frombuffer(r.vals, dtype=np.float32)) for r in rows}
    return fit([seen[d] for d in sorted(seen)])


def grade(docs: DataFrame, model: Ordinal, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, expected_grade, clean (P(grade = 2)) and kept (clean >= threshold). Null and empty texts are graded by their length alone
    and never kept; long texts are read whole. Columns that docs has already keep their names and values: a result of the same name gets an underscore.
    The model is 1 MB, whatever the corpus."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    known: dict[bytes, float] = {}

    @F.pandas_udf("n_words long, expected_grade double, clean double")
    def score(texts: pd.Series) -> pd.DataFrame:
        m = held.value
        w = m.weights.astype(np.float64)

        def value(word: bytes) -> float:
            v = float(w[word_features(word)].sum())
            if len(known) >= CACHE:
                known.clear()
            known[word] = v
            return v

        n, s = [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            distinct, weights = _counted(words)
            got = list(map(known.get, distinct))
            if None in got:
                got = [value(x) if v is None else v for x, v in zip(distinct, got, strict=True)]
            n.append(len(words))
            s.append(math.sumprod(got, weights) + float(w[text_features(words)].sum()))
        tails = m.tails(np.array(s, dtype=np.float64).reshape(-1))
        return pd.DataFrame({"n_words": n, "expected_grade": tails.sum(axis=1), "clean": tails[:, 1]})

    g, names = F.col("graded"), free_names(docs, ["n_words", "expected_grade", "clean", "kept"])
    out = packed(docs).withColumn("graded", score(F.col("row")[text_col]))
    results = (g["n_words"], g["expected_grade"], g["clean"], (g["clean"] >= threshold) & (g["n_words"] > 0))
    return out.select("row.*", *[r.alias(n) for r, n in zip(results, names, strict=True)])


def keep(docs: DataFrame, model: Ordinal, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that grade() keeps, with docs' own columns."""
    kept = free_names(docs, ["n_words", "expected_grade", "clean", "kept"])[-1]
    return grade(docs, model, text_col, threshold).where(F.col(kept)).select(docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return grade(docs, model).drop("text")
