"""Quality rules by line sequence labelling: a linear-chain conditional random field marks lines content or boilerplate.

Viterbi decoding gives each document's most likely labels; the share of its words that lie in content lines decides. The field is
fitted on the driver to at most `sample` labelled documents (smallest hash of the id), from labels of single lines:
* in documents of good quality, lines that repeat an earlier one and notices (licences, cookies, addresses) are boilerplate, all others content;
* in other documents, these lines and all others are boilerplate; but where over a third of a document's lines repeat others, that alone speaks against it, and what its
  other lines are is left open: the field is fitted to the sum over both labels of such lines;
* runs of lines of both kinds of documents are spliced into further sequences, in which labels change at known places.
So a document that mixes both kinds gets a share between 0 and 1. Plain rules on the whole text come before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, packed, quoted, table

SAMPLE, LONGEST, STEPS, RATE, DECAY, SEED = 2048, 64, 120, 0.15, 1e-3, 42
#: Lines that are a run at most when documents are spliced, and the share of repeating lines from which a document's other lines are left open.
RUN, REPEATING = 12, 1 / 3
OPEN = -1
SHARE, FEWEST, REPEATED, WINDOW = 0.5, 20, 30, 8
SPACES = re.compile(r"[\x20\x09-\x0D]")
SYMBOLS = "#*$%&|<>"
NOTICE = re.compile(r"licen[sc]e|copyright|all rights reserved|©|cookie|subscribe|https?://|www\.", re.I)
#: Features: bins of each measure, one-hot, then flags.
BINS = ((3, 6, 11, 21, 51), (0.001, 0.03, 0.1), (0.001, 0.03, 0.1), (0.15, 0.5), (0.05, 0.3), (0.35, 0.6, 0.85), (3.0, 9.0))
FLAGS = 5
FIRST_FLAG = sum(len(b) + 1 for b in BINS)
AGAIN, NOTICED = FIRST_FLAG + 2, FIRST_FLAG + 3
N_FEATURES = FIRST_FLAG + FLAGS + 1
WIDEST = len(BINS) + FLAGS + 1


def line_features(line: str, words: list[str], again: bool) -> list[int]:
    """Indices of the features that hold for a line that has a word."""
    size, n = len(line), len(words)
    symbols = sum(map(line.count, SYMBOLS))
    measures = (n, symbols / size, line.count("!") / size, sum(map(str.isupper, words)) / n, sum(map(str.isdigit, words)) / n, len(set(words)) / n, (size - n + 1) / n)
    out, at = [], 0
    for m, cuts in zip(measures, BINS, strict=True):
        out.append(at + sum(m >= c for c in cuts))
        at += len(cuts) + 1
    last = words[-1][-1]
    flags = (last in ".?…", words[0][0].isupper(), again, bool(NOTICE.search(line)), n > 2 and words[0] == words[1] == words[2])
    return [*out, *(at + i for i, f in enumerate(flags) if f), at + FLAGS]


def lines_of(text: str | None) -> tuple[list[list[int]], list[int], int]:
    """Of the lines with words: features and word counts; and how many of those lines equal an earlier one."""
    feats, counts, seen, dup = [], [], set(), 0
    for line in (text or "").split("\n"):
        words = [w for w in SPACES.split(line) if w]
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            feats.append(line_features(line, words, again))
            counts.append(len(words))
    return feats, counts, dup


@dataclass(frozen=True)
class Field:
    """Label 1 is content. emit: weight of each feature for content against boilerplate; move[a, b], start: log potentials."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decode(self, feats: list[list[int]]) -> list[int]:
        """The most likely labels; between equally likely ones content wins."""
        if not feats:
            return []
        e = self.emit
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b, back = float(self.start[0]), float(self.start[1]) + float(e[feats[0]].sum()), []
        for f in feats[1:]:
            s = float(e[f].sum())
            to0, to1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((to0, to1))
            a, b = (b + m10 if to0 else a + m00), (b + m11 if to1 else a + m01) + s
        label = int(b >= a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def line_labels(good: int, feats: list[list[int]]) -> list[int]:
    """1 content, 0 boilerplate, OPEN unknown, for the lines of a labelled document."""
    plain = [AGAIN not in f and NOTICED not in f for f in feats]
    if good:
        return [int(p) for p in plain]
    repeating = sum(AGAIN in f for f in feats) > REPEATING * len(feats)
    return [OPEN if p and repeating else 0 for p in plain]


def splice(docs: list[tuple[list[int], list[list[int]]]], good: list[int], rng: np.random.Generator) -> list[tuple[list[int], list[list[int]]]]:
    """Sequences of up to LONGEST lines, runs of good and of other documents in turn; half as many as there are documents."""
    sides = [[d for d, g in zip(docs, good, strict=True) if g == k and d[1]] for k in (0, 1)]
    out = []
    for _ in range(len(docs) // 2 if all(sides) else 0):
        labels, feats, side = [], [], int(rng.integers(2))
        for _ in range(int(rng.integers(2, 5))):
            y, f = sides[side][int(rng.integers(len(sides[side])))]
            n = min(len(f), int(rng.integers(1, RUN + 1)))
            at = int(rng.integers(len(f) - n + 1))
            labels += y[at : at + n]
            feats += f[at : at + n]
            side = 1 - side
        out.append((labels[:LONGEST], feats[:LONGEST]))
    return out


def _marginals(score: np.ndarray, move: np.ndarray, start: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded sequences: P(label) by line, and expected label pairs by sequence. score: (n, longest, 2), -inf for a label that cannot be."""
    lse, (n, longest, _) = np.logaddexp, score.shape
    fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    fwd[:, 0] = start + score[:, 0]
    for j in range(1, longest):
        step = score[:, j] + lse(fwd[:, j - 1, :1] + move[0], fwd[:, j - 1, 1:] + move[1])
        fwd[:, j] = np.where(on[:, j, None], step, fwd[:, j - 1])
    for j in range(longest - 2, -1, -1):
        nxt = score[:, j + 1] + bwd[:, j + 1]
        step = lse(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
        bwd[:, j] = np.where(on[:, j + 1, None], step, 0)
    logz = lse(fwd[:, -1, 0], fwd[:, -1, 1])
    prob = np.exp(fwd + bwd - logz[:, None, None]) * on[:, :, None]
    pair = np.exp(fwd[:, :-1, :, None] + move + (score + bwd)[:, 1:, None, :] - logz[:, None, None, None])
    return prob, (pair * on[:, 1:, None, None]).sum(axis=1)


def fit(docs: list[tuple[list[int], list[list[int]]]]) -> Field:
    """docs: (labels of lines, OPEN where unknown; line features). Adam on the mean log likelihood of the known labels: what the field expects given them, less what it
    expects without, by forward and backward sums over pieces of at most LONGEST lines."""
    pieces = [(y[a : a + LONGEST], f[a : a + LONGEST]) for y, f in docs for a in range(0, len(f), LONGEST)]
    if not pieces:
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2))
    n, longest = len(pieces), max(2, max(len(f) for _, f in pieces))
    ids = np.full((n, longest, WIDEST), N_FEATURES, dtype=np.uint8)  # padded with a feature that weighs nothing
    y = np.full((n, longest), OPEN, dtype=np.int8)
    for i, (labels, f) in enumerate(pieces):
        y[i, : len(labels)] = labels
        for j, x in enumerate(f):
            ids[i, j, : len(x)] = x
    on = ids[:, :, 0] < N_FEATURES
    seen = np.array([(y[on] == k).sum() for k in (0, 1)])
    weight = np.minimum(on.sum() / 2 / np.maximum(1, seen), 20)  # both labels weigh the same
    each = np.where(on, np.where(y == OPEN, weight.min(), weight[np.clip(y, 0, 1)]), 0)
    importance = each.sum(axis=1) / np.maximum(1, on.sum(axis=1))
    barred = np.zeros((n, longest, 2))
    barred[:, :, 0][y == 1] = barred[:, :, 1][y == 0] = -1e9
    w = np.zeros(N_FEATURES + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        move, start = w[N_FEATURES : N_FEATURES + 4].reshape(2, 2), w[N_FEATURES + 4 :]
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = np.append(w[:N_FEATURES], 0)[ids].sum(axis=2)
        free, free_pairs = _marginals(score, move, start, on)
        known, known_pairs = _marginals(score + barred, move, start, on)
        diff = (known - free) * importance[:, None, None]
        grad = np.zeros_like(w)
        grad[:N_FEATURES] = np.bincount(ids.ravel(), np.repeat(diff[:, :, 1].ravel(), WIDEST), minlength=N_FEATURES + 1)[:N_FEATURES]
        grad[N_FEATURES : N_FEATURES + 4] = ((known_pairs - free_pairs) * importance[:, None, None]).sum(axis=0).ravel()
        grad[N_FEATURES + 4 :] = diff[:, 0].sum(axis=0)
        grad = grad / on.sum() - DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(w[:N_FEATURES].copy(), w[N_FEATURES : N_FEATURES + 4].reshape(2, 2).copy(), w[N_FEATURES + 4 :].copy())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """labels: doc_id, quality 0/1; rows with a null in either are left out. Half of the sample at most is of good quality.
    `sample` bounds the labelled rows; of those taken, all lines are learnt from, in pieces of LONGEST. Of labels with one id the worse counts, of documents with one
    id the first text by code points: one row an id comes to the driver."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("quality").cast("int").alias("y")).where("doc is not null and y is not null").groupBy("doc").agg(F.min("y").alias("y"))
    parts = [rated.where(F.col("y") == k).orderBy(F.xxhash64("doc"), "doc").limit(sample // 2) for k in (0, 1)]
    rated = parts[0].unionByName(parts[1])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [lines_of(t)[0] for t in b["text"]]
            yield pd.DataFrame({"doc": b["doc"], "y": b["y"], "lines": [b"".join(bytes(f).ljust(WIDEST, b"\xff") for f in g) for g in got]})

    found = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text")).join(F.broadcast(rated), "doc")
    found = found.groupBy("doc", "y").agg(F.min("text").alias("text"))
    rows = sorted(found.mapInPandas(features, "doc long, y int, lines binary").toLocalIterator())
    feats = [[[i for i in r.lines[a : a + WIDEST] if i < 255] for a in range(0, len(r.lines), WIDEST)] for r in rows]
    known, good = [(line_labels(r.y, f), f) for r, f in zip(rows, feats, strict=True)], [r.y for r in rows]
    return fit(known + splice(known, good, np.random.default_rng(SEED)))


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more, the first of them included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def apply_rules(docs: DataFrame, field: Field, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """docs with the measures of SCHEMA. Null and empty texts have no words and fail; the content share of no words is 0. Long texts are read whole.
    Columns that docs has already keep their names and values: a measure of the same name gets an underscore. No rows give none."""

    @F.pandas_udf(SCHEMA)
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        with np.errstate(over="ignore"):
            for t in texts:
                t = t or ""
                words = [w for w in SPACES.split(t) if w]
                feats, counts, dup = lines_of(t)
                repeat, n = repeated_words(words), len(words)
                failed = n < FEWEST or 100 * repeat > REPEATED * n
                content = sum(c for c, y in zip(counts, field.decode(feats), strict=True) if y) / n if n else 0.0
                rows.append((n, sum(map(len, words)), sum(map(t.count, SYMBOLS)), dup, repeat, failed, content, not failed and content >= share))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = packed(docs).withColumn("judged", judge(F.col("row")[text_col]))
    return out.select("row.*", *[F.col("judged")[c].alias(n) for c, n in zip(names, free_names(docs, names), strict=True)])


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


#: Of op10's columns, those that SQL can give; a test holds the query against it.
BASE_SQL = """
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM a),
c AS (SELECT *, list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) AS g FROM b),
d AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM c),
e AS (SELECT doc_id, i FROM d QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
f AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM e) GROUP BY 1)
SELECT c.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(f.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(f.n, 0) > 30 * len(w) AS base_failed
FROM c LEFT JOIN f USING (doc_id)
"""
