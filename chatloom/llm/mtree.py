"""Exact top-k search by inner product with M-trees and best-first search.

Vectors are integers (floor of a multiple of each component). Equal vectors are one entry that keeps its k + 1 smallest ids, which is
all that a top k can take of them. Entries are dealt to pivots (a bounded sample of vectors) by distance. A pivot's entries are dealt
to salted parts of bounded size, pivots with few entries are put together up to that size; each part is one M-tree: pages of entries with covering radius, and the distance of
each page's centre to its parent's centre. All vectors are in some tree, and the search is exact, so recall is 1.

For a query q and a page with centre c and radius r, no entry scores above <q, c> + |q| r; and as |<q, c> - <q, p>| <=
|q| d(p, c), none scores above <q, p> + |q| (d(p, c) + r), which needs no product with c. The search opens pages by the
best bound first, and stops at a bound below the k-th score so far. Many queries search side by side: in each round every query names its best pages, WAVE times as many as in the round
before, and a page is opened once for all queries that name it, by one matrix product. A query opens so at most some WAVE times the pages that it would alone. Its k-th score goes on from tree to tree
within a task. Bounds are widened by far more than rounding; scores are exact integers: sums of products that float64
may not hold exactly are made of Python's integers, over all vectors of the tree. Vectors that can lead there have trees of their own.

Each tree is sent once, to the task of its salt; the queries go to every salt, in blocks. Where vectors are so far apart that bounds rule out nothing, each query meets all rows: products grow as
queries times rows, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, materialize, quoted, setting, table

PAGE, FANOUT, PART, BLOCK, TREES, PIVOTS, SEED = 64, 16, 8192, 1 << 20, 32, 64, 42
#: Least number of tasks that build trees, and of salts.
LANES = 16
#: Queries that search side by side, growth of their pages from round to round, hits and queries' results that a task holds.
SIDE, WAVE, HITS, HELD = 2048, 4, 1 << 18, 1 << 20
#: Integers up to here make no product of vectors of up to 2048 components that float64 cannot hold. Sums up to SINGLE are exact in float32, too.
NARROW, EXACT, SINGLE = float(1 << 21), float(1 << 53), float(1 << 24)


def build(x: np.ndarray, rng: np.random.Generator) -> dict:
    """An M-tree over the rows of x as flat arrays: for each page its centre, radius, distance to the parent's centre and
    children, which are pages first..last or, in a leaf, rows order[first:last]."""
    pages: list[list] = []
    order = np.arange(len(x))

    def dist(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[rows] - c) ** 2).sum(axis=1))

    pages.append([x.mean(axis=0), 0.0, 0.0, 0, len(x), True])
    todo = [0]
    for at in todo:  # breadth first; a page's children lie side by side
        centre, _, _, a, b, _ = pages[at]
        rows = order[a:b]
        pages[at][1] = float(dist(rows, centre).max()) if b > a else 0.0
        if b - a <= PAGE:
            continue
        n = min(FANOUT, -(-(b - a) // PAGE))
        seeds = x[rng.choice(rows, size=n, replace=False)]
        d2 = (x[rows] ** 2).sum(axis=1)[:, None] - 2 * x[rows] @ seeds.T + (seeds**2).sum(axis=1)[None, :]
        near = d2.argmin(axis=1)
        if (near == near[0]).all():
            near = np.arange(len(rows)) * n // len(rows)
        by = np.argsort(near, kind="stable")
        order[a:b] = rows[by]
        sizes = np.bincount(near, minlength=n)
        first, start = len(pages), a
        for s in sizes[sizes > 0].tolist():
            c = x[order[start : start + s]].mean(axis=0)
            todo.append(len(pages))
            pages.append([c, 0.0, float(np.sqrt(((c - centre) ** 2).sum())), start, start + s, True])
            start += s
        pages[at][3:] = [first, len(pages), False]
    return {"centre": np.array([p[0] for p in pages]), "radius": np.array([p[1] for p in pages]), "parent": np.array([p[2] for p in pages]), "span": np.array([p[3:5] for p in pages]), "leaf": np.array([p[5] for p in pages]), "order": order}


class Best:
    """The k best (score, id) so far of each of m queries, larger scores and then smaller ids first; scores are -inf where there are fewer."""

    def __init__(self, m: int, k: int) -> None:
        self.score, self.id = np.full((m, k), -np.inf), np.zeros((m, k), dtype=np.int64)

    def take(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Puts in the scores and ids found for the queries `of`."""
        k = self.score.shape[1]
        hit = np.unique(of)
        of, score, ids = np.concatenate([of, np.repeat(hit, k)]), np.concatenate([score, self.score[hit].ravel()]), np.concatenate([ids, self.id[hit].ravel()])
        by = np.lexsort((ids, -score, of))
        of, score, ids = of[by], score[by], ids[by]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        top = rank < k
        self.score[of[top], rank[top]], self.id[of[top], rank[top]] = score[top], ids[top]


def search(tree: dict, x: np.ndarray, ids: np.ndarray, sizes: np.ndarray, q: np.ndarray, own: np.ndarray, best: Best, at: np.ndarray) -> None:
    """Puts what a tree holds into the results `best` of the queries q, which stand there at `at`. Each leaves out its `own` id. Rows of x are in the tree's order, sizes[i] ids to row i; no
    product may pass EXACT."""
    centre, radius, parent, span, leaf = tree["centre"], tree["radius"], tree["parent"], tree["span"], tree["leaf"]
    start = np.cumsum(sizes) - sizes
    first = ids[start]
    norm = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-12)
    slack = 1e-6 + 1e-9 * norm * (np.sqrt(centre[0] @ centre[0]) + radius[0])
    narrow = q.astype(x.dtype)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if found:
            of, row, score = (np.concatenate(f) for f in zip(*found, strict=True))
            found.clear()
            n = sizes[row]
            of, score, ids_ = np.repeat(of, n), np.repeat(score, n), ids[np.repeat(start[row] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            other = ids_ != own[of]
            best.take(at[of[other]], score[other], ids_[other])

    top = np.full((len(leaf), len(q)), -np.inf)  # bounds of pages that are known and not opened
    top[0] = q @ centre[0] + norm * radius[0] + slack
    wave = 1
    while True:
        bar = best.score[at, -1]
        top[top < bar] = -np.inf
        named = top > -np.inf
        if not named.any():
            return
        if wave < len(top):
            named &= top >= np.partition(top.T.copy(), -wave, axis=1)[:, -wave]
        wave *= WAVE
        bars, last, hits = bar.astype(x.dtype), best.id[at, -1], 0
        for page in np.flatnonzero(named.any(axis=1)).tolist():
            g = np.flatnonzero(named[page])
            bound, (a, b) = top[page, g], span[page]
            top[page, g] = -np.inf
            if leaf[page]:
                score = x[a:b] @ (narrow if len(g) == len(q) else narrow[g]).T
                row, of = np.divmod(np.flatnonzero(score >= bars[g]), len(g))
                values, of = score[row, of], g[of]
                new = (values > bars[of]) | (first[a + row] < last[of])  # on a par with the k-th, only a smaller id counts
                if new.any():
                    found.append((of[new], a + row[new], values[new].astype(np.float64)))
                    hits += int(new.sum())
                if hits > HITS:
                    settle()
                    bars, last, hits = best.score[at, -1].astype(x.dtype), best.id[at, -1], 0
                continue
            near = bound - norm[g] * radius[page]  # the product with the page's centre
            children = np.arange(a, b)
            children = children[(near + norm[g] * (parent[a:b] + radius[a:b])[:, None] >= bar[g]).any(axis=1)]  # by the stored distances alone
            top[np.ix_(children, g)] = centre[children] @ q[g].T + norm[g] * radius[children, None] + slack[g]
        settle()


def whole_scores(x: np.ndarray, ids: list[list[int]], q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of all vectors x without `own`, by Python's integers."""
    ints = [int(c) for c in q]
    scores = [sum(a * int(b) for a, b in zip(ints, row, strict=True)) for row in x.tolist()]
    return sorted(((s, v) for s, vs in zip(scores, ids, strict=True) for v in vs if v != own), key=lambda t: (-t[0], t[1]))[:k]


def in_order(s: int) -> bytes:
    """Bytes that sort as the integers do, whatever their size."""
    size = (abs(s).bit_length() + 7) // 8
    raw = size.to_bytes(2, "big") + abs(s).to_bytes(size, "big")
    return b"\x01" + raw if s >= 0 else b"\x00" + bytes(255 - x for x in raw)


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array of whole doubles) of the rows whose vectors are whole; null vectors and those with null, infinite or NaN components are left out, as are those with
    a component whose multiple no double holds."""
    x = F.transform(quoted(vec_col), lambda c: c.cast("double") * scale)
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))
    return rows.where(F.coalesce(ok, F.lit(False)) & quoted(id_col).isNotNull()).select(quoted(id_col).cast("long").alias("id"), whole.alias("v"))


def _few_ids(vectors: DataFrame, k: int) -> DataFrame:
    """(v, ids): the k + 1 smallest ids of each vector, of distinct rows. Rows are cut to that many within salted parts first."""
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["v", "salt"], ["v"]):
        salted = salted.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    return salted.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def top_k(rows: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score). Queries are the rows where is_query, a condition on the column id, holds; every row but the query's own id is a candidate. Vectors of
    another length than the query's have no product with it; empty ones have none at all. Fewer than k candidates are all returned; no vectors give no rows. Repeated rows count once. Other
    columns take no part, whatever their names. A score beyond the range of long is given as the nearest long; ranks follow the whole value."""
    vectors = materialize(whole_vectors(rows, id_col, vec_col, scale).distinct(), "vectors")
    entries = materialize(_few_ids(vectors, k).withColumn("dim", F.size("v")).where("dim > 0"), "entries")
    n = entries.count()
    pivots: dict[int, np.ndarray] = {}
    for r in entries.orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect():
        pivots[r.dim] = np.vstack([*pivots.get(r.dim, np.empty((0, r.dim))), np.array(r.v)])

    @F.pandas_udf("int")
    def nearest(vs: pd.Series) -> pd.Series:
        out, dims = np.full(len(vs), -1, dtype=np.int32), vs.map(len).to_numpy()
        for dim in set(dims.tolist()) & pivots.keys():
            at, p = np.flatnonzero(dims == dim), pivots[dim]
            with np.errstate(over="ignore", invalid="ignore"):  # any pivot will do
                out[at] = ((p**2).sum(axis=1)[None, :] - 2 * np.stack(vs.iloc[at].to_list()) @ p.T).argmin(axis=1)
        return pd.Series(out)

    wide = F.array_max(F.transform("v", F.abs)) >= NARROW
    dealt = materialize(entries.withColumn("pivot", nearest("v")).withColumn("wide", wide), "dealt")
    count = dealt.groupBy("dim", "wide", "pivot").agg(F.count("*").alias("n"))
    size = min(PART, max(PART // 8, -(-n // LANES)))
    small = F.col("n") < size // 2  # pivots with few entries share trees of up to size and one pivot's entries
    so_far = F.sum(F.when(small, F.col("n"))).over(W.partitionBy("dim", "wide").orderBy("pivot"))
    count = count.withColumn("tree", F.when(small, -2 - F.floor((so_far - 1) / size)).otherwise(F.col("pivot")))
    sizes = dealt.join(F.broadcast(count), ["dim", "wide", "pivot"]).withColumn("part", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / size)))
    sizes = sizes.withColumn("part", F.when(F.col("tree") < -1, F.lit(0)).otherwise(F.col("part")))
    sizes = sizes.repartition(max(LANES, -(-n // (4 * size))), "dim", "wide", "tree", "part")  # few bytes are much work: Spark would join such parts up by their bytes

    def grow(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        """One tree, its vectors and ids as bytes."""
        p = p.iloc[np.lexsort((p["ids"].str[0],))]
        x = np.array(p["v"].tolist(), dtype=np.float64)
        with np.errstate(over="ignore", invalid="ignore"):  # trees of vectors that wide are read whole
            tree = build(x, np.random.default_rng(SEED))
        x, p = x[tree["order"]], p.iloc[tree["order"]]
        ids, sizes_ = np.concatenate(p["ids"].tolist()).astype(np.int64), np.array([len(i) for i in p["ids"]])
        blobs = {c: [np.ascontiguousarray(a, dtype=t).tobytes()] for c, a, t in (("x", x, "f4" if np.abs(x).max() < SINGLE else "f8"), ("ids", ids, "i8"), ("sizes", sizes_, "i8"), ("centre", tree["centre"], "f8"), ("radius", tree["radius"], "f8"), ("parent", tree["parent"], "f8"), ("span", tree["span"], "i8"), ("leaf", tree["leaf"], "u1"))}
        return pd.DataFrame({"dim": [int(key[0])], **blobs})

    schema = "dim int, x binary, ids binary, sizes binary, centre binary, radius binary, parent binary, span binary, leaf binary"
    trees = sizes.groupBy("dim", "wide", "tree", "part").applyInPandas(grow, schema)
    trees = materialize(trees.withColumn("uid", F.monotonically_increasing_id()), "trees")
    asked = vectors.where(is_query).withColumn("dim", F.size("v")).where("dim > 0")
    blocks = max(1, -(-(asked.agg(F.sum("dim")).first()[0] or 0) // BLOCK))
    salts = max(LANES, -(-trees.count() // TREES))
    q = asked.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
    q = materialize(q.select("dim", "block", F.transform("q", lambda x: x["id"]).alias("qid"), F.flatten(F.transform("q", lambda x: x["v"])).alias("qv")), "blocks")

    def rows_of(found: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"query_id": np.array([o[0] for o in found], dtype=np.int64), "score": np.array([max(-(1 << 63), min((1 << 63) - 1, o[1])) for o in found], dtype=np.int64), "whole": [in_order(o[1]) for o in found], "id": np.array([o[2] for o in found], dtype=np.int64)})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best of each query over all trees of a task; a query's results are given out in parts where a task has more than HELD queries."""
        held: dict[tuple[int, int], tuple[np.ndarray, Best]] = {}

        def give() -> Iterator[pd.DataFrame]:
            for qid, best in held.values():
                for a in range(0, len(qid), SIDE):
                    there = best.score[a : a + SIDE] > -np.inf
                    of = np.nonzero(there)[0]
                    yield rows_of([(i, int(s), v) for i, s, v in zip(qid[a + of].tolist(), best.score[a : a + SIDE][there].tolist(), best.id[a : a + SIDE][there].tolist(), strict=True)])
            held.clear()

        for b in batches:
            for t in b.itertuples(index=False):
                get = lambda c, kind: np.frombuffer(getattr(t, c), dtype=kind)  # noqa: E731, B023
                dim, sizes, ids = t.dim, get("sizes", "i8"), get("ids", "i8")
                x = get("x", "f4" if len(t.x) == 4 * dim * len(sizes) else "f8").reshape(-1, dim)
                tree = {"centre": get("centre", "f8").reshape(-1, dim), "radius": get("radius", "f8"), "parent": get("parent", "f8"), "span": get("span", "i8").reshape(-1, 2), "leaf": get("leaf", "u1")}
                qid, q = np.asarray(t.qid, dtype=np.int64), np.asarray(t.qv, dtype=np.float64).reshape(-1, dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    most = dim * np.abs(q).max(axis=1) * float(np.abs(x).max())
                    exact = (most < EXACT) & np.isfinite((q * q).sum(axis=1)) & all(np.isfinite(tree[c]).all() for c in ("centre", "radius", "parent"))
                if not exact.all():
                    lists = [i.tolist() for i in np.split(ids, np.cumsum(sizes)[:-1])]
                    for i in np.flatnonzero(~exact).tolist():
                        yield rows_of([(int(qid[i]), s, v) for s, v in whole_scores(x, lists, q[i], int(qid[i]), k)])
                if (dim, t.block) not in held:
                    if sum(len(i) for i, _ in held.values()) + len(qid) > HELD:
                        yield from give()
                    held[dim, t.block] = qid, Best(len(qid), k)
                best = held[dim, t.block][1]
                single = exact & (most < SINGLE) & (x.itemsize == 4)
                for kind, some in (("f4", single), ("f8", exact & ~single)):
                    for at in np.array_split(np.flatnonzero(some), -(-int(some.sum()) // SIDE) or 1):
                        if len(at):
                            search(tree, x.astype(kind, copy=False), ids, sizes, q[at], qid[at], best, at)
        yield from give()

    # Blocks of queries against trees: a stated query set against all rows, in blocks.
    every = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(salts, "dim", "salt")
    trees_ = trees.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int")).drop("uid").repartition(salts, "dim", "salt")
    found = trees_.join(every, ["dim", "salt"]).drop("salt").mapInPandas(find, "query_id long, score long, whole binary, id long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("whole"), "id"))
    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "8"):  # a row is a tree and a block, up to some 15 MB
        out = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"), "found")
    discard(vectors, entries, dealt, trees, q)
    return out


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
    return out.withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
