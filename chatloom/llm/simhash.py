"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority of that bit of the text's shingle hashes. Every bit gets a vector m(i) of radius + 1 bits; for each
non-zero v of radius + 1 bits there is one table, whose key holds the bits i with <m(i), v> = 1. If two fingerprints differ in at
most `radius` bits, their vectors span less than the whole space, some v is orthogonal to them all, and in that table the two
keys are equal: no pair within the radius is missed.

Equal fingerprints are joined before the search, so copies never meet as pairs. Buckets of at most SMALL
fingerprints are compared pair by pair. Members of larger ones are linked in linear work: x and y differ in at most 2 t bits if and
only if they share a point that differs from either in at most t bits; each crowded fingerprint emits those points, and equal points link.

With a `similarity` the links are all pairs of texts whose sets of distinct shingles have at least that Jaccard similarity, and no pair is lost. No
radius of 64 bits could promise that: sets of similarity 0.8 differ in about 10 bits, often in 15, which would take 2^16 tables. So the covering tables
come first: in each bucket all are compared with the leader (the smallest hash of a name, alike in all buckets), and each text is checked exactly against
the leader it met most often. What this connects needs no further search, and it connects crowds of copies in linear work. What is left is
searched exactly. All sets are put into one order of shingles. A set of n can only be that similar to one that shares a shingle with it among the
first n - ceil(similarity * n) + 1 of both, its prefix (prefix filter), and the places of the first shared one bound how many are shared. Any order does; shingles
that a sample of texts finds often come last, so that few texts meet by them. Only components are asked for, so pairs already connected
are not compared. Where over SMALL texts meet by a shingle, some of them (pivots, those with most links first, eight times as many each round) are compared with all
others there that are not connected to them, and only they leave (only texts that could be as similar to one of their own size by it need be pivots): a text that was merely reached by a link stays to be a pivot, as others may be reached
through it alone. A shingle is done with when all its texts are connected, or pair by pair when SMALL are left.

Most pairs that meet are not similar, and whole sets beside each pair would be many times the input. So each set has a parity map, about a bit or two for each shingle: whether
an odd number of its hashes end in those bits. Sets differ in no fewer shingles than their maps in bits, so a pair whose maps differ in too many cannot be similar; only what
passes is compared shingle by shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, if_small, materialize, numbered, quoted, small_batches, split_words, table

SMALL, PIVOTS, SEED = 24, 8, 42
#: Radius of the covering tables that are tried first when a similarity is asked for.
FIRST_RADIUS = 2
#: For the order of shingles: about so many texts are sampled, and so many shingles at most that OFTEN of them or more have come last.
SAMPLED, OFTEN, COMMON = 8192, 3, 1 << 18
#: Texts whose shingles a Python worker holds at once.
SLICE = 256


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; of the whole sequence if it is shorter; none for no words."""
    w = split_words(text)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], dtype=np.uint64)
    buf, ends = b" ".join(w), np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(w) - words] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(buf[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    ones = np.zeros(64, dtype=np.int64)
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(octets), 255):  # as many as a byte can count
        ones += np.add.reduce(np.unpackbits(octets[a : a + 255], axis=1), axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def covering_masks(radius: int, seed: int = SEED) -> list[int]:
    """2^(radius+1) - 1 masks over 64 bits, such that any two words within the radius agree under one of them."""
    dims = radius + 1
    vectors = np.zeros(64, dtype=np.int64)
    vectors[np.random.default_rng(seed).permutation(64)] = [1 + i % ((1 << dims) - 1) for i in range(64)]  # every vector about equally often, none zero
    return [sum(1 << i for i in range(64) if int(vectors[i] & v).bit_count() % 2) for v in range(1, 1 << dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, radius: int) -> Column:
    """An array of the keys of all tables; a table's number is in its keys."""
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(covering_masks(radius))])


def _ball(fp: Column, t: int) -> Column:
    flips = [0] + [sum(1 << i for i in c) for n in range(1, t + 1) for c in combinations(range(64), n)]
    return F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), lambda x: x.bitwiseXOR(fp))


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect what lies within the radius, which is 2 or 4. nodes: one column node, distinct fingerprints."""
    if radius not in (2, 4):
        raise ValueError("the radius is 2 or 4")
    rows = nodes.select("node", F.explode(_keys(F.col("node"), radius)).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = materialize(rows.join(counts, "key"), "buckets")
    groups = member.where(f"n <= {SMALL}").groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("g"))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    pair = F.flatten(F.transform("g", lambda x, i: F.transform(F.filter(F.slice("g", i + 2, F.size("g")), lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    found = groups.select(F.explode(pair).alias("p")).select("p.a", "p.b").distinct()
    points = member.where(f"n > {SMALL}").select("node").distinct().select("node", F.explode(_ball(F.col("node"), radius // 2)).alias("point"))
    low = points.groupBy("point").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    found = materialize(found.unionByName(points.join(low, "point").where("node <> b").select(F.col("node").alias("a"), "b").distinct()), "found")
    discard(member)
    return found


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for a in range(0, len(b), SLICE):
            yield b.iloc[a : a + SLICE]


def set_name(h: np.ndarray) -> list[int]:
    """128 bits that name a set of shingles, as two signed longs; zeros for the empty set."""
    raw = h.tobytes()
    return [_signed(xxhash.xxh64_intdigest(raw, SEED + k)) for k in (0, 1)] if len(h) else [0, 0]


def parity_map(h: np.ndarray) -> bytes:
    """A bit for each ending of the hashes of a set (as many endings as a power of two that is no less than the set): whether an odd number of them have it."""
    bits = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def map_distance(a: bytes, b: bytes) -> int:
    """In how many bits two parity maps differ, the longer one folded to the length of the other: no more than the shingles in which the sets differ."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a sample of texts have, ascending, and their counts. They only order shingles: no result depends on them."""
    step = max(1, rows.count() // SAMPLED)
    some = rows.select("text").where(F.abs(F.xxhash64("text") % step) == 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"h": np.unique(shingle_hashes(t, words)).view(np.int64)})

    often = some.mapInPandas(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    with small_batches(rows.sparkSession):
        got = often.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def in_order(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct shingles in the one order: those not common, then the common ones by count; by hash in either."""
    if not len(common):
        return h
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]


def _fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """(doc, rid, node): rows' fingerprints; a text without words has all bits zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "rid": b["rid"], "node": [fingerprint(shingle_hashes(t, words)) for t in b["text"]]})

    return rows.select("doc", "rid", "text").mapInPandas(run, "doc long, rid long, node long")


def _prefixes(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc, rid, name, fp, size, parity, prefix): the name, fingerprint, size and parity map of the text's set of shingles, and the first of them that a similar set must meet."""
    common = _common(rows, words)
    keep = lambda n: n - math.ceil(similarity * n - 1e-9) + 1 if n else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in b["text"]]
            first = [in_order(h, *common)[: keep(len(h))].view(np.int64) for h in sets]
            yield pd.DataFrame({"doc": b["doc"], "rid": b["rid"], "name": [set_name(h) for h in sets], "fp": list(map(fingerprint, sets)), "size": [len(h) for h in sets], "parity": list(map(parity_map, sets)), "prefix": first})

    return rows.select("doc", "rid", "text").mapInPandas(run, "doc long, rid long, name array<long>, fp long, size int, parity binary, prefix array<long>")


def _passing(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are not ruled out by the sizes and parity maps of their nodes (node, size, parity)."""

    @F.pandas_udf("boolean")
    def may(ma: pd.Series, mb: pd.Series, total: pd.Series) -> pd.Series:
        most = total * ((1 - similarity) / (1 + similarity)) + 1e-6
        return pd.Series([map_distance(x, y) <= m for x, y, m in zip(ma, mb, most, strict=True)], dtype=bool)

    maps = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("parity").alias(f"m{c}"))
    x = pairs.join(maps("b"), "b").where("nb > 0").join(maps("a"), "a")
    x = x.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    return x.where(may("ma", "mb", F.col("na") + F.col("nb"))).select("a", "b")


def _similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) whose texts' shingle sets have at least the given Jaccard similarity. Of the texts, one row for each node in a pair is read again."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    with small_batches(rows.sparkSession):
        pairs = materialize(_passing(pairs, nodes, similarity), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            yield pd.DataFrame({"node": b["node"], "hs": [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b["text"]]})

    asked = materialize(nodes.select("node", "rid").join(asked, "node", "left_semi"), "asked")
    texts = rows.select("rid", "text").join(if_small(asked), "rid").select("node", "text")
    with small_batches(rows.sparkSession):
        sets = materialize(texts.mapInPandas(run, "node long, hs array<long>"), "sets")
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("hs").alias("hb")), "b")
    x = x.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("ha")), "a")
    both, total = F.size(F.array_intersect("ha", "hb")), F.size("ha") + F.size("hb")
    out = materialize(x.where(both >= similarity * (total - both) - 1e-9).select("a", "b"), "found")
    discard(pairs, asked, sets)
    return out


def _may_be(x: Column, y: Column, similarity: float) -> Column:
    """Whether sets that share the shingle at these places (pos from 0, size) can be similar, if it is the first in the order that they share. A pair
    that is similar passes at its first, and need not at others."""
    shared = F.least(x["size"] - x["pos"], y["size"] - y["pos"])
    return (x["root"] != y["root"]) & (shared * (1 + similarity) >= similarity * (x["size"] + y["size"]) - 1e-9)


def led_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): each node with the leader that it meets most often in the covering tables. nodes: (node, fp). A row a node at most."""
    rows = nodes.select("node", F.explode(_keys(F.col("fp"), radius)).alias("key"))
    lead = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("b"))).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", "m.o", "m.b")
    met = rows.join(lead, "key").where("node <> b").groupBy("node", "o", "b").agg(F.count("*").alias("n"))
    return met.groupBy("node").agg(F.min(F.struct(-F.col("n"), "o", "b")).alias("m")).select(F.col("node").alias("a"), F.col("m.b").alias("b"))


def similar_links(nodes: DataFrame, prefixes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of at least the given similarity, as many as connect what all such links would. nodes: (node, rid, fp, size, parity), rid that of a row
    with the text; prefixes: (rid, size, prefix); rows: (rid, text)."""
    found = _similar(led_pairs(nodes, FIRST_RADIUS), nodes, rows, words, similarity)
    root = materialize(components(found), "roots")
    by_key = prefixes.select("rid", "size", "prefix").join(if_small(nodes.select("node", "rid")), "rid").select("node", "size", F.posexplode("prefix").alias("pos", "key"))
    counts = materialize(by_key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    member = materialize(by_key.join(if_small(counts), "key"), "buckets")
    trash = [counts, member]

    def rooted(x: DataFrame) -> DataFrame:
        return x.select("key", "node", "pos", "size").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def linked(pairs: DataFrame) -> DataFrame:
        new = _similar(pairs, nodes, rows, words, similarity)
        out = materialize(found.unionByName(new), "found")
        trash.extend([found, new])
        return out

    # Of a pair that passes _may_be, the smaller set would pass with one of its own place and size too: one of the two at least is strong.
    strong = (F.col("size") - F.col("pos")) * (1 + similarity) >= 2 * similarity * F.col("size") - 1e-9
    few, rest, many = [member.where(f"n <= {SMALL}")], member.where(f"n > {SMALL}"), PIVOTS
    while True:
        open_ = rooted(rest)
        n = open_.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.bool_or(strong).alias("s")).where("r0 <> r1 and s").select("key", "n")
        open_ = materialize(open_.join(n, "key"), "open")
        trash.append(open_)
        few.append(open_.where(f"n <= {SMALL}"))
        crowd = open_.where(f"n > {SMALL}")
        if crowd.isEmpty():
            break
        ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node")))
        degree = ends.groupBy("node").agg(F.count("*").alias("links"))
        ranked = crowd.where(strong).join(degree, "node", "left").withColumn("part", F.abs(F.xxhash64("node", F.lit(many)) % many))
        best = F.struct(-F.coalesce("links", F.lit(0)), F.xxhash64("node"), F.struct("node", "pos", "size", "root").alias("x"))  # alike in all buckets
        pivots = materialize(ranked.groupBy("key", "part").agg(F.min(best).alias("m")).select("key", F.col("m.x").alias("x")), "pivots")
        tried = crowd.select("key", F.struct("node", "pos", "size", "root").alias("y")).join(pivots, "key").where(_may_be(F.col("x"), F.col("y"), similarity))
        more = linked(tried.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        rest = crowd.join(pivots.select("key", F.col("x.node").alias("node")), ["key", "node"], "left_anti")
        trash += [pivots, root]
        found, many = more, PIVOTS * many
        root = materialize(components(found), "roots")
    groups = rooted(reduce(DataFrame.unionByName, [x.select("key", "node", "pos", "size") for x in few]))
    groups = groups.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "pos", "size", "root"))).alias("g"))
    pair = F.flatten(F.transform("g", lambda x, i: F.transform(F.filter(F.slice("g", i + 2, F.size("g")), lambda y: _may_be(x, y, similarity)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    out = linked(groups.select(F.explode(pair).alias("p")).select("p.a", "p.b"))
    discard(*trash, root)
    return out


def _grouped(rows: DataFrame, words: int, radius: int, similarity: float | None) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, rid, node, root) of rows (doc, rid, text), and the tables under it. root names the component; rows with equal ids share what they reach."""
    with small_batches(rows.sparkSession):
        raw = _fingerprints(rows, words) if similarity is None else _prefixes(rows, words, similarity).withColumn("node", F.xxhash64("name"))
        fps = materialize(raw, "fingerprints")
    if similarity is None:
        nodes = materialize(fps.select("node").distinct(), "nodes")
    else:
        nodes = materialize(fps.groupBy("node").agg(F.min("rid").alias("rid"), *[F.any_value(c).alias(c) for c in ("fp", "size", "parity")]), "nodes")
    same_id = fps.where("doc is not null").select("doc", "node").distinct()
    again = same_id.groupBy("doc").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("doc", "a")
    edges = links(nodes, radius) if similarity is None else similar_links(nodes, fps, rows, words, similarity)
    both = edges.unionByName(same_id.join(again, "doc").select("a", F.col("node").alias("b")).where("a <> b"))
    roots = materialize(components(both), "roots")
    out = fps.select("doc", "rid", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return out, [fps, nodes, edges, roots]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """(doc, fp, component): component is the smallest id that links reach from the document, its own included; fp is the fingerprint or, with a
    similarity, a hash that names the set of shingles.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal ids share what they reach. A
    null id stays null and is never the smallest; a component of null ids alone has a null component. Ids are read as long. Other columns take no part, whatever their names. No rows give none.
    With a similarity, links are all pairs of that exact similarity of the texts' sets of shingles; the radius then changes nothing.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    if similarity is not None:
        rows = materialize(rows, "rows")
    grouped, trash = _grouped(rows, words, radius, similarity)
    # The smallest id by root, for roots of several nodes; most texts are alone with theirs.
    low = grouped.groupBy("root").agg(F.min("doc").alias("component"))
    out = materialize(grouped.join(low, "root").select("doc", F.col("node").alias("fp"), "component"), "classes")
    discard(*trash, *([rows] if similarity is not None else []))
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """The row with the smallest id of every component, whole, with docs' own columns. Of rows with that same id one stays, any of them; a row without an id stays
    only if no row of its component has one, one row for each such component."""
    rows = numbered(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    grouped, trash = _grouped(rows, words, radius, similarity)
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "rid")).alias("m")
    keep = grouped.groupBy("root").agg(first).select(F.col("m.rid").alias("rid"))
    gone = materialize(grouped.select("rid").join(keep, "rid", "left_anti"), "gone")  # fewer than those that stay
    discard(*trash)
    return rows.join(if_small(gone), "rid", "left_anti").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
