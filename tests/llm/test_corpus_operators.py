"""Small cases with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain Python."""

import math
import random
import time
import zlib
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import common, line_dedup, line_rules, merkle, mixing, mtree, packing, pitman_yor, quality, simhash, url_filter

NEAR = {"words": 5, "similarity": 0.8}
LONG = " ".join(f"long{i % 977}" for i in range(6000))
DOCS = [(1, "a b c d"), (2, None), (3, ""), (4, "A B\tC d"), (None, "x y z"), (5, "x y z"), (5, "x y z"), (6, LONG), (7, "é ü\n\nß"), (8, " \n ")]
#: Columns named like those inside the operators and like their results.
EXTRA = ("rid", "key", "node", "n", "h", "tokens", "row", "doc", "copies", "cut", "graded", "judged", "kept", "n_words", "clean", "n_removed", "size", "root", "name", "fp", "id", "v", "score", "token")
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in EXTRA)


def frame(spark, rows, sources=("b", None, "a")):
    return spark.createDataFrame([(d, t, sources[i % len(sources)], *(1000 * k + i for k in range(len(EXTRA)))) for i, (d, t) in enumerate(rows)], SCHEMA)


def same_extras(out, docs):
    """Every row that came out has the other columns of a row that went in, by name and value."""
    came_in = {tuple(r) for r in docs.select("source", *EXTRA).collect()}
    return out.columns[: len(docs.columns)] == docs.columns and {tuple(r) for r in out.select("source", *EXTRA).collect()} <= came_in


def test_line_dedup(spark):
    line = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    passage = "\n".join([line(1, 30), line(2, 30), "", line(3, 30)])
    rows = [(2, "own two\n" + passage + "\nend"), (1, "own one\n" + passage), (3, line(1, 30)), (4, line(4, 60)), (4, line(4, 60)), (None, line(5, 60)), (5, line(5, 60)), (6, None), (7, "")]
    out = line_dedup.dedup_lines(frame(spark, rows))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_removed_))
    assert same_extras(out, frame(spark, rows)) and out.columns[-2:] == ["n_lines", "n_removed_"]
    assert got[1] == [("own one\n" + passage, 0)] and got[2] == [("own two\nend", 4)] and got[3] == [(line(1, 30), 0)]
    assert sorted(got[4]) == [("", 1), (line(4, 60), 0)] and got[5] == [("", 1)] and got[6] == [(None, 0)] and got[7] == [("", 0)]
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_simhash_covers_and_links(spark):
    for radius in (2, 4):
        masks, rng = simhash.covering_masks(radius), random.Random(1)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not x & m for m in masks)
    got = {(r.doc, r.component) for r in simhash.near_duplicates(frame(spark, DOCS)).collect()}
    assert got == {(1, 1), (4, 1), (2, 2), (3, 2), (8, 2), (None, 5), (5, 5), (6, 6), (7, 7)}
    assert simhash.near_duplicates(frame(spark, DOCS).limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(frame(spark, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7] and same_extras(kept, frame(spark, DOCS))
    assert simhash.drop_near_duplicates(frame(spark, [(None, "a b c"), (None, "A b c"), (None, "x")])).count() == 2


def test_fingerprint_brute():
    """Bit by bit, over more hashes than a byte counts."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 254, 255, 256, 1000):
        h = rng.integers(0, 1 << 64, size=n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)
        assert simhash.fingerprint(h) == simhash._signed(want)


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few):
    """A long chain, a hub, repeated edges and loops, by star rounds and in one task."""
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, 1000 + i) for i in range(50)]
    pairs = chain + hub + [(7, 7), (3, 2), (2, 3)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    rng.shuffle(pairs)
    root = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    got = common.components(spark.createDataFrame(pairs, "a long, b long"), few).collect()
    assert {r.node: r.root for r in got} == {k: v for k, v in root.items() if any(k in p for p in pairs if p[0] != p[1])} and len(got) == len({r.node for r in got})


@pytest.mark.parametrize("radius", [2, 4])
def test_simhash_crowds(spark, radius):
    """A crowd of near fingerprints, more than a bucket compares pair by pair."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    words = {simhash._signed(base ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(radius)))) for _ in range(300)}
    words |= {simhash._signed(rng.getrandbits(64)) for _ in range(60)}
    nodes = sorted(words)
    df = spark.createDataFrame([(w,) for w in nodes], "node long")
    at = {w: i for i, w in enumerate(nodes)}

    def roots(pairs):
        root = list(range(len(nodes)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(x) for x in range(len(nodes))]

    dist = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    got = [(r.a, r.b) for r in simhash.links(df, radius).collect()]
    assert all(dist(a, b) <= radius for a, b in got)
    assert roots((at[a], at[b]) for a, b in got) == roots((i, j) for i in range(len(nodes)) for j in range(i) if dist(nodes[i], nodes[j]) <= radius)
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_simhash_similar_sets(spark):
    """Links by exact similarity: a crowd of edited copies, a pair that shares less than 0.8, repeats that outweigh the rest, nulls."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    texts = [None, "", " \n", "one two", "One  two", "spam " * 200 + "x1 x2 x3 x4 x5 x6 x7", "spam " * 200 + "y1 y2 y3 y4 y5 y6 y7"]
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(300), k % 4):
            w[at] = f"e{k}x{at}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:150] + [f"half{i}" for i in range(150)]), " ".join(f"alone{i}" for i in range(40)), LONG, LONG + " end"]
    rows = list(enumerate(texts)) + [(None, "one two"), (None, "n m")]
    how = NEAR
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    low = {r: min(k for k, q in enumerate(root) if q == r) for r in root}
    got = simhash.near_duplicates(frame(spark, rows), **how).collect()
    assert {r.doc: r.component for r in got if r.doc is not None} == {k: low[r] for k, r in enumerate(root)}
    assert sorted((r.component for r in got if r.doc is None), key=str) == [3, None]
    kept = simhash.drop_near_duplicates(frame(spark, rows), **how)
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: -1 if x is None else x) == [None, *sorted(set(low.values()))]
    assert same_extras(kept, frame(spark, rows)) and simhash.near_duplicates(frame(spark, rows).limit(0), **how).count() == 0 and simhash.drop_near_duplicates(frame(spark, rows).limit(0), **how).count() == 0


def brute_components(texts, words, similarity):
    sets = [frozenset(simhash.shingle_hashes(t, words).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(x & sets[j]) >= similarity * len(x | sets[j]) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_similar_star(spark):
    """Copies of one text, each of which only the original is similar to: what a pivot reaches is a way to others."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for k in range(500):
        w = list(base)
        for at in rng.sample(range(5, 195, 10), 4):
            w[at] = f"e{k}x{at}"
        texts.append(" ".join(w))
    texts.insert(321, " ".join(base))
    want = brute_components(texts, 5, 0.8)
    assert len(set(want)) == 1 and len(set(brute_components(texts[:321] + texts[322:], 5, 0.8))) > 100
    got = simhash.near_duplicates(frame(spark, list(enumerate(texts))), **NEAR).collect()
    assert [r.component for r in sorted(got, key=lambda r: r.doc)] == want


def test_similar_maps_rule_out(spark, monkeypatch):
    """Texts that meet by a common passage and are unlike otherwise are not compared shingle by shingle; a parity map never tells more than the difference of the sets."""
    rng = np.random.default_rng(3)
    for n in (1, 40, 64, 65, 500, 3000):
        for m in (n, int(n * 0.9), 2 * n):
            both = np.unique(rng.integers(0, 1 << 64, size=n + m, dtype=np.uint64))
            a, b = np.sort(rng.permutation(both)[:n]), np.sort(rng.permutation(both)[: max(1, m)])
            assert simhash.map_distance(simhash.parity_map(a), simhash.parity_map(b)) <= len(np.setxor1d(a, b))
    assert simhash.map_distance(simhash.parity_map(a[:0]), simhash.parity_map(a[:0])) == 0
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, size=n)]
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(passage + word(60)) for _ in range(30)]
    texts += [t + " more" for t in texts[:3]]
    written, keep = Counter(), simhash.materialize

    def counted(df, tag):
        out = keep(df, tag)
        written[tag] += out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    got = simhash.near_duplicates(frame(spark, list(enumerate(texts))), **NEAR).collect()
    assert {r.doc: r.component for r in got} == {i: i % 30 for i in range(33)}
    assert written["pairs"] <= 6 and written["sets"] <= 12  # they were hundreds


def test_similar_pairs_of_all_lengths(spark):
    """Pairs at the similarity itself or just below it, from two words to hundreds."""
    rng = random.Random(3)
    texts, want = [], []
    for k in range(240):
        n = (1, 3, 4, 7, 12, 60, 400)[k % 7]  # shingles
        words = [f"p{k}w{rng.randrange(10**6)}" for _ in range(n + 4)]
        more = [f"p{k}m{i}" for i in range(n // 4 + (k % 3 == 0))]
        texts += [" ".join(words), " ".join(words + more)]
        want += [2 * k, 2 * k if not more or 5 * n >= 4 * (n + len(more)) else 2 * k + 1]
    assert want == brute_components(texts, 5, 0.8)
    got = simhash.near_duplicates(frame(spark, list(enumerate(texts))), **NEAR).collect()
    assert [r.component for r in sorted(got, key=lambda r: r.doc)] == want


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randrange(1, 60))) for i in range(300)] + [(400, None), (401, "")]
    out = mixing.mix(frame(spark, rows)).collect()
    size = {i: len((t or "").split()) for i, t in rows}
    total = sum(size.values())
    targets = {r.source_size: r.target for r in out}
    assert all(r["size"] == size[r.doc] and r.copies * r["size"] <= 2 * r["size"] for r in out) and abs(sum(targets.values()) - 1.5 * total) < 1e-6
    for s, t in targets.items():
        assert abs(sum(r.copies * r["size"] for r in out if r.source_size == s) - t) <= 1 and t <= 2 * s + 1e-9
    assert sorted(out) == sorted(mixing.mix(frame(spark, rows)).collect()) and mixing.mix(frame(spark, rows).limit(0)).count() == 0
    taken = mixing.take_mix(frame(spark, rows).repartition(5, "text"))  # rows behind a shuffle
    assert same_extras(taken, frame(spark, rows)) and Counter(r.doc_id for r in taken.collect()) == Counter({r.doc: r.copies for r in out if r.copies})
    assert mixing.take_mix(frame(spark, rows).limit(0)).count() == 0
    hot = [(i, "a b c") for i in range(3000)] + [(5000, "a b"), (5001, "z")]
    out = mixing.mix(frame(spark, hot, ("one",)), share=0.5).collect()  # one length has all but two documents
    assert abs(sum(r.copies * r["size"] for r in out) - 0.5 * 9003) <= 1


def test_mix_leaves_texts_where_they_are(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randrange(1, 60))) for i in range(300)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        taken = mixing.take_mix(frame(spark, rows))
        plan = taken._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert taken.count() == sum(r.copies for r in mixing.mix(frame(spark, rows)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fit_lengths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, size=rng.integers(1, 9)))
        counts = rng.integers(1, 6, size=len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 3))
        take = mixing.fit_lengths(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {x + k * n for x in reach for k in range(c + 1)}
        got = int((take * lengths).sum())
        assert got <= budget and (budget > 2 * lengths[-1] or got == max(x for x in reach if x <= budget))
        assert got >= max(x for x in reach if x <= budget) - 2 * int(lengths[-1])  # the bulk is spread, what is left is fitted
    for _ in range(30):  # many documents of many lengths: every budget can be met, and is
        lengths, counts = np.arange(1, 41), rng.integers(3, 9, size=40)
        budget = int(rng.integers(0, int((lengths * counts).sum())))
        assert int((mixing.fit_lengths(lengths, counts, budget) * lengths).sum()) == budget


def test_packing_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["a  b\n c", "  x", "don't  we'll", "tab\t a \t b", "end ", "", None, "<|endoftext|> a", "a<|endoftext|><|endoftext|>  b <|endoftext|>", "<|endoftext |> <|end", "x \x1c y", "é́ \x85 z 12 3.4", LONG, "a b", "a\nb c\nd e"]
    for x in odd:
        assert np.frombuffer(packing.token_bytes(x, path), dtype="<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids
    pieces = packing.pack(frame(spark, list(enumerate(odd))), path).collect()
    for i, x in enumerate(odd):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        assert [m[0] for m in mine] == [sum(m[1] for m in mine[:k]) for k in range(len(mine))] and sum(m[1] for m in mine) == len(ids)
        assert all(c == crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) for s, n, c in mine)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        n = sum(x for _, x in s)
        assert n <= 2048 and n & (n - 1) == 0  # full, or a power of two: no padding
    assert packing.pack(frame(spark, DOCS).limit(0), path).count() == 0
    plan, n = packing.plan_block([700] * 50 + [5] * 20)
    cost = Counter()
    for _, _, size, s, _ in plan:
        cost[s] += size
    assert sum(cost.values()) == 700 * 50 + 100 and n == len(cost)


def labelled(spark, n=400):
    rng, vocab = random.Random(4), [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        kind = i % 4
        words = rng.choices(vocab, k=80)
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words[::12] = ["vile" + rng.choice("abc")] * len(words[::12])
        rows.append((i, ". ".join(" ".join(words[a : a + 10]).capitalize() + "." if kind else " ".join(words[a : a + 10]) for a in range(0, 80, 10)).replace(". ", ".\n")))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return rows, spark.createDataFrame([*labels, (None, 1, 0), (9999, None, None)], "doc_id long, quality int, toxic int")


def test_quality_null_labels(spark):
    """A label with a null is no label, whatever the other column says."""
    docs = frame(spark, [(i, f"word{i} and more") for i in range(6)])
    nulls = spark.createDataFrame([(0, None, None), (1, 1, None), (2, None, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, nulls)
    assert not model.weights.any() and model.thresholds == (-10.0, -9.0)


def test_quality_held_out(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, rows + DOCS[1:3])
    model = quality.train(docs, labels.where("doc_id < 250 or doc_id is null"))
    out = quality.grade(docs, model)
    kept = {r.doc_id: r.kept_ for r in out.collect() if r.n_words_}
    held = range(250, 400)
    assert same_extras(out, docs) and same_extras(quality.keep(docs, model), docs) and quality.keep(docs, model).columns == docs.columns
    assert np.mean([kept[i] == (i % 4 > 1) for i in held]) > 0.95 and all(0 <= r.clean_ <= r.expected_grade <= 2 for r in out.collect())
    assert [r.kept_ for r in out.where("n_words_ = 0").collect()] == [False, False]
    twice = docs.unionByName(docs.where("doc_id < 30")).unionByName(frame(spark, [(7, LONG)]))
    assert abs(quality.train(twice, labels).thresholds[0] - quality.train(docs, labels).thresholds[0]) < 0.2 and quality.grade(twice, model).count() == twice.count()
    assert quality.train(docs, labels.limit(0)).weights.sum() == 0 and quality.grade(docs.limit(0), model).count() == 0


def brute_repeats(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_line_rules(spark):
    rng = random.Random(6)
    for n in (0, 7, 8, 9, 40, 200):
        words = [rng.choice("ab") for _ in range(n)]
        with np.errstate(over="ignore"):
            assert line_rules.repeated_words(words) == brute_repeats(words)
    rows, labels = labelled(spark)
    docs = frame(spark, rows + DOCS)
    field = line_rules.train(docs, labels)
    out = {r.doc_id: r for r in line_rules.apply_rules(docs, field).collect()}
    assert np.mean([out[i].kept_ == (i % 4 > 0) for i in range(100, 400)]) > 0.95 and same_extras(line_rules.apply_rules(docs, field), docs)
    halves = {r[0]: r[1].split("\n") for r in rows}
    mixed = [(1000 + i, "\n".join(halves[2 + 4 * i][:6] + halves[4 * i][:6] + halves[2 + 4 * i][6:])) for i in range(20)]
    shares = [r.content_share for r in line_rules.apply_rules(frame(spark, mixed), field).collect()]
    assert all(0 < x < 1 for x in shares) and 0.4 < np.mean(shares) < 0.8
    assert line_rules.apply_rules(docs.limit(0), field).count() == 0
    empty = line_rules.apply_rules(docs.where("text is null"), line_rules.train(docs, labels.limit(0))).first()
    assert (empty.n_words_, empty.base_failed, empty.kept_) == (0, True, False)
    feats = [[i % 3, 20] for i in range(5)]
    best = max(range(32), key=lambda m: (lambda y: field.start[y[0]] + sum(field.emit[feats[i]].sum() * y[i] for i in range(5)) + sum(field.move[y[i], y[i + 1]] for i in range(4)))([m >> i & 1 for i in range(5)]))
    assert field.decode(feats) == [best >> i & 1 for i in range(5)]


def test_line_rules_learn_from_late_lines(spark):
    """What tells the labels apart stands behind the first pieces of long texts alone."""
    plain, odd = (lambda k: f"plain line {k} of words that ends well."), (lambda k: f"### $$$ *** ### {k} $$$ ***")  # lines that repeat are boilerplate anyway
    head = [f"{i} head line" for i in range(3 * line_rules.LONGEST)]
    rows = [(i, "\n".join(head + [(plain if i % 2 else odd)(k) for k in range(20)])) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    field = line_rules.train(frame(spark, rows), labels)
    assert field.decode(line_rules.lines_of("\n".join(map(plain, range(6))))[0]) == [1] * 6 and field.decode(line_rules.lines_of("\n".join(map(odd, range(6))))[0]) == [0] * 6


def test_mtree_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(40)]
    odd = [(2000, None), (2001, [None] * 8), (2002, [math.nan] * 8), (2003, [math.inf] * 8), (2004, [1.0, 2.0]), (2006, [1.0, 1.0]), (0, vectors[0][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("tree", F.lit(2))
    got = sorted(mtree.top_k(df, F.col("id") % 20 == 4).collect())
    ints = {i: np.floor(256 * np.array(v)) for i, v in vectors + odd[4:6]}
    want = []
    for q in (i for i in ints if i % 20 == 4):
        top = sorted(((-int(ints[q] @ x), i) for i, x in ints.items() if i != q and len(x) == len(ints[q])))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(top)]
    assert [tuple(r) for r in got] == sorted(want)
    assert mtree.top_k(df.limit(0), F.col("id") % 2 == 0).count() == 0
    big = [(1, [2e15, 1.0]), (2, [1.0, 3e15]), (3, [2e15, 2.0]), (4, [-1e300, 1.0]), (5, [0.5, 0.25]), (6, [1e9 + 0.5, 1e9]), (7, [1e9, 1e9 + 0.5])]
    got = mtree.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("id") >= 0).collect()
    ints = {i: [int(256 * c) if abs(c) < 1e15 else 256 * int(c) for c in v] for i, v in big}
    for q in ints:
        top = sorted((-sum(a * b for a, b in zip(ints[q], x, strict=True)), i) for i, x in ints.items() if i != q)[:5]
        assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in top]


def test_mtree_pages_open_for_many_queries():
    """Products follow pages and rounds, not pages times queries, and the results are those of brute force: ties, copies, each query's own id, results carried from tree to tree."""

    class Counted(np.ndarray):
        calls = 0

        def __array_ufunc__(self, ufunc, method, *args, **kw):
            Counted.calls += ufunc is np.matmul
            return getattr(ufunc, method)(*[a.view(np.ndarray) if isinstance(a, Counted) else a for a in args], **kw)

    rng = np.random.default_rng(5)
    x = np.unique(np.floor(rng.normal(size=(3000, 16)) * 2), axis=0)
    sizes = rng.integers(1, 7, size=len(x))
    ids = [sorted(part.tolist()) for part in np.split(rng.permutation(sizes.sum()), np.cumsum(sizes)[:-1])]
    asked = rng.choice(len(x), 400, replace=False)
    q, own = np.vstack([x[asked], np.zeros(16)]), np.array([ids[i][-1] for i in asked] + [-1])
    best, pages = mtree.Best(len(q), 5), 0
    for part in np.array_split(np.arange(len(x)), 2):
        tree = mtree.build(x[part], np.random.default_rng(1))
        at = part[tree["order"]]
        mtree.search(tree, x[at].astype("f4").view(Counted), np.concatenate([ids[i] for i in at]), sizes[at], q, own, best, np.arange(len(q)))
        pages += int(tree["leaf"].sum())
    assert pages <= Counted.calls <= 6 * pages  # one by one: up to 401 x pages
    for i in range(len(q)):
        top = sorted((-int(s), v) for s, vs in zip(x @ q[i], ids, strict=True) for v in vs if v != own[i])[:5]
        assert list(zip(best.score[i].tolist(), best.id[i].tolist(), strict=True)) == [(-s, v) for s, v in top]


def test_mtree_many_trees(spark, monkeypatch):
    """Many trees and blocks, results given out in parts; a query of zeros meets vectors so wide that their tree has no finite bounds."""
    for name, value in (("PART", 128), ("BLOCK", 64), ("HELD", 20)):
        monkeypatch.setattr(mtree, name, value, raising=False)
    rng = np.random.default_rng(7)
    small = [(i, [float(c) / 256 for c in rng.integers(-3, 4, size=4)]) for i in range(600)] + [(1000, [0.0] * 4)]
    wide = [(5000 + i, [1e300 * (1 + i), -1.0, 2.0, float(i)]) for i in range(1, 100)] + [(6000, [0.0, 0.0]), *((6000 + i, [1e300 * i, 1.0]) for i in range(1, 100))]
    got = mtree.top_k(spark.createDataFrame(small + wide, "vec_id long, embedding array<double>"), F.col("id") % 40 == 0).collect()
    ints = {i: [int(256 * c) for c in v] for i, v in small + wide}
    for q in (i for i in ints if i % 40 == 0):
        top = sorted((-sum(a * b for a, b in zip(ints[q], x, strict=True)), i) for i, x in ints.items() if i != q and len(x) == len(ints[q]))[:5]
        assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in top]


def test_urls(spark):
    known = {(0, 4): -5.0, (4, 4): -6.0, (0, 3): -5.0}
    assert url_filter.best_split("freebets", known, -20.0) == ["free", "bets"] and url_filter.best_split("zqfree", {(2, 4): -3.0}, -9.0) == ["zq", "free"]
    rows = [(1, "http://WWW.Example.com/en/x?q#f"), (2, "https://a.example.com/en/"), (3, "http://b.net/es/1"), (4, "http://net/fr/"), (5, "http://x.org"), (6, None), (7, "no scheme"), (8, "http://free-casino.org/Play"), (9, "http://y.com?x"), (9, "http://a.com/b"), (None, "http://xnet/es/")]
    df = spark.createDataFrame([(i, u, "<title>free news</title>", 1, "v") for i, u in rows], "page_id long, url string, html string, n long, verdict string")
    out = url_filter.judge_urls(df).collect()
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in out}
    assert len(out) == len(rows) and got[1, "www.example.com", "/en/x"] == ("www.example.com/en/", "allow") and got[2, "a.example.com", "/en/"] == ("example.com/en/", "block")
    assert got[3, "b.net", "/es/1"] == ("net/es/", "block") and got[4, "net", "/fr/"] == ("net/fr/", "block") and got[9, "a.com", "/b"] == ("com/", "allow")
    assert got[6, "", ""] == (None, "allow") and got[7, "", ""] == (None, "allow") and got[8, "free-casino.org", "/Play"] == (None, "block")
    assert got[9, "y.com", ""][0] is None and got[None, "xnet", "/es/"][0] is None
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_urls_judged(spark):
    """Ordinary hosts are let through, whatever rules say of their language; hosts with an unwanted word are not, nor what keeps company with such words."""
    rng, syllables = random.Random(12), ["tion", "the", "ing", "and", "ou", "ble", "es", "er"]
    host = lambda: "".join(rng.choices(syllables, k=3))
    ordinary = [(i, f"http://{rng.choice(['', 'www.', 'm.'])}{host()}.example.{rng.choice(['org', 'net', 'com'])}/{rng.choice(['en', 'es', 'fr'])}/{i}") for i in range(800)]
    words = ["casino", "freebets", "adult", "pokerwin", "xxx-slots"]
    bad = [(1000 + i, f"http://{rng.choice(words)}{rng.choice(['', '-zoom'])}.example.org/en/{i}") for i in range(80)]
    alone = [(2000, "http://zoom.example.org/en/1")]
    df = spark.createDataFrame([(i, u, "<p>" + " ".join(syllables) + " zoom</p>") for i, u in ordinary + bad + alone], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert np.mean([got[i].verdict == "block" for i, _ in ordinary if got[i].rule is None]) < 0.05
    assert np.mean([got[i].verdict == "block" for i, _ in bad if got[i].rule is None]) > 0.95
    assert got[2000].score > 0 and url_filter.judge_urls(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://" + "ab" * 3000 + ".org/" + "x/" * 5000, None)], df.schema)
    assert url_filter.judge_urls(long).first().verdict == "allow"


def test_merkle(spark):
    rows = [(i, f"u{i}", f"p{i}") for i in range(700)] + [(None, None, None), (3, "u3", "p3")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit("x"))
    b = a.where("page_id is null or page_id <> 9").withColumn("html", F.when(F.col("page_id") == 300, "bad").otherwise(F.col("html"))).unionByName(a.where("page_id = 5"))
    found = merkle.fixity(merkle.archive(a), merkle.archive(b)).collect()
    assert sorted((r.position, r.status) for r in found) == [(5, "count"), (9, "missing"), (300, "corrupt")]
    block = lambda u, p: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(p)}\r\n\r\n{p}\r\n\r\n"
    file = "".join(block(u, p) for i, u, p in sorted((r for r in rows if r[0] is not None)))
    for r in found:  # the range is where the record lies in the archive
        assert r.warc_file == 0 and file[r.range_offset : r.range_offset + r.range_length] == block(f"u{r.position}", f"p{r.position}")
    far = spark.createDataFrame([(i, "u", LONG) for i in (0, 65535, 65536, 65540)], "page_id long, url string, html string")
    lost = merkle.fixity(merkle.archive(far), merkle.archive(far.where("page_id < 65540"))).first()
    assert (lost.warc_file, lost.range_offset) == (1, lost.range_length)
    assert merkle.fixity(merkle.archive(a), merkle.archive(a)).count() == 0 and merkle.fixity(merkle.archive(a.limit(0)), merkle.archive(a.limit(0))).count() == 0
    x, y = merkle.tree(merkle.archive(a)), merkle.tree(merkle.archive(a.repartition(7)))
    assert sorted(r.hash for r in x[-1].collect()) == sorted(r.hash for r in y[-1].collect()) and merkle.audit(x, y)[1] == [2]
    assert merkle.fixity(merkle.archive(a), merkle.archive(a.limit(0))).count() == 701


def test_pitman_yor(spark):
    rng = random.Random(8)
    follow = {"a": "b", "b": "c", "c": "the", "the": "a"}  # a context that tells something: words drawn alone would leave nothing to learn
    rows = list(DOCS)
    for i in range(100, 300):
        words = ["a"]
        for _ in range(29):
            words.append(follow[words[-1]] if rng.random() < 0.8 else rng.choice("abc"))
        rows.append((i, " ".join(words)))
    out = pitman_yor.score_texts(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b" end"]
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((d or -1, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((r.doc or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    many = [r for r in out if r.doc and r.doc >= 100 and r.held_out]
    assert sum(r.score for r in many) > sum(r.base_score for r in many) and all(r.score < 0 for r in out)
    assert pitman_yor.score_texts(frame(spark, rows).limit(0)).count() == 0


def test_pitman_yor_knows_every_context(spark, monkeypatch):
    """No context backs off, not even one that the sample lacks: with no frequent contexts but start and end, all counts go from bucket to bucket."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(300)}"]
        for _ in range(19):
            words.append(f"w{(int(words[-1][1:]) * 7 + 1) % 300}" if rng.random() < 0.9 else f"w{rng.randrange(300)}")
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, f"a{i} b{i} c{i}") for i in range(50)]  # contexts with a single customer
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    usual = {r.doc: r for r in pitman_yor.score_texts(frame(spark, rows)).collect()}
    monkeypatch.setattr(pitman_yor, "MOST_CONTEXTS", 0)
    few = {r.doc: r for r in pitman_yor.score_texts(frame(spark, rows)).collect()}
    assert len(usual) == len(few) == len(rows) and all(abs(usual[d].base_score - few[d].base_score) < 1e-9 for d in usual)
    for out in (usual, few):
        many = [r for r in out.values() if r.doc < 400 and r.held_out]
        assert sum(r.score for r in many) / sum(r.n_tokens for r in many) > -1.0 > -2.0 > sum(r.base_score for r in many) / sum(r.n_tokens for r in many)
        # the sole customer of each of three contexts (a, b, c) that nobody else visits; by the parent alone each would have some 1 in 2000
        once = [r for r in out.values() if r.doc >= 1000 and not held(r.doc)]
        assert all(r.score > r.base_score + 2 for r in once)
    assert abs(sum(r.score for r in usual.values()) / sum(r.score for r in few.values()) - 1) < 0.01


def test_pitman_yor_leaves_no_shuffle_files(spark):
    """Shuffles that are over take no disk beside later ones, whether or not the JVM has collected garbage."""
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in top for f in Path(d).rglob("shuffle_*")}
    docs = frame(spark, [(i, f"a{i % 7} b{i % 5} c") for i in range(200)])
    before = files()
    out = pitman_yor.score_texts(docs)
    until = time.monotonic() + 3  # they go in the background
    while (left := files() - before) and time.monotonic() < until:
        time.sleep(0.1)
    assert not left and out.count() == 200
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pitman_yor_answers_are_counts():
    """Probabilities that are made of a bucket's blocks are those of its seating to the last bit, and a block has far fewer bytes than they."""
    rng = np.random.default_rng(6)
    n_own, n_contexts, n_words = 20, 320, 300
    key = np.unique(np.concatenate((rng.integers(n_words * n_contexts, size=6000), rng.integers(n_words, size=6000) * n_contexts + rng.integers(n_own, size=6000))))
    token, context, c = key // n_contexts, key % n_contexts, np.minimum(rng.geometric(0.5, len(key)) - 1, 9)
    at = lambda x: np.bincount(context, x, minlength=n_contexts)
    words = np.where(np.arange(n_words) == 4, np.uint64(77), np.uint64(0))  # one is frequent: its counts are the driver's, of more buckets than this one
    keys = pitman_yor._pack(words, np.bincount(token).astype("<u2"), context.astype("<u2"), c.astype("<u1"))
    model = {"base": 1 / 301, "d": 0.7, "d0": 0.6, "customers": at(c)[:n_own], "heavy_names": np.array([77]), "heavy_total": np.array([5000.0])}
    model["after"] = [{"tables": at(c > 0)[:n_own], "root": float((c > 0).sum()), "root_tables": 300.0, "heavy": np.array([400.0]), "heavy_tables": np.array([1.0])}]
    met, saved, want = [pitman_yor._pack(at(c)[n_own:].astype("<u2"), at(c > 0)[n_own:].astype("<u2"))], [], 0
    for k in (1, 2, 3):
        s = pitman_yor._State(0, keys, model, met)
        if saved:
            s.load(saved[-1])
        s.run_to(k)
        saved.append(s.saved())
        met.append(pitman_yor._pack(at(s.t)[n_own:].astype("<u2")))
        model["after"].append({"tables": at(s.t)[:n_own], "root": float(s.t.sum()), "root_tables": float(s.root.t.sum()), "heavy": np.array([390.0 + k]), "heavy_tables": np.array([20.0 + k])})
        if k > 1:
            want = want + (s := _loaded(pitman_yor._State(0, keys, model, met), saved[-1])).predict(k) / 2
    by_rank = np.argsort(-model["customers"], kind="stable")
    told = s.told(saved[1:], 3, np.argsort(by_rank))
    blobs = [told.block(part) for part in (np.arange(0, 10), np.arange(10, len(key)))]
    total, p = pitman_yor._answered(model, blobs, by_rank, [2, 3])
    assert (p == want).all() and (total == s.total[token]).all() and (context >= n_own).any() and set(total[token == 4]) == {5000}
    assert len(blobs[1]) < 4 * len(key)


def _loaded(state, saved):
    state.load(saved)
    return state


def test_seats_are_saved():
    rng = np.random.default_rng(2)
    seats = pitman_yor.Seats(np.array([5, 0, 1, 300]), np.array([2, 0, 1, 40]))
    for _ in range(50):
        seats.join(np.array([0, 3]), np.full(2, 3.0), 0.5, rng)
    back = pitman_yor.Seats.of(*pitman_yor._unpack(pitman_yor._pack(*seats.tables())))
    assert (back.c == seats.c).all() and (back.t == seats.t).all() and all((x == y).all() for x, y in zip(back.tables(), seats.tables(), strict=True))
    for a in (np.array([0, 255], "<u1"), np.array([0, 65536], "<u4"), np.array([], "<u8"), np.array([1.5, -2.0])):
        (b,) = pitman_yor._unpack(pitman_yor._pack(a))
        assert b.dtype == a.dtype and (a == b).all()


def partitions(n):
    """(sizes, how many ways) of the partitions of n customers to tables."""
    def of(left, most):
        if not left:
            yield ()
        for k in range(min(left, most), 0, -1):
            for rest in of(left - k, k):
                yield (k, *rest)

    for sizes in of(n, n):
        ways = math.factorial(n)
        for k in sizes:
            ways //= math.factorial(k)
        for m in Counter(sizes).values():
            ways //= math.factorial(m)
        yield sizes, ways


def test_gibbs_against_enumeration():
    """The mean number of tables of each dish, and of the root's, against the sum over all seatings."""
    d, d0, theta, pairs, base = 0.5, 0.6, 1.0, {(0, 1): 3, (0, 2): 2, (1, 1): 2, (1, 2): 1}, 1 / 3
    sums, total, root_sum = Counter(), 0.0, 0.0

    def block(sizes, disc):
        return math.prod(j - disc for k in sizes for j in range(1, k))

    def seatings(keys):
        if not keys:
            yield {}, 1.0
            return
        for sizes, ways in partitions(pairs[keys[0]]):
            for rest, w in seatings(keys[1:]):
                yield {keys[0]: len(sizes), **rest}, w * ways * block(sizes, d)

    for tables, w in seatings(list(pairs)):
        for u in (1, 2):
            w *= math.prod(theta + d * i for i in range(sum(t for (_, x), t in tables.items() if x == u)))
        up = [sum(t for (word, _), t in tables.items() if word == k) for k in (0, 1)]
        for s0, w0 in partitions(up[0]):
            for s1, w1 in partitions(up[1]):
                n = len(s0) + len(s1)
                weight = w * w0 * w1 * block(s0, d0) * block(s1, d0) * math.prod(theta + d0 * i for i in range(n)) * base**n / math.prod(theta + i for i in range(sum(up)))
                total += weight
                root_sum += weight * n
                for k, t in tables.items():
                    sums[k] += weight * t
    words = np.array([3, 9], dtype=np.uint64)
    keys = pitman_yor._pack(words, np.array([2, 2], "<u2"), np.array([1, 2, 1, 2], "<u2"), np.array([3, 2, 2, 1], "<u2"))
    none = np.zeros(0, dtype=np.int64)
    model = {"n": 8, "v": 2, "base": base, "d": d, "d0": d0, "customers": np.array([0.0, 5, 3]), "heavy_names": none, "heavy_total": none}
    model["after"] = [{"tables": np.array([0.0, 2, 2]), "root": 4.0, "root_tables": 2.0, "heavy": none, "heavy_tables": none}]
    s, seen, root, n = pitman_yor._State(0, keys, model), np.zeros(4), 0, 4000
    for k in range(1, n + 1):
        s.run_to(k)
        _, by, _ = s.counts()
        tables = np.zeros(3)
        tables[by["k"]] = by["t"]
        model["after"].append({"tables": tables, "root": float(s.t.sum()), "root_tables": float(s.root.t.sum()), "heavy": none, "heavy_tables": none})
        assert (s.root.c == np.bincount(s.token, s.t, minlength=2)).all() and (s.seats.c == s.c[s.many]).all() and abs(s.customers - s.t.sum()) < 1e-9 or k == 1
        seen, root = seen + s.t, root + s.root.t.sum()
        p = s.predict(k)
        unseen = (theta + d0 * s.root.t.sum()) * base / (theta + s.t.sum())
        for u in (0, 1):  # the predictive probabilities of all dishes of a context, with all others, sum to one
            t_u, c_u = tables[u + 1], model["customers"][u + 1]
            assert abs(p[u] + p[u + 2] + (theta + d * t_u) / (theta + c_u) * unseen - 1) < 1e-9
    want = [sums[k] / total for k in ((0, 1), (0, 2), (1, 1), (1, 2))]
    assert np.abs(seen / n - want).max() < 0.04 and abs(root / n - root_sum / total) < 0.06, (seen / n, want, root / n, root_sum / total)


def test_seats():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 50, 1000])
    t = np.mean([pitman_yor.reseat(c, np.full(5, 0.5), 0.5, rng) for _ in range(200)], axis=0)
    assert t[0] == 0 and t[1] == 1 and 1 < t[2] < 1.6 and t[2] < t[3] < t[4] < 60
    seats = pitman_yor.Seats(np.array([5, 1, 300]), np.array([2, 1, 40]))
    for _ in range(300):
        rows = np.flatnonzero(rng.random(3) < 0.7)
        if rng.random() < 0.5:
            rows = rows[seats.c[rows] > 0]
            seats.leave(rows, rng)
        else:
            seats.join(rows, np.full(len(rows), 3.0), 0.5, rng)
        for i in range(3):
            own = seats.size[seats.start[i] : seats.end[i]]
            assert own.sum() == seats.c[i] and (own[: seats.t[i]] > 0).all() and not own[seats.t[i] :].any()
