"""The corpus queries against their SQL, and the pipeline's stages and run."""

import os
import random
import re

import duckdb
import pytest

from chatloom.llm import line_rules, queries, url_filter

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(df, duck, sql):
    cols = sorted(df.columns)
    cursor = duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})")
    assert sorted(c[0] for c in cursor.description) == cols
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLES[name])


def test_base_columns(spark, duck):
    same(queries.QUERIES["op10_line_rules"](spark, DATA).drop("content_share", "kept"), duck, line_rules.BASE_SQL)
    same(queries.QUERIES["op8_url_filter"](spark, DATA).drop("verdict", "score"), duck, url_filter.RULE_SQL)


def test_all_ten():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))


def shingles(text):
    w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_pipeline_stages(spark):
    """Each stage on all that the one before kept, over documents with nulls, clashing columns, copies and passages."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(1)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    pool = [w for r in docs.where("lang = 'en'").collect() if labels.get(r.doc_id) == (1, 0) for w in r.text.split()]
    passage = " ".join(rng.choices(pool, k=70))
    own = [" ".join(rng.choices(pool, k=90)) for _ in range(6)]
    more = [(10**6 + i, f"{own[i]}\n{passage}" if i < 4 else own[i] if i < 6 else own[i - 6] + " end" if i < 9 else [None, "", " \n"][i - 9]) for i in range(12)]
    extra = spark.createDataFrame([(i, t, "en", None if i % 2 else "zz", len(t or "")) for i, t in more], docs.schema)
    docs, kept = docs.unionByName(extra), {}
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert name == "packing" or docs.columns == cols, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
    all_texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()} | dict(more)
    ids = {n: [r.doc_id for r in rows] for n, rows in kept.items()}
    good, bad = [d for d, l in labels.items() if l == (1, 0)], [d for d, l in labels.items() if l != (1, 0)]
    assert sum(d in ids["quality"] for d in good) >= 0.98 * len(good) and sum(d in ids["quality"] for d in bad) <= 0.3 * len(bad)  # learnt from 87 labels
    cut = {r.doc_id: r for r in kept["line_dedup"]}
    assert set(cut) == set(ids["quality"]) and sum(passage in (r.text or "") for r in cut.values()) == 1
    assert all(r.n_chars == len(r.text or "") for d, r in cut.items() if r.text != all_texts[d])
    texts = sorted((d, shingles(r.text)) for d, r in cut.items())
    root = {d: d for d, _ in texts}
    for i, (d, x) in enumerate(texts):
        for e, y in texts[:i]:
            if root[d] != root[e] and 10 * len(x & y) >= 8 * len(x | y):
                low, high = sorted((root[d], root[e]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(ids["near_duplicates"]) == sorted(set(root.values()))
    size = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in kept["near_duplicates"]}
    assert abs(sum(size[d] for d in ids["mixing"]) - sum(size.values())) <= 0.02 * sum(size.values()) and set(ids["mixing"]) <= set(size)
    assert {d for d in ids["packing"]} == set(ids["mixing"])


def test_pipeline_run(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert out and all(sum(n for _, n in sorted(s)[:k]) == o for s in by.values() for k, (o, _) in enumerate(sorted(s)))
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
