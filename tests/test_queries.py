"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from chatloom.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cursor = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})")
    assert sorted(c[0] for c in cursor.description) == cols
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_conversations_beyond_the_last_day(spark, tmp_path):
    """Numbers whose day no count of nanoseconds holds; the sessions, but for their ids and so their split, are those of the given table."""
    c = spark.read.parquet(f"{DATA}/conversations.parquet")
    for name, by in (("near", 0), ("far", 10**9)):
        c.withColumn("conv_id", c["conv_id"] + by).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    near, far = ([(r.sessions, r.tokens, r.checksum) for r in QUERIES["byte_token_counts"](spark, f"{tmp_path}/{x}").collect()] for x in ("near", "far"))
    assert [sum(x) for x in zip(*near, strict=True)] == [sum(x) for x in zip(*far, strict=True)]
    assert sorted(near) == sorted((r.sessions, r.tokens, r.checksum) for r in QUERIES["byte_token_counts"](spark, DATA).collect())


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 45
