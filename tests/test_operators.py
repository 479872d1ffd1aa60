import plistlib
import random
import re
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from chatloom.functions.decode import decode_body
from chatloom.functions.ids import pseudonym
from chatloom.functions.scalars import epoch2001_to_unix_ns, parameter_count
from chatloom.functions.text import has_pii, normalize, redact, reply_prompt
from chatloom.operators import audit, extract, sessions, split, stats
from chatloom.plans.ranking import global_rank
from chatloom.schema import MESSAGES, MINUTE_NS
from chatloom.sources import files, sqlite
from chatloom.streaming.sessions import stream_sessions


def messages(spark, rows):
    return spark.createDataFrame([(f"m{i}", c, t, "me" if p == "me" else "other", p, f"x{i}", False, False, "s") for i, (c, t, p) in enumerate(rows)], MESSAGES)


def test_session_gap_is_strict_and_merge_gap_is_not(spark):
    h = 360 * MINUTE_NS
    s = sessions.sessionize(messages(spark, [("a", 0, "me"), ("a", h, "me"), ("a", 2 * h + 1, "x"), ("a", 2 * h + 1 + 2 * MINUTE_NS, "x"), ("a", 2 * h + 1 + 4 * MINUTE_NS, "x"), ("a", 2 * h + 2 + 6 * MINUTE_NS, "x")]))
    assert [(r.session_no, r.turn_no) for r in s.orderBy("timestamp_ns").collect()] == [(1, 1), (1, 2), (2, 3), (2, 3), (2, 3), (2, 4)]


def test_sessionize_random(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(60) * 30 * MINUTE_NS // 7, rng.choice(["me", "x", "y"])) for _ in range(300)]
    got = {r.message_id: (r.session_no, r.turn_no) for r in sessions.sessionize(messages(spark, rows), 30, 2).collect()}
    for chat in "ab":
        s = t = 0
        last = None
        for i in sorted((i for i, r in enumerate(rows) if r[0] == chat), key=lambda i: (rows[i][1], f"m{i}")):
            new = last is None or rows[i][1] - rows[last][1] > 30 * MINUTE_NS
            turn = new or rows[i][2] != rows[last][2] or rows[i][1] - rows[last][1] > 2 * MINUTE_NS
            s, t, last = s + new, t + turn, i
            assert got[f"m{i}"] == (s, t)


def test_split_ties_guard_and_errors(spark):
    rows = [(f"s{i:02}", i, i * 10, 2, False, f"t{i}") for i in range(40)] + [("duplicate", 0, 0, 2, False, "t0")]
    df = spark.createDataFrame(rows, "session_id string, start_ns long, end_ns long, turn_count long, is_group boolean, text string")
    out = split.chrono_split(df, guard_ns=0)
    assert {r.split: r.sessions for r in split.split_report(out).collect()} == {"train": 36, "validation": 2, "test": 2}
    assert out.where("session_id = 'duplicate'").count() == 1 and out.count() == 40
    split.check_split(out)
    with pytest.raises(ValueError):
        split.check_split(split.chrono_split(df, guard_ns=10**6))
    with pytest.raises(ValueError):
        split.chrono_split(df.limit(2), guard_ns=0)
    with pytest.raises(ValueError):
        split.chrono_split(df, (0.5, 0.1, 0.1))


def python_normal(t):
    t = unicodedata.normalize("NFC", t)
    t = re.sub("\r\n?", "\n", t).replace("\0", "").replace("￼", "")
    t = re.sub("[\t\f\v ]+", " ", t)
    t = "\n".join(x.strip() for x in t.split("\n"))
    return re.sub("\n{4,}", "\n\n\n", t).strip()


def test_normalize_random(spark):
    rng = random.Random(1)
    alphabet = ["a", "é", "é", " ", "\t", "\n", "\n", "\r", "\r\n", " ", " ", " ", "\x85", "\0", "￼", "\x1c", "\x0b", "👍", "　"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(14))) for _ in range(1500)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(normalize(F.col("t"))).collect()]
    assert got == [python_normal(t) for t in texts]


def test_redact(spark):
    df = spark.createDataFrame([("mail a.b@c.org or +1 (555) 123-4567, see https://x.y/z?q=a@b.cd",), ("id 12",), (None,)], "t string")
    got = [r[0] for r in df.select(redact(F.col("t"))).collect()]
    assert got == ["mail <|email|> or <|phone|>, see <|url|>", "id 12", None]
    assert [r[0] for r in df.select(has_pii(F.col("t"))).collect()] == [True, False, None]
    assert df.select(redact(F.col("t"), urls=False, emails=False, phones=False)).first()[0].startswith("mail a.b@c.org")


def test_pseudonym_is_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k" * 32, b"k" * 100):
        got = spark.range(1).select(pseudonym(F.lit("x"), key, "chat")).first()[0]
        assert got == hmac.new(key, b"chat\0x", hashlib.sha256).hexdigest()[:24]


def test_times(spark):
    df = spark.createDataFrame([(700000000,), (700000000_000,), (700000000_000_000,), (700000000_000_000_000,), (None,)], "r long")
    got = [r[0] for r in df.select(epoch2001_to_unix_ns(F.col("r"))).collect()]
    assert got[:1] == [1678307200 * 10**9] and all(abs(g - got[0]) < 1000 for g in got[:4]) and got[4] == 0
    with pytest.raises(Exception, match="implausible"):
        spark.createDataFrame([(-(10**10),)], "r long").select(epoch2001_to_unix_ns(F.col("r"))).collect()


def test_parameter_count(spark):
    x = lambda *a: spark.range(1).select(parameter_count(*map(F.lit, a))).first()[0]
    assert x(4096, 128, 4, 384, True) > 1_000_000 and x(64, 32, 1, 64, False) - x(64, 32, 1, 64, True) == 64 * 32


def test_decode():
    assert decode_body(plistlib.dumps({"NSString": "hello there", "n": 1}, fmt=plistlib.FMT_BINARY)) == "hello there"
    assert decode_body(b"\x01\x02Hi you\x00\x03AB") == "Hi you"
    body = b"\x04\x0bstreamtyped\x81\xe8\x03\x84\x01@\x84\x84\x84\x12NSAttributedString\x00\x84\x84\x08NSObject\x00\x85\x92\x84\x84\x84\x08NSString\x01\x94\x84\x01+\x0bHello world\x86\x84"
    assert decode_body(body) == "Hello world"
    assert decode_body(b"") is None and decode_body(None) is None and decode_body(" x ") == "x" and decode_body(b"NSString") is None


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "chat.db"
    c = sqlite3.connect(path)
    c.executescript("""
    CREATE TABLE handle (ROWID INTEGER PRIMARY KEY, id TEXT); CREATE TABLE chat (ROWID INTEGER PRIMARY KEY, chat_identifier TEXT);
    CREATE TABLE message (ROWID INTEGER PRIMARY KEY, guid TEXT, text TEXT, attributedBody BLOB, is_from_me INTEGER DEFAULT 0, handle_id INTEGER, date INTEGER, service TEXT, item_type INTEGER DEFAULT 0, associated_message_type INTEGER DEFAULT 0, is_deleted INTEGER DEFAULT 0);
    CREATE TABLE chat_message_join (chat_id INTEGER, message_id INTEGER); CREATE TABLE chat_handle_join (chat_id INTEGER, handle_id INTEGER); CREATE TABLE message_attachment_join (message_id INTEGER, attachment_id INTEGER);
    INSERT INTO handle VALUES (1, 'who@x.org'), (2, '+1555'); INSERT INTO chat VALUES (1, 'one'), (2, 'many'); INSERT INTO chat_handle_join VALUES (1, 1), (2, 1), (2, 2);""")
    rows = [(1, "a", "Write to a@b.org", None, 0, 1, 0, 0, 0), (2, "b", "ok", None, 1, 0, 0, 0, 0), (3, "c", None, plistlib.dumps({"k": "from the body"}, fmt=plistlib.FMT_BINARY), 0, 1, 0, 0, 0), (4, "d", "x", None, 0, 1, 0, 2000, 0), (5, "e", "x", None, 0, 1, 1, 0, 0), (6, "f", None, None, 0, 1, 0, 0, 0), (7, "g", "x", None, 0, 1, 0, 0, 1), (8, "h", "group", None, 0, 2, 0, 0, 0), (9, "i", None, None, 0, 2, 0, 0, 0), (10, "j", "￼", None, 0, 2, 0, 0, 0)]
    c.executemany("INSERT INTO message (ROWID, guid, text, attributedBody, is_from_me, handle_id, item_type, associated_message_type, is_deleted, date, service) VALUES (?,?,?,?,?,?,?,?,?,700000000,'S')", rows)
    c.executemany("INSERT INTO chat_message_join VALUES (?, ?)", [(2 if r[0] >= 8 else 1, r[0]) for r in rows])
    c.executemany("INSERT INTO message_attachment_join VALUES (?, 1)", [(6,), (8,)])
    c.commit()
    c.close()
    return path


def test_extract_from_sqlite(spark, database):
    tables = sqlite.read_tables(spark, database, 3)
    got = extract.classify(tables)
    r = extract.accounting(got).first().asDict()
    assert r["total_rows"] == 10 and r["retained_rows"] == 4 and r["recovered_attributed_body"] == 1 and r["all_rows_accounted_for"]
    assert all(r[f"excluded_{x}"] == 1 for x in ("deleted", "reaction", "system_event", "attachment_only", "unrecoverable_body", "empty_after_normalization"))
    assert (r["group_rows"], r["outgoing_rows"], r["body_recovery_rate"]) == (1, 1, 0.8)
    with pytest.raises(RuntimeError):
        extract.check_accounting(extract.accounting(got))
    m = extract.canonical(got, b"k" * 32)
    assert {x.text for x in m.collect()} == {"Write to <|email|>", "ok", "from the body", "group\n<|attachment|>"}
    assert audit.privacy_audit(m).first()["passed"] and not audit.privacy_audit(m.withColumn("text", F.lit("a@b.org"))).first()["passed"]
    lines = m.select(F.to_json(F.struct(*sorted(m.columns))).alias("value"))
    assert audit.privacy_audit_json(lines).first()["passed"]
    assert sqlite.catalog(database)["missing_expected_tables"] == ["attachment"]
    assert sqlite.can_open(database)[0] and not sqlite.can_open(database.parent / "none.db")[0]


def test_files(spark, database, tmp_path):
    m = files.snapshot(database, tmp_path / "a/b/copy.db")
    assert m["quick_check"] == "ok" and (tmp_path / "a/b").stat().st_mode & 0o777 == 0o700 and (tmp_path / "a/b/copy.db").stat().st_mode & 0o777 == 0o600
    with pytest.raises(ValueError):
        files.snapshot(database, database)
    assert files.load_or_create_key(tmp_path / "k") == files.load_or_create_key(tmp_path / "k")
    assert files.sha256_files(spark, str(tmp_path / "k")).first()["sha256"] == files.sha256_file(tmp_path / "k")
    df = spark.createDataFrame([(1, None)], "b int, a string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"b":1}'
    assert files.read_jsonl(spark, str(tmp_path / "j"), "b int, a string").collect() == df.collect()


def test_rank_and_windows(spark):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    assert [r.rank for r in global_rank(df, "k", "id").orderBy("k", "id").collect()] == list(range(1000))
    docs = spark.createDataFrame([(i, list(range(i % 5))) for i in range(50)], "doc long, ids array<long>")
    flat = [x for i in range(50) for x in range(i % 5)]
    w = stats.windows(stats.token_stream(docs, "doc"), 6).orderBy("window_no").collect()
    assert [r.ids for r in w] == [flat[a : a + 7] for a in range(0, len(flat) - 6, 7)]


def test_reply_prompt(spark):
    df = spark.sql("SELECT array(named_struct('role', 'me', 'text', 'a')) AS h, 'b' AS m")
    assert df.select(reply_prompt(F.col("h"), F.col("m"))).first()[0] == "<|bos|><|conversation|>\n<|me|>a<|turn_end|>\n<|other|>b<|turn_end|>\n<|me|>"


def test_stream(spark, tmp_path):
    df = spark.sql("SELECT 'a' AS chat_id, explode(array(timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 06:00:00', timestamp'2024-01-01 12:00:01', timestamp'2024-02-01 00:00:00')) AS ts")
    df.write.parquet(str(tmp_path / "in"))
    q = stream_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n_messages for r in spark.table("sessions").collect()) == [1, 2]


def test_early_stopping_over_blocks(spark):
    """Against a plain loop, over several blocks of evaluations, without one task that sees them all."""
    rng = random.Random(7)
    log = [(3 * k, None if k % 1000 == 9 else round(2000 / (1 + k / 3) + rng.random(), 6)) for k in range(13000)]
    for patience in (30, 2500, 10**6):
        want, low, last = [], None, 0
        for k, (step, loss) in enumerate(log):
            improved = low is None or loss is None or loss < low
            low = loss if low is None else low if loss is None else min(low, loss)
            last = k if improved else last
            want.append((step, loss, improved, k - last, low))
            if k - last >= patience:
                break
        df = spark.createDataFrame(log, "step long, loss double").repartition(3)
        out = stats.early_stopping(df, patience)
        assert [tuple(r) for r in out.select("step", "loss", "improved", "stale", "best").orderBy("step").collect()] == want
        assert "SinglePartition" not in out._jdf.queryExecution().toString()
