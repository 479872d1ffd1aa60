"""The engine's queries over the test tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions.ids import hash_shaped, pads, pseudonym
from .functions.scalars import epoch2001_to_unix_ns, learning_rate
from .functions.text import delta, has_pii, normalize, redact
from .functions.tokens import encode_splits
from .model import scoring
from .operators import audit, extract, sessions, split, stats
from .plans.ranking import global_rank
from .schema import DAY_NS, MINUTE_NS

KEY = b"0123456789abcdef0123456789abcdef"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Adapters: events and conversations as messages.

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def event_messages(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.format_string("%012d", "event_id").alias("message_id"), F.col("user_id").cast("string").alias("chat_id"), (F.expr(MICROS) * 1000).alias("timestamp_ns"), F.when(F.col("event_type") == "click", "me").otherwise("other").alias("sender_role"), F.col("event_type").alias("participant_id"), F.col("event_type").alias("text"), F.lit(False).alias("has_attachment"), (F.col("user_id") % 2 == 0).alias("is_group"), F.lit("web").alias("service"))


EVENTS_CTE = "m AS (SELECT format('{:012d}', event_id) AS message_id, CAST(user_id AS VARCHAR) AS chat_id, epoch_us(ts) * 1000 AS timestamp_ns, CASE WHEN event_type = 'click' THEN 'me' ELSE 'other' END AS sender_role, event_type AS participant_id, event_type AS text, user_id % 2 = 0 AS is_group FROM events)"


#: The last whole day that nanoseconds in a long can tell.
LAST_DAY = ((1 << 63) - 1) // DAY_NS


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """A conversation has the day of its number, and a turn its minute. Numbers beyond LAST_DAY, which SQL cannot tell either, take the days from 0 again; chats stay apart by chat_id."""
    c = read(spark, d, "conversations")
    role = F.when(F.col("role") == "assistant", "me").otherwise("other")
    day = F.when(F.col("conv_id").between(-LAST_DAY, LAST_DAY), F.col("conv_id")).otherwise(F.col("conv_id") % 100_000)
    return c.select(F.format_string("%012d", "turn").alias("message_id"), F.col("conv_id").cast("string").alias("chat_id"), (day * DAY_NS + F.col("turn") * MINUTE_NS).alias("timestamp_ns"), role.alias("sender_role"), F.col("role").alias("participant_id"), "text", F.lit(False).alias("has_attachment"), F.lit(False).alias("is_group"), F.lit("chat").alias("service"))


CHATS_CTE = "m AS (SELECT format('{:012d}', turn) AS message_id, CAST(conv_id AS VARCHAR) AS chat_id, conv_id * 86400000000000 + turn * 60000000000 AS timestamp_ns, CASE WHEN role = 'assistant' THEN 'me' ELSE 'other' END AS sender_role, role AS participant_id, text, false AS is_group FROM conversations)"
SESSION_CTES = """
f AS (SELECT *, timestamp_ns - lag(timestamp_ns) OVER o AS dt, lag(participant_id) OVER o AS pp FROM m WINDOW o AS (PARTITION BY chat_id ORDER BY timestamp_ns, message_id)),
g AS (SELECT *, coalesce(dt > 21600000000000, true) AS ns, coalesce(dt > 21600000000000, true) OR pp <> participant_id OR dt > 120000000000 AS nt FROM f),
s AS (SELECT *, sum(ns::INT) OVER o AS session_no, sum(nt::INT) OVER o AS turn_no FROM g WINDOW o AS (PARTITION BY chat_id ORDER BY timestamp_ns, message_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT chat_id, session_no, turn_no, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns, min(sender_role) AS sender_role, count(*) AS n_messages, bool_or(is_group) AS is_group, string_agg(text, chr(10) ORDER BY timestamp_ns, message_id) AS text FROM s GROUP BY ALL),
u AS (SELECT chat_id, session_no, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS turn_count, bool_or(is_group) AS is_group, '<|bos|><|conversation|>' || chr(10) || string_agg(CASE sender_role WHEN 'me' THEN '<|me|>' ELSE '<|other|>' END || text || '<|turn_end|>', chr(10) ORDER BY turn_no) || chr(10) || '<|eos|>' AS text FROM t GROUP BY chat_id, session_no),
v AS (SELECT left(sha256(chat_id || chr(0) || start_ns || chr(0) || end_ns || chr(0) || text), 24) AS session_id, * FROM u WHERE turn_count >= 2)"""


@query(f"WITH {EVENTS_CTE}, {SESSION_CTES} SELECT chat_id, session_no::BIGINT AS session_no, count(*) AS n_events, min(timestamp_ns)::BIGINT AS start_ns, max(timestamp_ns)::BIGINT AS end_ns FROM s GROUP BY ALL")
def sessionize_events(spark, d):
    s = sessions.sessionize(event_messages(spark, d))
    return s.groupBy("chat_id", "session_no").agg(F.count("*").alias("n_events"), F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns"))


@query(f"WITH {EVENTS_CTE}, {SESSION_CTES} SELECT (SELECT count(*) FROM m) AS input_messages, count(DISTINCT chat_id) AS chats, count(*) FILTER (WHERE turn_count >= 2) AS sessions, count(*) FILTER (WHERE turn_count < 2) AS discarded FROM u")
def session_report(spark, d):
    return sessions.session_report(event_messages(spark, d))


@query(f"WITH {EVENTS_CTE}, {SESSION_CTES} SELECT chat_id, session_no::BIGINT AS session_no, turn_no::BIGINT AS turn_no, start_ns::BIGINT AS start_ns, end_ns::BIGINT AS end_ns, n_messages, text FROM t")
def merge_turns(spark, d):
    return sessions.turns(sessions.sessionize(event_messages(spark, d))).select("chat_id", "session_no", "turn_no", "start_ns", "end_ns", "n_messages", "text")


@query(f"WITH {CHATS_CTE}, {SESSION_CTES} SELECT sender_role, count(*) AS turns, sum(n_messages)::BIGINT AS messages FROM t GROUP BY 1")
def turn_counts(spark, d):
    return sessions.turns(sessions.sessionize(chat_messages(spark, d))).groupBy("sender_role").agg(F.count("*").alias("turns"), F.sum("n_messages").alias("messages"))


@query(f"WITH {CHATS_CTE}, {SESSION_CTES} SELECT session_id, start_ns::BIGINT AS start_ns, end_ns::BIGINT AS end_ns, turn_count, is_group, text FROM v")
def serialize_sessions(spark, d):
    return sessions.build_sessions(chat_messages(spark, d))


DEDUP_SQL = "SELECT doc_id, sha256(text) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1"


@query(DEDUP_SQL)
def dedup_documents(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return split.first_wins(docs, "content_hash", "doc_id")


@query("SELECT count(*) AS documents, count(DISTINCT sha256(text)) AS distinct_texts, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents")
def duplicate_report(spark, d):
    h = read(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n"))
    return h.agg(F.sum("n").alias("documents"), F.count("*").alias("distinct_texts"), F.sum(F.col("n") - 1).alias("duplicates"))


SPLIT_CTES = f"""WITH {EVENTS_CTE}, {SESSION_CTES},
d AS (SELECT *, sha256(text) AS content_hash FROM v QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY end_ns, session_id) = 1),
r AS (SELECT *, row_number() OVER (ORDER BY end_ns, session_id) - 1 AS i, count(*) OVER () AS n FROM d),
b AS (SELECT max(end_ns) FILTER (WHERE i = i1) AS b1, max(end_ns) FILTER (WHERE i = greatest(i1 + 1, least(n - 1, floor(n * (0.9::DOUBLE + 0.05::DOUBLE))::BIGINT))) AS b2 FROM (SELECT *, greatest(1, least(n - 2, floor(n * 0.9::DOUBLE)::BIGINT)) AS i1 FROM r)),
x AS (SELECT r.*, CASE WHEN abs(end_ns - b1) < 21600000000000 OR abs(end_ns - b2) < 21600000000000 THEN 'guard' WHEN end_ns < b1 THEN 'train' WHEN end_ns < b2 THEN 'validation' ELSE 'test' END AS split FROM r, b)"""


def event_split(spark, d):
    return split.chrono_split(sessions.build_sessions(event_messages(spark, d)), guard_ns=360 * MINUTE_NS)


@query(f"{SPLIT_CTES} SELECT session_id, content_hash, end_ns::BIGINT AS end_ns, split FROM x")
def chrono_split(spark, d):
    return event_split(spark, d).select("session_id", "content_hash", "end_ns", "split")


@query(f"{SPLIT_CTES} SELECT split, count(*) AS sessions, min(start_ns)::BIGINT AS first_ns, max(end_ns)::BIGINT AS last_ns FROM x GROUP BY 1")
def split_report(spark, d):
    return split.split_report(event_split(spark, d))


@query(f"{SPLIT_CTES} SELECT count(*) FILTER (WHERE k > 1) AS overlap FROM (SELECT count(DISTINCT split) AS k FROM x WHERE split <> 'guard' GROUP BY content_hash)")
def split_leakage(spark, d):
    return split.leakage(event_split(spark, d))


# The same patterns in RE2, which has no lookaround and an ASCII \\w: the character before a phone number is kept instead.
URL_RE, EMAIL_RE, PHONE_RE = r"(?i)\b(?:https?://|www\.)\S+", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"(^|[^\w\p{L}\p{N}])(?:\+?\d[\d ().-]{7,}\d)\b"


def _sub(x: str, urls=True, emails=True, phones=True) -> str:
    if urls:
        x = f"regexp_replace({x}, '{URL_RE}', '<|url|>', 'g')"
    if emails:
        x = f"regexp_replace({x}, '{EMAIL_RE}', '<|email|>', 'g')"
    return f"regexp_replace({x}, '{PHONE_RE}', '\\1<|phone|>', 'g')" if phones else x


def _redact(name: str, **on) -> None:
    def f(spark, d):
        return read(spark, d, "documents").select("doc_id", F.md5(redact(F.col("text"), **on)).alias("redacted_md5"))

    f.__name__ = name
    query(f"SELECT doc_id, md5({_sub('text', **on)}) AS redacted_md5 FROM documents")(f)


_redact("redact_url", emails=False, phones=False)
_redact("redact_email", urls=False, phones=False)
_redact("redact_phone", urls=False, emails=False)
_redact("redact_all")
PII_SQL = f"(regexp_matches(text, '{URL_RE}') OR regexp_matches(text, '{EMAIL_RE}') OR regexp_matches(text, '{PHONE_RE}'))"


@query(f"SELECT doc_id FROM documents WHERE {PII_SQL}")
def pii_predicate(spark, d):
    return read(spark, d, "documents").where(has_pii(F.col("text"))).select("doc_id")


@query("SELECT page_id, md5(" + _sub("url") + ") AS redacted_md5 FROM pages")
def redact_pages(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(redact(F.col("url"))).alias("redacted_md5"))


def document_messages(spark, d):
    docs = read(spark, d, "documents")
    ids = {c: pseudonym(F.col(x), KEY, n) for c, x, n in (("message_id", "doc_id", "message"), ("chat_id", "source", "chat"))}
    who = F.when(F.col("doc_id") % 10 == 0, F.col("source")).otherwise(pseudonym(F.col("lang"), KEY, "participant"))
    return docs.select(ids["message_id"].alias("message_id"), ids["chat_id"].alias("chat_id"), F.col("doc_id").alias("timestamp_ns"), F.when(F.col("doc_id") % 7 == 0, "bot").otherwise("me").alias("sender_role"), who.alias("participant_id"), "text", F.lit(False).alias("has_attachment"), F.lit(False).alias("is_group"), F.lit("x").alias("service"))


@query(f"SELECT count(*) AS records, count(*) FILTER (WHERE len(array_distinct(['chat_id', 'has_attachment', 'is_group', 'message_id', 'participant_id', 'sender_role', 'service', 'text', 'timestamp_ns'])) <> 9) AS unexpected_schema_records, count(*) FILTER (WHERE doc_id % 10 = 0) AS invalid_hashed_identifier_records, count(*) FILTER (WHERE doc_id % 7 = 0) AS invalid_role_records, count(*) FILTER (WHERE {PII_SQL}) AS obvious_pii_records, count(*) > 0 AND count(*) FILTER (WHERE doc_id % 10 = 0 OR doc_id % 7 = 0 OR {PII_SQL}) = 0 AS passed FROM documents")
def privacy_audit(spark, d):
    return audit.privacy_audit(document_messages(spark, d))


WS = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NORM_SQL = rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), chr(0), ''), chr(65532), ''), '[\t\f\x0B ]+', ' ', 'g'), '(?:\A|\z)', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^{WS}+', ''), '{WS}+$', '')), chr(10)) AS t FROM a)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^{WS}+', ''), '{WS}+$', '')) AS normalized_md5 FROM b"""


@query(NORM_SQL)
def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(normalize(F.col("text"))).alias("normalized_md5"))


INNER, OUTER = (p.hex() for p in pads(KEY))


def _hmac(value: str, ns: str) -> str:
    return f"left(sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode('{ns}' || chr(0) || {value})))), 24)"


@query(f"SELECT c_custkey, {_hmac('c_name', 'participant')} AS participant_id, {_hmac('CAST(c_custkey AS VARCHAR)', 'chat')} AS chat_id FROM customer")
def pseudonymize(spark, d):
    return read(spark, d, "customer").select("c_custkey", pseudonym(F.col("c_name"), KEY, "participant").alias("participant_id"), pseudonym(F.col("c_custkey"), KEY, "chat").alias("chat_id"))


@query("SELECT c_custkey % 3 AS k, count(*) FILTER (WHERE c_custkey % 3 = 0) AS shaped FROM customer GROUP BY 1")
def hash_shape_audit(spark, d):
    c = read(spark, d, "customer").withColumn("id", F.when(F.col("c_custkey") % 3 == 0, pseudonym(F.col("c_name"), KEY, "x")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")))
    return c.groupBy((F.col("c_custkey") % 3).alias("k")).agg(F.count_if(hash_shaped(F.col("id"))).alias("shaped"))


@query("""WITH u AS (SELECT event_id, event_id % 4 AS unit, epoch_us(ts) - 978307200000000 AS us FROM events),
r AS (SELECT event_id, CASE unit WHEN 0 THEN us // 1000000 WHEN 1 THEN us // 1000 WHEN 2 THEN us ELSE us * 1000 END AS raw FROM u)
SELECT event_id, CASE WHEN raw >= 1e17 THEN trunc((raw::DOUBLE / 1e9::DOUBLE + 978307200::DOUBLE) * 1e9::DOUBLE)::BIGINT WHEN raw >= 1e14 THEN trunc((raw::DOUBLE / 1e6::DOUBLE + 978307200::DOUBLE) * 1e9::DOUBLE)::BIGINT WHEN raw >= 1e11 THEN trunc((raw::DOUBLE / 1e3::DOUBLE + 978307200::DOUBLE) * 1e9::DOUBLE)::BIGINT ELSE (raw + 978307200) * 1000000000 END AS unix_ns FROM r""")
def epoch_convert(spark, d):
    us = F.expr(MICROS) - 978307200000000
    unit = F.col("event_id") % 4
    raw = F.when(unit == 0, F.floor(us / 1000000)).when(unit == 1, F.floor(us / 1000)).when(unit == 2, us).otherwise(us * 1000).cast("long")
    return read(spark, d, "events").select("event_id", epoch2001_to_unix_ns(raw).alias("unix_ns"))


def order_tables(spark, d) -> dict[str, DataFrame]:
    """orders, lineitem and customer in the shape of message tables."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    k = F.col("o_orderkey")
    text = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "  ").when(k % 17 == 0, "￼").otherwise(F.col("o_orderpriority"))
    message = o.select(k.alias("ROWID"), F.concat(F.lit("g"), k.cast("string")).alias("guid"), text.alias("text"), F.when(k % 22 == 0, F.col("o_orderstatus").cast("binary")).alias("attributedBody"), (F.col("o_orderstatus") == "F").cast("long").alias("is_from_me"), F.col("o_custkey").alias("handle_id"), F.lit(700000000).cast("long").alias("date"), (k % 19 == 0).cast("long").alias("is_deleted"), F.when(k % 23 == 0, 2000).alias("associated_message_type"), (k % 29 == 0).cast("long").alias("item_type"))
    # Every seventh order has a handle that no customer row has; some customers have no name; every second supplier's chat has two members.
    message = message.withColumn("handle_id", F.when(F.col("ROWID") % 7 == 0, -F.col("handle_id")).otherwise(F.col("handle_id")))
    handle = read(spark, d, "customer").select(F.col("c_custkey").alias("ROWID"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("id"))
    two = F.explode(F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    members = read(spark, d, "supplier").select(F.col("s_suppkey").alias("chat_id"), "s_nationkey", two.alias("k")).select("chat_id", F.col("s_nationkey").alias("handle_id"))
    attachments = li.select(F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("attachment_id"), "l_returnflag").where("l_returnflag = 'R'").drop("l_returnflag")
    return {"message": message, "handle": handle, "chat_message_join": li.select(F.col("l_suppkey").alias("chat_id"), F.col("l_orderkey").alias("message_id")), "message_attachment_join": attachments, "chat_handle_join": members}


ORDER_CTES = """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT l_orderkey AS k, min(l_suppkey) AS chat FROM lineitem GROUP BY 1),
m AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS own, CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS handle, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority END AS t, o_orderkey % 22 = 0 AS blob, a.k IS NOT NULL AS att, chat, coalesce(chat % 2 = 0 AND s_suppkey IS NOT NULL, false) AS grp FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey LEFT JOIN supplier ON s_suppkey = chat),
x AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'excluded_deleted' WHEN k % 23 = 0 THEN 'excluded_reaction' WHEN k % 29 = 0 THEN 'excluded_system_event' WHEN t IS NULL AND NOT blob AND att THEN 'excluded_attachment_only' WHEN t IS NULL AND NOT blob THEN 'excluded_unrecoverable_body' WHEN t = '' AND NOT (blob AND t IS NULL) THEN 'excluded_empty_after_normalization' ELSE 'retained' END AS disposition FROM m)"""
WHO_SQL = "CASE WHEN c_custkey % 3 <> 0 THEN c_name WHEN c_custkey IS NOT NULL THEN CAST(c_custkey AS VARCHAR) WHEN handle <> 0 THEN CAST(handle AS VARCHAR) ELSE 'unknown' END"


def classified_orders(spark, d):
    return extract.classify(order_tables(spark, d))


@query(f"{ORDER_CTES} SELECT disposition, count(*) AS n FROM x GROUP BY 1")
def disposition_accounting(spark, d):
    return classified_orders(spark, d).groupBy("disposition").agg(F.count("*").alias("n"))


@query(f"{ORDER_CTES} SELECT count(*) AS total_rows, count(*) FILTER (WHERE disposition = 'retained') AS retained_rows, count(*) FILTER (WHERE disposition = 'retained' AND own) AS outgoing_rows, count(*) FILTER (WHERE disposition = 'retained' AND t IS NULL) AS recovered_attributed_body, count(*) = count(*) FILTER (WHERE disposition = 'retained') + count(*) FILTER (WHERE disposition LIKE 'excluded%') AS all_rows_accounted_for, round(count(*) FILTER (WHERE disposition = 'retained') / count(*) FILTER (WHERE disposition IN ('retained', 'excluded_unrecoverable_body')), 9) AS body_recovery_rate FROM x")
def recovery_rate(spark, d):
    return extract.accounting(classified_orders(spark, d)).select("total_rows", "retained_rows", "outgoing_rows", "recovered_attributed_body", "all_rows_accounted_for", F.round("body_recovery_rate", 9).alias("body_recovery_rate"))


@query(f"{ORDER_CTES} SELECT k AS o_orderkey, {WHO_SQL} AS handle_name FROM m LEFT JOIN customer ON c_custkey = handle")
def lookup_fallback_join(spark, d):
    return classified_orders(spark, d).select(F.col("ROWID").alias("o_orderkey"), F.col("handle_name"))


@query(f"{ORDER_CTES} SELECT k AS o_orderkey, att AS has_attachment FROM m")
def exists_flag(spark, d):
    return classified_orders(spark, d).select(F.col("ROWID").alias("o_orderkey"), "has_attachment")


@query(f"{ORDER_CTES} SELECT k AS o_orderkey, chat AS chat_rowid FROM m WHERE chat IS NOT NULL")
def min_id_subquery(spark, d):
    return classified_orders(spark, d).select(F.col("ROWID").alias("o_orderkey"), "chat_rowid").where("chat_rowid is not null")


@query(f"{ORDER_CTES} SELECT grp AS is_group, count(*) AS n FROM m GROUP BY 1")
def group_flag(spark, d):
    return classified_orders(spark, d).groupBy("is_group").agg(F.count("*").alias("n"))


@query(f"{ORDER_CTES}, y AS (SELECT *, {WHO_SQL} AS who FROM x LEFT JOIN customer ON c_custkey = handle WHERE disposition = 'retained') SELECT {_hmac("('g' || k)", 'message')} AS message_id, {_hmac("CASE WHEN chat <> 0 THEN CAST(chat AS VARCHAR) ELSE 'unknown' END", 'chat')} AS chat_id, 1678307200000000000 AS timestamp_ns, CASE WHEN own THEN 'me' ELSE 'other' END AS sender_role, {_hmac("CASE WHEN own THEN 'me' ELSE who END", 'participant')} AS participant_id, att AS has_attachment, grp AS is_group, 'unknown' AS service FROM y")
def canonical_messages(spark, d):
    return extract.canonical(classified_orders(spark, d), KEY).drop("text")


# Tokens: words for what SQL must follow.

WORD_SQL = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"


def word_docs(spark, d, name="documents", key="doc_id"):
    return read(spark, d, name).select(key, F.filter(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"), lambda x: x != "").alias("ids"))


LENGTHS_SQL = f"w AS (SELECT doc_id, list_transform({WORD_SQL}, lambda x: length(x)) AS ids FROM documents)"


def length_docs(spark, d):
    return word_docs(spark, d).select("doc_id", F.transform("ids", lambda x: F.length(x).cast("long")).alias("ids"))


@query(f"WITH {LENGTHS_SQL} SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS sessions, sum(len(ids))::BIGINT AS tokens, (sum(list_sum(ids)) % 9223372036854775807)::BIGINT AS checksum FROM w GROUP BY 1")
def token_report(spark, d):
    return stats.token_report(length_docs(spark, d).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")), "split")


@query(f"WITH {LENGTHS_SQL} SELECT token, count(*) AS n FROM (SELECT unnest(ids) AS token FROM w) GROUP BY 1")
def token_frequencies(spark, d):
    return stats.frequencies(length_docs(spark, d).select(F.explode("ids").alias("token")))


WINDOW_SQL = f"WITH {LENGTHS_SQL}, p AS (SELECT unnest(ids) AS token, doc_id, generate_subscripts(ids, 1) AS i FROM w), q AS (SELECT token, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM p), z AS (SELECT pos // 65 AS window_no, list(token ORDER BY pos) AS ids FROM q GROUP BY 1 HAVING count(*) = 65)"


@query(f"{WINDOW_SQL} SELECT window_no, array_to_string(ids, ' ') AS ids FROM z")
def pack_windows(spark, d):
    w = stats.windows(stats.token_stream(length_docs(spark, d), "doc_id"), 64)
    return w.select("window_no", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(f"{WINDOW_SQL} SELECT window_no, array_to_string(ids[1:64], ' ') AS inputs, array_to_string(ids[2:65], ' ') AS targets FROM z")
def shift_targets(spark, d):
    w = stats.inputs_targets(stats.windows(stats.token_stream(length_docs(spark, d), "doc_id"), 64), 64)
    return w.select("window_no", *[F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in ("inputs", "targets")])


@query(f"WITH w AS (SELECT doc_id % 10 = 0 AS test, unnest({WORD_SQL}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM w WHERE NOT test GROUP BY 1), s AS (SELECT sum(n) AS n, count(*) AS v FROM c), l AS (SELECT avg(-ln((coalesce(c.n, 0) + 1) / (s.n + s.v))) AS loss, count(*) AS k FROM w LEFT JOIN c USING (token), s WHERE test) SELECT round(loss, 6) AS loss, k AS test_tokens, round(exp(least(loss, 50)), 3) AS perplexity FROM l")
def unigram_loss(spark, d):
    w = word_docs(spark, d).select((F.col("doc_id") % 10 == 0).alias("test"), F.explode("ids").alias("token"))
    out = stats.loss_of_counts(stats.split_counts(w, F.col("test")))
    return out.select(F.round("loss", 6).alias("loss"), "test_tokens", F.round("perplexity", 3).alias("perplexity"))


TURN_TOKENS_SQL = f"""w AS (SELECT conv_id, turn, list_concat(list_concat([CASE WHEN role = 'assistant' THEN '<|me|>' ELSE '<|other|>' END], {WORD_SQL}), ['<|turn_end|>', chr(10)]) AS ids FROM conversations),
p AS (SELECT conv_id, turn, generate_subscripts(ids, 1) AS i, unnest(ids) AS token FROM w),
q AS (SELECT *, CASE token WHEN '<|me|>' THEN 1 WHEN '<|other|>' THEN 0 WHEN '<|turn_end|>' THEN 0 END AS after FROM p),
r AS (SELECT *, CASE token WHEN '<|me|>' THEN true WHEN '<|other|>' THEN false ELSE coalesce(last_value(after IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) END AS mask FROM q)"""


def masked_tokens(spark, d):
    c = read(spark, d, "conversations")
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    ids = F.concat(F.array(F.when(F.col("role") == "assistant", "<|me|>").otherwise("<|other|>")), words, F.array(F.lit("<|turn_end|>"), F.lit("\n")))
    p = c.select("conv_id", "turn", F.posexplode(ids).alias("i", "token")).withColumn("pos", F.col("turn") * (1 << 32) + F.col("i"))
    return stats.role_mask(p, ["conv_id"], "pos", "token", "<|me|>", "<|other|>", "<|turn_end|>")


@query(f"WITH {TURN_TOKENS_SQL} SELECT conv_id, count(*) AS tokens, count(*) FILTER (WHERE mask) AS me_tokens FROM r GROUP BY 1")
def role_mask(spark, d):
    return masked_tokens(spark, d).groupBy("conv_id").agg(F.count("*").alias("tokens"), F.count_if("mask").alias("me_tokens"))


@query(f"WITH {TURN_TOKENS_SQL} SELECT round(avg(length(token)) FILTER (WHERE mask), 9) AS loss, count(*) FILTER (WHERE mask) AS tokens FROM r")
def me_turn_loss(spark, d):
    m = masked_tokens(spark, d).withColumn("loss", F.length("token").cast("double"))
    return stats.masked_mean(m, "loss").select(F.round("loss", 9).alias("loss"), "tokens")


def _gram_sql(n: int) -> str:
    g = f"list_transform(range(1, len(ids) - {n - 2}), lambda i: array_to_string(ids[i:i + {n - 1}], ' '))"
    return f"""WITH t AS (SELECT DISTINCT unnest({g}) AS g FROM (SELECT {WORD_SQL} AS ids FROM benchmark)), d AS (SELECT doc_id, {WORD_SQL} AS ids FROM documents), e AS (SELECT doc_id, unnest({g}) AS g FROM d), h AS (SELECT doc_id, count(*) AS matched FROM e WHERE g IN (SELECT g FROM t) GROUP BY 1)"""


def overlap(spark, d, n):
    return stats.ngram_overlap(word_docs(spark, d, "benchmark", "item_id"), word_docs(spark, d), "doc_id", n)


def _overlap(n: int) -> None:
    def f(spark, d):
        return overlap(spark, d, n)

    f.__name__ = f"ngram_overlap_{n}"
    query(f"{_gram_sql(n)} SELECT doc_id, greatest(len(ids) - {n - 1}, 0)::BIGINT AS possible, coalesce(matched, 0) AS matched FROM d LEFT JOIN h USING (doc_id)")(f)


_overlap(8)
_overlap(16)


@query(f"SELECT CASE WHEN EXISTS ({_gram_sql(16)} SELECT * FROM h) THEN 16 WHEN EXISTS ({_gram_sql(8)} SELECT * FROM h) THEN 8 ELSE 0 END AS longest_match")
def longest_match(spark, d):
    return stats.longest_match({n: overlap(spark, d, n) for n in (8, 16)})


LOGITS_SQL = "SELECT vec_id, (unnest(embedding)::DOUBLE * 10) AS score, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings"


def logits(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "x")).select("vec_id", "idx", (F.col("x").cast("double") * 10).alias("score"))


SOFTMAX_SQL = f"l AS ({LOGITS_SQL}), e AS (SELECT *, exp((score - max(score) OVER w) / 0.8::DOUBLE) AS e FROM l WINDOW w AS (PARTITION BY vec_id)), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"


@query(f"WITH {SOFTMAX_SQL} SELECT vec_id, idx::INTEGER AS idx, round(p, 9) AS p FROM p")
def softmax(spark, d):
    return stats.softmax(logits(spark, d), "vec_id", "score", 0.8).select("vec_id", "idx", F.round("p", 9).alias("p"))


@query(f"WITH {SOFTMAX_SQL}, c AS (SELECT *, sum(p) OVER w AS c, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY p DESC, idx ROWS UNBOUNDED PRECEDING)) SELECT vec_id, count(*) AS kept, min(idx)::INTEGER AS first_idx FROM c WHERE c - p < 0.9 OR r = 1 GROUP BY 1")
def top_p_filter(spark, d):
    return stats.top_p(stats.softmax(logits(spark, d), "vec_id", "score", 0.8), "vec_id", 0.9).groupBy("vec_id").agg(F.count("*").alias("kept"), F.min("idx").alias("first_idx"))


@query(f"WITH l AS ({LOGITS_SQL}) SELECT vec_id, idx::INTEGER AS idx, round(CASE WHEN idx % 3 = 0 THEN CASE WHEN score > 0 THEN score / 1.1::DOUBLE ELSE score * 1.1::DOUBLE END ELSE score END, 9) AS score FROM l")
def repetition_penalty(spark, d):
    return logits(spark, d).select("vec_id", "idx", F.round(stats.repetition_penalty(F.col("score"), F.col("idx") % 3 == 0, 1.1), 9).alias("score"))


MODELS = [(0, "model-1m", 4096, 128, 4, 384, True), (1, "model-7m", 4096, 256, 6, 768, True)]
MODEL_SQL = "c AS (SELECT *, vocab * hidden + layers * (4 * hidden * hidden + 3 * hidden * inter + 2 * hidden) + hidden AS parameters FROM (VALUES (0, 'model-1m', 4096, 128, 4, 384), (1, 'model-7m', 4096, 256, 6, 768)) t(place, name, vocab, hidden, layers, inter))"


@query(f"WITH {MODEL_SQL}, n AS (SELECT sum(len({WORD_SQL})) AS n FROM documents) SELECT coalesce((SELECT name FROM c, n WHERE n / parameters >= 10 ORDER BY parameters DESC LIMIT 1), 'model-1m') AS selected, (SELECT NOT bool_or(n / parameters >= 10) FROM c, n) AS memorization_prone, (SELECT n >= 1000000 FROM n) AS enough_tokens")
def model_selection(spark, d):
    n = word_docs(spark, d).agg(F.sum(F.size("ids"))).first()[0]
    models = spark.createDataFrame(MODELS, "place int, name string, vocab long, hidden long, layers long, intermediate long, tied boolean")
    return stats.select_model(models, n)


@query("SELECT range AS step, round(CASE WHEN range < 100 THEN 3e-4::DOUBLE * (range + 1) / 100 ELSE 3e-5::DOUBLE + (3e-4::DOUBLE - 3e-5::DOUBLE) * 0.5 * (1 + cos(pi() * least((range - 100) / 900.0::DOUBLE, 1))) END, 12) AS rate FROM range(1000)")
def lr_schedule(spark, d):
    return spark.range(1000).select(F.col("id").alias("step"), F.round(learning_rate(F.col("id"), 1000, 100, 3e-4, 3e-5), 12).alias("rate"))


@query("WITH m AS (SELECT o_orderkey AS step, round(o_totalprice, 2) AS loss FROM orders), b AS (SELECT *, min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM m), i AS (SELECT *, coalesce(loss < pb, true) AS improved FROM b), g AS (SELECT *, sum(improved::INT) OVER (ORDER BY step) AS g FROM i), s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY step) - 1 AS stale FROM g) SELECT step, least(loss, coalesce(pb, loss)) AS best, improved, stale::INTEGER AS stale FROM s WHERE step <= coalesce((SELECT min(step) FROM s WHERE stale >= 50), step)")
def early_stopping(spark, d):
    m = read(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.round("o_totalprice", 2).alias("loss"))
    return stats.early_stopping(m, 50).select("step", "best", "improved", "stale")


REPORTS = ("bool_and(disposition <> '') AS accounted", "count(*) FILTER (WHERE disposition = 'retained') / count(*) FILTER (WHERE disposition IN ('retained', 'excluded_unrecoverable_body')) >= 0.9 AS recovered")


@query(f"{ORDER_CTES}, r AS (SELECT {', '.join(REPORTS)} FROM x), o AS (SELECT count(*) > 0 AS filled FROM x WHERE disposition = 'retained'), gc AS (SELECT 'b' AS gate, unnest([accounted, recovered, filled]) AS ok FROM r, o UNION ALL SELECT 'd', unnest([true, false])) SELECT gate, count(*) AS checks, count(*) FILTER (WHERE NOT ok) AS failed, bool_and(ok) AS passed FROM gc GROUP BY 1")
def gate_audit(spark, d):
    """Gates over the accounting of the message adapter, and over two sets of files of which one is complete."""
    r = extract.accounting(classified_orders(spark, d))
    checks = F.array(*[F.struct(F.lit("b").alias("gate"), F.lit(n).alias("check"), c.alias("ok")) for n, c in (("accounted", F.col("all_rows_accounted_for")), ("recovered", F.col("body_recovery_rate") >= 0.9), ("filled", F.col("retained_rows") > 0))])
    files = spark.createDataFrame([("d", "whole", ["a", "b", "c"], ["b", "a"]), ("d", "part", ["a"], ["b", "a"])], "gate string, check string, present array<string>, required array<string>")
    both = r.select(F.explode(checks).alias("c")).select("c.*").unionByName(files.select("gate", "check", audit.subset(F.col("required"), F.col("present")).alias("ok")))
    return audit.gates(both)


@query(f"{SPLIT_CTES}, sp AS (SELECT split, count(*) AS sessions, min(start_ns)::BIGINT AS first_ns, max(end_ns)::BIGINT AS last_ns FROM x WHERE split <> 'guard' GROUP BY 1), sh AS (SELECT count(*) FILTER (WHERE n > 1) AS shared FROM (SELECT count(DISTINCT split) AS n FROM x WHERE split <> 'guard' GROUP BY content_hash)) SELECT (SELECT count(*) FROM v) AS input_sessions, (SELECT count(*) FROM v) - (SELECT count(*) FROM x) AS duplicates_removed, (SELECT count(*) FROM x WHERE split = 'guard') AS guarded_sessions, shared AS cross_split_duplicate_hashes, (SELECT string_agg(split || ':' || sessions || ':' || first_ns || ':' || last_ns, ',' ORDER BY split) FROM sp) AS splits FROM sh")
def split_full_report(spark, d):
    s = sessions.build_sessions(event_messages(spark, d))
    out = split.full_report(s, split.chrono_split(s, guard_ns=360 * MINUTE_NS))
    each = F.transform(F.map_entries("splits"), lambda e: F.concat_ws(":", e["key"], e["value"]["sessions"].cast("string"), e["value"]["first_ns"].cast("string"), e["value"]["last_ns"].cast("string")))
    return out.withColumn("splits", F.array_join(each, ","))


@query(f"WITH {LENGTHS_SQL}, c AS (SELECT token, count(*) AS n FROM (SELECT unnest(ids) AS token FROM w) GROUP BY 1) SELECT range AS token, coalesce(n, 0) AS n FROM range(64) LEFT JOIN c ON token = range")
def dense_frequencies(spark, d):
    return stats.dense_frequencies(length_docs(spark, d).select(F.explode("ids").alias("token")), 64)


@query(f"{WINDOW_SQL} SELECT window_no // 16 AS batch, string_agg(array_to_string(ids[1:64], ' '), '/' ORDER BY window_no) AS inputs, string_agg(array_to_string(ids[2:65], ' '), '/' ORDER BY window_no) AS targets FROM z GROUP BY 1")
def stacked_batches(spark, d):
    b = stats.batched(stats.windows(stats.token_stream(length_docs(spark, d), "doc_id"), 64), 16)
    return b.select("batch", *[F.array_join(F.transform(c, lambda w: F.array_join(F.transform(w, lambda x: x.cast("string")), " ")), "/").alias(c) for c in ("inputs", "targets")])


@query(f"{WINDOW_SQL} SELECT window_no AS key, array_to_string(ids[1:32], ' ') AS prompt FROM z WHERE window_no < 20")
def first_prompts(spark, d):
    """The feature is the first 20 windows."""
    p = scoring.prompts_of(stats.windows(stats.token_stream(length_docs(spark, d), "doc_id"), 64), 64, 20)
    return p.select("key", F.array_join(F.transform("prompt", lambda x: x.cast("string")), " ").alias("prompt"))


def epoch_order(spark, d):
    """Windows of the corpus in the order of an epoch: numpy's permutation, which SQL has not. Tests hold it against numpy."""
    w = stats.doc_windows(length_docs(spark, d), "doc_id", 64)
    return stats.gather(w, stats.epoch_batches(spark, w.count(), 32, 42, 1)).select("batch", "slot", "window_no")


query()(epoch_order)


@query("WITH m AS (SELECT conv_id AS k, count(*) AS rows, avg(length(text)) AS loss FROM conversations GROUP BY 1) SELECT round(sum(loss * rows) / sum(rows), 9) AS loss, sum(rows)::BIGINT AS rows FROM m")
def weighted_loss(spark, d):
    m = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("rows"), F.avg(F.length("text")).alias("loss"))
    return stats.weighted_mean(m).select(F.round("loss", 9).alias("loss"), "rows")


def _totals_sql(n: int) -> str:
    return f"SELECT {n} AS size, possible, matched FROM ({_gram_sql(n)} SELECT sum(greatest(len(ids) - {n - 1}, 0))::BIGINT AS possible, coalesce(sum(matched), 0)::BIGINT AS matched FROM d LEFT JOIN h USING (doc_id))"


@query(f"{_totals_sql(8)} UNION ALL {_totals_sql(16)}")
def memorization_totals(spark, d):
    return stats.overlap_totals({n: overlap(spark, d, n) for n in (8, 16)})


@query(f"WITH {LENGTHS_SQL}, p AS (SELECT doc_id, unnest(ids) AS token, generate_subscripts(ids, 1) AS i FROM w), q AS (SELECT token, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM p), g AS (SELECT pos, list(token) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM q) SELECT count(DISTINCT g) AS known FROM g WHERE len(g) = 8 AND pos < 10000")
def first_grams(spark, d):
    """The feature is the first positions of the stream, here 10,000 of them."""
    rows = stats.gram_rows(stats.token_stream(length_docs(spark, d), "doc_id"), 8)
    return stats.known_grams(rows, 8, first=10_000).agg(F.count("*").alias("known"))


@query("SELECT conv_id, turn, CASE WHEN starts_with(text, before) THEN substr(text, length(before) + 1) ELSE text END AS delta FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN left(text, 4) ELSE lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS before FROM conversations)")
def text_deltas(spark, d):
    before = F.when(F.col("turn") % 3 == 0, F.left("text", F.lit(4))).otherwise(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return read(spark, d, "conversations").withColumn("before", before).select("conv_id", "turn", delta(F.col("before"), F.col("text")).alias("delta"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def scan_order(spark, d):
    """The places of rows in a scan by date and row id."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"))
    return global_rank(o, "date", "o_orderkey", name="place").select("o_orderkey", "place")


def weighted_draws(spark, d):
    """A draw for each row by its probabilities; the numbers come from a hash that SQL has not. Tests hold the shares against the probabilities."""
    return stats.weighted_draw(stats.top_p(stats.softmax(logits(spark, d), "vec_id", "score", 0.8), "vec_id", 0.9), "vec_id", 42)


query()(weighted_draws)


def byte_token_counts(spark, d):
    """Sessions of the conversations as byte-level BPE ids, counted by split: no SQL has that encoding. A test holds it against the library."""
    import public_tokenizers

    s = sessions.build_sessions(chat_messages(spark, d)).withColumn("split", F.when(F.crc32(F.col("session_id").cast("binary")) % 10 == 0, "test").otherwise("train"))
    return stats.token_report(encode_splits(s, public_tokenizers.path("byte_bpe_50k.json")), "split")


query()(byte_token_counts)
