"""Sessions and turns of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ids import session_id
from ..functions.text import turn_line
from ..schema import BOS, CONVERSATION, EOS, MERGE_GAP_MINUTES, MINUTE_NS, SESSION_GAP_MINUTES


def sessionize(messages: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, merge_minutes: int = MERGE_GAP_MINUTES, order: tuple[str, ...] = ("timestamp_ns", "message_id")) -> DataFrame:
    """Adds session_no and turn_no, from 1 in each chat. A session ends at a gap above gap_minutes; a turn goes on with the same participant
    within merge_minutes of the message before, so merging chains. One shuffle and one sort serve all windows."""
    o = W.partitionBy("chat_id").orderBy(*order)
    running = o.rowsBetween(W.unboundedPreceding, 0)
    m = messages.withColumn("_dt", F.col("timestamp_ns") - F.lag("timestamp_ns").over(o)).withColumn("_p", F.lag("participant_id").over(o))
    m = m.withColumn("_s", F.coalesce(F.col("_dt") > gap_minutes * MINUTE_NS, F.lit(True)))
    m = m.withColumn("_t", F.col("_s") | ~F.col("participant_id").eqNullSafe(F.col("_p")) | (F.col("_dt") > merge_minutes * MINUTE_NS))
    return m.select("*", F.sum(F.col("_s").cast("long")).over(running).alias("session_no"), F.sum(F.col("_t").cast("long")).over(running).alias("turn_no")).drop("_dt", "_p", "_s", "_t")


def turns(sessionized: DataFrame, order: tuple[str, ...] = ("timestamp_ns", "message_id")) -> DataFrame:
    """One row a turn; its text joins its messages by newlines."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "\n")
    return sessionized.groupBy("chat_id", "session_no", "turn_no").agg(F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns"), F.first("sender_role").alias("sender_role"), F.count("*").alias("n_messages"), F.bool_or("is_group").alias("is_group"), body.alias("text"))


def all_sessions(turned: DataFrame) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn_no", turn_line(F.col("sender_role"), F.col("text")).alias("line")))), lambda x: x["line"])
    text = F.array_join(F.concat(F.array(F.lit(BOS + CONVERSATION)), lines, F.array(F.lit(EOS))), "\n")
    return turned.groupBy("chat_id", "session_no").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("turn_count"), F.bool_or("is_group").alias("is_group"), text.alias("text"))


def build_sessions(messages: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, merge_minutes: int = MERGE_GAP_MINUTES) -> DataFrame:
    """Serialized sessions of at least two turns."""
    s = all_sessions(turns(sessionize(messages, gap_minutes, merge_minutes))).where("turn_count >= 2")
    return s.select(session_id(F.col("chat_id"), F.col("start_ns"), F.col("end_ns"), F.col("text")).alias("session_id"), "start_ns", "end_ns", "turn_count", "is_group", "text")


def session_report(messages: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, merge_minutes: int = MERGE_GAP_MINUTES) -> DataFrame:
    s = sessionize(messages, gap_minutes, merge_minutes).groupBy("chat_id", "session_no").agg(F.count("*").alias("n"), F.countDistinct("turn_no").alias("t"))
    return s.agg(F.sum("n").alias("input_messages"), F.countDistinct("chat_id").alias("chats"), F.count_if(F.col("t") >= 2).alias("sessions"), F.count_if(F.col("t") < 2).alias("discarded"))


def in_order(sessions: DataFrame) -> DataFrame:
    """Sessions as files hold them, by end and id."""
    return sessions.orderBy("end_ns", "session_id")
