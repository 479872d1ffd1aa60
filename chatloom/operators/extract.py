"""From message tables to canonical messages, every row accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import decode_bodies
from ..functions.ids import pseudonym
from ..functions.scalars import epoch2001_to_unix_ns
from ..functions.text import normalize, redact
from ..schema import ATTACHMENT, RECOVERY_FLOOR

COLUMNS = {"ROWID": "long", "guid": "string", "text": "string", "attributedBody": "binary", "is_from_me": "long", "handle_id": "long", "date": "long", "service": "string", "item_type": "long", "associated_message_type": "long", "is_deleted": "long", "date_retracted": "long"}


def padded(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns, null where the source has none of the name."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, name): the value, or the key itself where that is empty."""
    return df.select(F.col(key).alias("_k"), F.coalesce(F.when(F.col(value) != "", F.col(value).cast("string")), F.col(key).cast("string")).alias("_name"))


def lowest_chat(join: DataFrame) -> DataFrame:
    return join.groupBy(F.col("message_id").alias("ROWID")).agg(F.min("chat_id").alias("chat_rowid"))


def attached(join: DataFrame) -> DataFrame:
    return join.select(F.col("message_id").alias("ROWID")).distinct().withColumn("has_attachment", F.lit(True))


def members(join: DataFrame) -> DataFrame:
    return join.groupBy(F.col("chat_id").alias("chat_rowid")).agg(F.count("*").alias("members"))


def truthy(c: str) -> Column:
    return F.coalesce(F.col(c) != 0, F.lit(False))


def disposition(text: Column, clean: Column) -> Column:
    """Why a row is left out, or retained; the first reason counts."""
    return (
        F.when(truthy("is_deleted") | truthy("date_retracted"), "excluded_deleted")
        .when(truthy("associated_message_type"), "excluded_reaction")
        .when(truthy("item_type"), "excluded_system_event")
        .when((F.coalesce(text, F.lit("")) == "") & F.col("has_attachment"), "excluded_attachment_only")
        .when(F.coalesce(text, F.lit("")) == "", "excluded_unrecoverable_body")
        .when(clean == "", "excluded_empty_after_normalization")
        .otherwise("retained")
    )


def classify(tables: dict[str, DataFrame], urls: bool = True, emails: bool = True, phones: bool = True, marker: bool = True, redaction: bool = True) -> DataFrame:
    """All message rows with disposition, body_source, clean text and joined chat, handle and member count. Bodies are decoded only where there is no
    text. Small lookup tables are joined as the planner sees fit."""
    if "message" not in tables:
        raise ValueError("there is no message table")
    m = padded(tables["message"], COLUMNS)
    has_text = F.coalesce(F.col("text").rlike(r"[^\s\x1C-\x1F\x85\xA0]"), F.lit(False))
    m = m.withColumn("body_source", F.when(has_text, "text").otherwise("attributed_body")).withColumn("body", F.coalesce(F.when(has_text, F.col("text")), decode_bodies(F.when(~has_text, F.col("attributedBody")))))
    clean = normalize(F.col("body"))
    m = m.withColumn("clean", redact(clean, urls, emails, phones) if redaction else clean)
    empty = m.sparkSession.createDataFrame([], "message_id long, chat_id long, handle_id long")
    m = m.join(lowest_chat(tables.get("chat_message_join", empty)), "ROWID", "left")
    m = m.join(attached(tables.get("message_attachment_join", empty)), "ROWID", "left").withColumn("has_attachment", F.coalesce("has_attachment", F.lit(False)))
    m = m.join(members(tables.get("chat_handle_join", empty)), "chat_rowid", "left").withColumn("is_group", F.coalesce(F.col("members") > 1, F.lit(False)))
    for name, key, value, out in (("handle", "handle_id", "id", "handle_name"), ("chat", "chat_rowid", "chat_identifier", "chat_name")):
        if name in tables:
            found = lookup(padded(tables[name], {"ROWID": "long", value: "string"}), "ROWID", value)
            m = m.join(found, F.col(key) == F.col("_k"), "left").withColumnRenamed("_name", out).drop("_k")
        else:
            m = m.withColumn(out, F.lit(None).cast("string"))
        known = F.when(F.coalesce(F.col(key), F.lit(0)) != 0, F.col(key).cast("string")).otherwise(F.lit("unknown"))
        m = m.withColumn(out, F.coalesce(out, known))
    m = m.withColumn("disposition", disposition(F.col("body"), F.col("clean")))
    return m.withColumn("clean", F.when(F.col("has_attachment"), F.concat("clean", F.lit("\n" + ATTACHMENT))).otherwise(F.col("clean"))) if marker else m


def canonical(classified: DataFrame, key: bytes) -> DataFrame:
    """The retained rows as canonical messages."""
    own = truthy("is_from_me")
    person = F.when(own, "me").otherwise(F.col("handle_name"))
    identity = F.coalesce(F.when(F.col("guid") != "", F.col("guid")), F.col("ROWID").cast("string"))
    return classified.where("disposition = 'retained'").select(
        pseudonym(identity, key, "message").alias("message_id"),
        pseudonym(F.col("chat_name"), key, "chat").alias("chat_id"),
        epoch2001_to_unix_ns(F.col("date")).alias("timestamp_ns"),
        F.when(own, "me").otherwise("other").alias("sender_role"),
        pseudonym(person, key, "participant").alias("participant_id"),
        F.col("clean").alias("text"),
        "has_attachment",
        "is_group",
        F.coalesce(F.when(F.col("service") != "", F.col("service")), F.lit("unknown")).alias("service"),
    )


def accounting(classified: DataFrame) -> DataFrame:
    """One row of counts: all rows, each disposition, and of the retained ones direction, body source and kind of chat; accounted and recovery_rate."""
    kept = F.col("disposition") == "retained"
    names = ("deleted", "reaction", "system_event", "attachment_only", "unrecoverable_body", "empty_after_normalization")
    counts = [F.count("*").alias("total_rows"), F.count_if(kept).alias("retained_rows")]
    counts += [F.count_if(F.col("disposition") == f"excluded_{n}").alias(f"excluded_{n}") for n in names]
    counts += [F.count_if(kept & c).alias(n) for n, c in (("outgoing_rows", truthy("is_from_me")), ("incoming_rows", ~truthy("is_from_me")), ("recovered_text", F.col("body_source") == "text"), ("recovered_attributed_body", F.col("body_source") != "text"), ("group_rows", F.col("is_group")), ("one_to_one_rows", ~F.col("is_group")))]
    out = classified.agg(*counts)
    accounted = F.col("retained_rows")
    for n in names:
        accounted = accounted + F.col(f"excluded_{n}")
    eligible = F.col("retained_rows") + F.col("excluded_unrecoverable_body")
    return out.select("*", (accounted == F.col("total_rows")).alias("all_rows_accounted_for"), F.coalesce(F.try_divide("retained_rows", eligible), F.lit(0.0)).alias("body_recovery_rate"))


def check_accounting(report: DataFrame, floor: float = RECOVERY_FLOOR) -> None:
    r = report.first()
    if not r["all_rows_accounted_for"]:
        raise RuntimeError(f"rows unaccounted for: {r.asDict()}")
    if r["retained_rows"] + r["excluded_unrecoverable_body"] and r["body_recovery_rate"] < floor:
        raise RuntimeError(f"body recovery rate {r['body_recovery_rate']:.1%} is below {floor:.1%}")


def scan_order(messages: DataFrame) -> DataFrame:
    """Messages in the order of an archive's scan, by date and then row id, nulls first as SQLite has them. A range sort: for output files."""
    return messages.orderBy(F.col("date").asc_nulls_first(), "ROWID")
