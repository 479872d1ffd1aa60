"""Aggregate checks: privacy of canonical messages, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import hash_shaped
from ..functions.text import has_pii
from ..schema import MESSAGE_KEYS


def privacy_audit(messages: DataFrame) -> DataFrame:
    """One row of counts and `passed`; no text. A missing column counts as an empty value; other columns than the canonical ones fail every row."""
    def get(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in messages.columns else F.lit("")

    odd = sorted(messages.columns) != MESSAGE_KEYS
    out = messages.agg(
        F.count("*").alias("records"),
        F.count_if(F.lit(odd)).alias("unexpected_schema_records"),
        F.count_if(~hash_shaped(get("message_id"), get("chat_id"), get("participant_id"))).alias("invalid_hashed_identifier_records"),
        F.count_if(~get("sender_role").isin("me", "other")).alias("invalid_role_records"),
        F.count_if(has_pii(get("text"))).alias("obvious_pii_records"),
    )
    bad = [c for c in out.columns if c != "records"]
    passed = F.col("records") > 0
    for c in bad:
        passed = passed & (F.col(c) == 0)
    return out.withColumn("passed", passed)


def privacy_audit_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same over raw JSON lines, whose keys may differ from line to line."""
    keys = F.array_sort(F.json_object_keys(column))
    x = F.from_json(column, "message_id string, chat_id string, participant_id string, sender_role string, text string")
    m = lines.select(keys.alias("keys"), x.alias("x"))
    out = m.agg(
        F.count("*").alias("records"),
        F.count_if(~F.col("keys").eqNullSafe(F.array(*map(F.lit, MESSAGE_KEYS)))).alias("unexpected_schema_records"),
        F.count_if(~hash_shaped(F.col("x.message_id"), F.col("x.chat_id"), F.col("x.participant_id"))).alias("invalid_hashed_identifier_records"),
        F.count_if(~F.coalesce(F.col("x.sender_role").isin("me", "other"), F.lit(False))).alias("invalid_role_records"),
        F.count_if(F.coalesce(has_pii(F.col("x.text")), F.lit(False))).alias("obvious_pii_records"),
    )
    return out.withColumn("passed", F.expr("records > 0 and unexpected_schema_records + invalid_hashed_identifier_records + invalid_role_records + obvious_pii_records = 0"))


def gates(checks: DataFrame) -> DataFrame:
    """checks: (gate, check, ok). One row a gate; a null check fails."""
    ok = F.coalesce("ok", F.lit(False))
    return checks.groupBy("gate").agg(F.count("*").alias("checks"), F.count_if(~ok).alias("failed"), F.bool_and(ok).alias("passed"))


def training_gate(config_name: str, selection: dict | None) -> None:
    """Refuses a training run that the corpus statistics do not allow; the smoke configuration always may run."""
    if config_name == "smoke":
        return
    if selection is None:
        raise ValueError("run corpus-stats first: the model's size follows from the token count")
    if not selection.get("enough_tokens_to_train"):
        raise ValueError("the train split has fewer than a million tokens")
    if selection.get("selected") != config_name:
        raise ValueError(f"the corpus asks for {selection.get('selected')!r}, not {config_name!r}")


def completion_checks(r: dict) -> list[tuple[str, str, bool | None]]:
    """(gate, check, ok) from the reports of a run: snapshot, extraction, sessions, split, privacy, tokenizer, selection, training, best, evaluation, manifest, model, files
    (names in the export), facts (measured by the caller). What a report lacks fails."""
    get = lambda name, *path: _dig(r.get(name), *path)
    above = lambda x, low: x is not None and x > low
    counts = get("split", "splits") or {}
    facts = r.get("facts", {})
    a = {"source_readable": facts.get("source_readable"), "snapshot_check": get("snapshot", "quick_check") == "ok", "snapshot_hash": get("snapshot", "snapshot_sha256") is not None and facts.get("snapshot_sha256") == get("snapshot", "snapshot_sha256"), "source_read_only": get("snapshot", "source_open_mode") == "read-only"}
    b = {"rows_accounted_for": get("extraction", "all_rows_accounted_for"), "body_recovery": above(get("extraction", "body_recovery_rate"), 0.9 - 1e-12), "privacy_audit": get("privacy", "passed"), "sessions": above(get("sessions", "sessions"), 0)}
    b |= {"splits_filled": {"train", "validation", "test"} <= set(counts), "no_shared_hashes": get("split", "cross_split_duplicate_hashes") == 0, "vocabularies_match": get("model", "vocab_size") is not None and get("model", "vocab_size") == get("tokenizer", "vocab_size")}
    c = {"model_by_token_count": get("selection", "selected") is not None and get("selection", "selected") == facts.get("config_name"), "random_start": get("training", "initialized_from_checkpoint") is False, "no_pretrained_weights": get("training", "pretrained_weights_used") is False}
    c |= {"training_completed": above(get("training", "global_step"), 0) and (get("training", "early_stopped") is True or get("training", "epoch") == facts.get("epochs")), "checkpoints": facts.get("checkpoints"), "tests": facts.get("tests_passed")}
    d = {"evaluation": above(get("evaluation", "test_tokens"), 0), "beats_unigram": get("evaluation", "beats_unigram_baseline"), "memorization_probe": above(get("evaluation", "memorization", "generation_samples"), 0), "export_complete": facts.get("export_complete")}
    d |= {"model_hash": get("manifest", "model_sha256") is not None and facts.get("model_sha256") == get("manifest", "model_sha256"), "chat_replies": facts.get("chat_ok"), "chat_without_identifiers": facts.get("chat_clean"), "readme": facts.get("readme"), "nothing_private_tracked": facts.get("nothing_tracked"), "private_modes": facts.get("private_modes")}
    return [(g, k, v) for g, checks in (("a", a), ("b", b), ("c", c), ("d", d)) for k, v in checks.items()]


def _dig(x, *path):
    for k in path:
        x = x.get(k) if isinstance(x, dict) else None
    return x


def completion(spark: SparkSession, reports: dict) -> DataFrame:
    """gates() of a run's reports."""
    return gates(spark.createDataFrame(completion_checks(reports), "gate string, check string, ok boolean"))


def subset(required: Column, present: Column) -> Column:
    """Whether an array holds all of another's entries."""
    return F.size(F.array_except(required, present)) == 0
