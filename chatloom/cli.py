"""python -m chatloom.cli COMMAND: the stages from an archive to a model, one command each. A command prints one JSON report; 1 is the exit code of a failed audit, 2 of a wrong call."""

from __future__ import annotations

import argparse
import json
import platform
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import tokens
from .model import artifacts, generate, scoring
from .model import train as training
from .operators import audit, extract, sessions, split, stats
from .schema import DAY_NS, MESSAGES, SESSIONS
from .sources import files, sqlite

SPLITS = ("train", "validation", "test")
#: Options that are paths: made absolute, as Spark's own working folder may be another.
PATHS = ("config", "database", "output", "messages", "splits", "tokenizer", "data", "selection", "checkpoint", "metrics", "split_report", "model", "run", "resume_from", "vocabulary")


def session() -> SparkSession:
    s = SparkSession.builder.appName("chatloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def load(path: str | Path) -> dict | None:
    return json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else None


def _ok(command: list[str], text: str | None = None) -> tuple[bool, str]:
    done = subprocess.run(command, input=text, text=True, capture_output=True, check=False, timeout=600)
    return done.returncode == 0, done.stdout


def doctor(a) -> dict:
    config = artifacts.load_config(a.config)
    source, folders = Path(config["source_db"]).expanduser(), {n: files.private_dir(config.get(f"{n}_dir", d)) for n, d in (("work", "work"), ("output", "outputs"))}
    readable, error = sqlite.can_open(source)
    ignored = {n: _ok(["git", "check-ignore", "-q", str(d / "private")])[0] for n, d in folders.items()}
    return {"architecture": platform.machine(), "python_version": platform.python_version(), "java_found": shutil.which("java") is not None, "source_database_exists": source.exists(), "source_database_readable_read_only": readable, "source_access_error": error, "free_disk_bytes": shutil.disk_usage(".").free, "private_files_ignored": ignored, "private_directory_permissions": {n: oct(d.stat().st_mode & 0o777) for n, d in folders.items()}, "safe_to_snapshot_real_data": readable}


def snapshot(a) -> dict:
    config = artifacts.load_config(a.config)
    return files.snapshot(Path(config["source_db"]).expanduser(), config["snapshot_db"])


def inspect_schema(a) -> dict:
    found = sqlite.catalog(a.database)
    files.private_dir(Path(a.output).parent)
    files.write_json(a.output, found)
    return {"table_count": len(found["tables"]), "missing_expected_tables": found["missing_expected_tables"], "output": str(a.output)}


def prepare(a) -> dict:
    config, spark = artifacts.load_config(a.config), session()
    work, database = files.private_dir(Path(config.get("work_dir", "work")).resolve()), a.database or str(Path(config["snapshot_db"]).resolve())
    for d in ("schema", "extracted", "processed", "reports", "splits"):
        files.private_dir(work / d)
    files.write_json(work / "schema/schema.json", sqlite.catalog(database))
    on = config.get("redaction", {})
    rows = extract.classify(sqlite.read_tables(spark, database), urls=on.get("urls", True), emails=on.get("emails", True), phones=on.get("phone_numbers", True), marker=bool(config.get("include_attachment_marker", True)))
    report = extract.accounting(rows)
    extract.check_accounting(report, float(config.get("minimum_body_recovery_rate", 0.9)))
    out = {"extraction": report.first().asDict()}
    files.write_json(work / "reports/extraction.json", out["extraction"])
    messages = extract.canonical(rows, files.load_or_create_key(work / "private/pseudonym-key"))
    files.write_jsonl(messages, str(work / "extracted/messages.jsonl"), private=True)
    messages = files.read_jsonl(spark, str(work / "extracted/messages.jsonl"), MESSAGES)
    gaps = int(config.get("session_gap_minutes", 360)), int(config.get("merge_gap_minutes", 2))
    files.write_jsonl(sessions.in_order(sessions.build_sessions(messages, *gaps)), str(work / "processed/sessions.jsonl"), private=True)
    out["sessions"] = sessions.session_report(messages, *gaps).first().asDict()
    files.write_json(work / "reports/sessions.json", out["sessions"])
    built, parts = files.read_jsonl(spark, str(work / "processed/sessions.jsonl"), SESSIONS), config.get("split", {})
    dealt = split.chrono_split(built, tuple(float(parts.get(n, d)) for n, d in zip(SPLITS, (0.9, 0.05, 0.05), strict=True)), int(parts.get("guard_days", 7)) * DAY_NS)
    split.check_split(dealt)
    for n in SPLITS:
        files.write_jsonl(sessions.in_order(dealt.where(F.col("split") == n).drop("split")), str(work / f"splits/{n}.jsonl"), private=True)
    out["split"] = split.full_report(built, dealt).first().asDict(recursive=True)
    files.write_json(work / "reports/split-report.json", out["split"])
    return out


def tokenizer(a) -> dict:
    tokens.save(a.vocabulary, a.output)
    report = tokens.training_report(a.output)
    files.write_json(Path(a.output) / "training-report.json", report)
    return report


def privacy_audit(a) -> dict:
    report = audit.privacy_audit_json(session().read.text(str(a.messages))).first().asDict()
    files.private_dir(Path(a.output).parent)
    files.write_json(a.output, report)
    return report


def corpus_stats(a) -> dict:
    spark, report = session(), {}
    for n in SPLITS:
        s = files.read_jsonl(spark, f"{a.splits}/{n}.jsonl", SESSIONS).withColumn("split", F.lit(n))
        ids = tokens.encode_splits(s, a.tokenizer).withColumn("key", F.struct("end_ns", "session_id"))
        r = stats.token_report(ids, "split").first()
        artifacts.save_tokens(stats.token_stream(ids, "key"), f"{a.output}/{n}.npy")
        report[n] = {"sessions": r.sessions if r else 0, "tokens": r.tokens if r else 0, "checksum": r.checksum if r else 0, "dtype": "uint32"}
    files.write_json(f"{a.output}/token-counts.json", report)
    vocab, models = tokens.vocab_size(a.tokenizer), [artifacts.load_config(c) for c in a.models]
    rows = [(i, m["name"], vocab, m["hidden_size"], m["num_layers"], m["intermediate_size"], bool(m.get("tie_embeddings", True))) for i, m in enumerate(models)]
    table = spark.createDataFrame(rows, "place int, name string, vocab long, hidden long, layers long, intermediate long, tied boolean")
    chosen = stats.select_model(table, report["train"]["tokens"]).first()
    selection = {"train_tokens": report["train"]["tokens"], "vocab_size": vocab, "minimum_tokens_per_parameter": 10, "selected": chosen.selected, "memorization_prone_experiment": chosen.memorization_prone, "enough_tokens_to_train": chosen.enough_tokens}
    files.private_dir(Path(a.selection).parent)
    files.write_json(a.selection, selection)
    return {"tokens": report, "selection": selection}


def stream(spark: SparkSession, path: str | Path):
    """(pos, token) of a token file, read by the executors in blocks; the file must be where they can open it."""
    n, size = len(artifacts.load_tokens(path)), 1 << 20
    blocks = spark.range(-(-n // size))

    def read(batches):
        import pandas as pd

        ids = artifacts.load_tokens(path)
        for b in batches:
            for k in b["id"]:
                part = ids[k * size : (k + 1) * size]
                yield pd.DataFrame({"pos": range(k * size, k * size + len(part)), "token": part.astype("int64")})

    return blocks.mapInPandas(read, "pos long, token long")


def train(a) -> dict:
    config = artifacts.load_config(a.config)
    audit.training_gate(config.get("name", ""), load(a.selection))
    spark, context = session(), int(config["max_sequence_length"])
    windows = {n: stats.windows(stream(spark, f"{a.data}/{n}.npy"), context) for n in ("train", "validation")}
    return training.train(config, windows["train"], windows["validation"], tokens.vocab_size(a.tokenizer), artifacts.tokenizer_file(a.tokenizer), a.output, a.resume_from)


def evaluate(a) -> dict:
    spark, (shape, p), path = session(), artifacts.load_model(a.checkpoint), Path(a.checkpoint) / "tokenizer"
    report = scoring.evaluate({n: stream(spark, f"{a.data}/{n}.npy") for n in SPLITS}, shape, p, path, tokens.control_ids(path))
    files.private_dir(Path(a.output).parent)
    files.write_json(a.output, report)
    return report


def export(a) -> dict:
    return artifacts.export(a.checkpoint, a.output, a.metrics, a.split_report, a.splits)


def prompt_of(history: list[tuple[str, str]], message: str) -> str:
    """functions.text.reply_prompt, for one conversation on the driver."""
    lines = ["<|bos|><|conversation|>", *(f"{'<|me|>' if r == 'me' else '<|other|>'}{t}<|turn_end|>" for r, t in history), f"<|other|>{message}<|turn_end|>", "<|me|>"]
    return "\n".join(lines)


def chat(a) -> None:
    (shape, p), tokenizer, history = artifacts.load_model(a.model), tokens.load(Path(a.model) / "tokenizer"), []
    how = generate.Sampling(a.max_new_tokens, a.temperature, a.top_p, a.repetition_penalty, a.seed)
    print("Replies are suggestions; nothing is sent. /quit ends.")
    while True:
        try:
            message = input("other: ")
        except (EOFError, KeyboardInterrupt):
            return
        if message.strip() == "/quit":
            return
        parts = []
        print("me: ", end="")
        for part in generate.stream_reply(shape, p, tokenizer, prompt_of(history, message), how):
            parts.append(part)
            print(part, end="", flush=True)
        print()
        history += [("other", message), ("me", "".join(parts))]


def completion(a) -> dict:
    root, run, final = Path.cwd(), Path(a.run), Path(a.model)
    work, config = root / "work", artifacts.load_config(run / "best/training-config.yaml") if (run / "best").exists() else {}
    talk = _ok([sys.executable, "-m", "chatloom.cli", "chat", "--model", str(final), "--max-new-tokens", "16"], "Hello there.\n/quit\n")
    tracked = _ok(["git", "ls-files", "work", "outputs"])
    modes = [(f.stat().st_mode & 0o777) == (0o700 if f.is_dir() else 0o600) for d in (work, root / "outputs") if d.exists() for f in (d, *d.rglob("*"))]
    spark = session()
    clean = not spark.createDataFrame([(talk[1],)], "t string").select(audit.has_pii(F.col("t"))).first()[0]
    hashed = lambda f: files.sha256_file(f) if f.exists() else None
    facts = {"source_readable": sqlite.can_open(a.database)[0], "snapshot_sha256": hashed(Path(a.database)), "config_name": config.get("name"), "epochs": config.get("epochs"), "checkpoints": all((run / n / "training-config.yaml").is_file() for n in ("best", "last")), "tests_passed": _ok([sys.executable, "-m", "pytest", "-q", *a.tests])[0] if a.tests else None, "export_complete": final.exists() and artifacts.complete({f.name for f in final.iterdir()}), "model_sha256": hashed(final / "model.npz"), "chat_ok": talk[0], "chat_clean": talk[0] and clean, "readme": (root / "README.md").is_file(), "nothing_tracked": tracked[0] and not tracked[1].strip(), "private_modes": bool(modes) and all(modes)}
    reports = {n: load(work / f) for n, f in (("snapshot", "snapshot/manifest.json"), ("extraction", "reports/extraction.json"), ("sessions", "reports/sessions.json"), ("split", "reports/split-report.json"), ("privacy", "reports/privacy-audit.json"), ("selection", "reports/model-selection.json"))}
    reports |= {"tokenizer": load("outputs/tokenizer/training-report.json"), "training": load(run / "training-summary.json"), "evaluation": load("outputs/evaluation.json"), "manifest": load(final / "data-manifest.json"), "model": load(final / "model-config.json"), "facts": facts}
    gates = {r.gate: r.passed for r in audit.completion(spark, reports).collect()}
    checks = {f"gate_{g}": {k: bool(ok) for h, k, ok in audit.completion_checks(reports) if h == g} for g in "abcd"}
    report = {"ready": all(gates.values()), **checks}
    files.private_dir(Path(a.output).parent)
    files.write_json(a.output, report)
    return report


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chatloom")
    sub = top.add_subparsers(required=True)

    def add(name: str, run, *options: tuple, passed: str | None = None) -> None:
        c = sub.add_parser(name)
        c.set_defaults(command=run, passed=passed)
        for option, default, *kind in options:
            c.add_argument(f"--{option}", default=default, required=default is ..., type=kind[0] if kind else None, nargs="*" if isinstance(default, list) else None)

    config, data, tok = ("config", "configs/data.yaml"), ("data", "work/tokens"), ("tokenizer", "outputs/tokenizer")
    add("doctor", doctor, config)
    add("snapshot", snapshot, config)
    add("inspect-schema", inspect_schema, ("database", "work/snapshot/chat.db"), ("output", "work/schema/schema.json"))
    add("prepare", prepare, config, ("database", None))
    add("tokenizer", tokenizer, ("vocabulary", ...), ("output", "outputs/tokenizer"))
    add("privacy-audit", privacy_audit, ("messages", "work/extracted/messages.jsonl"), ("output", "work/reports/privacy-audit.json"), passed="passed")
    add("corpus-stats", corpus_stats, ("splits", "work/splits"), tok, ("output", "work/tokens"), ("models", ["configs/model-1m.yaml", "configs/model-7m.yaml"]), ("selection", "work/reports/model-selection.json"))
    add("train", train, ("config", ...), data, tok, ("output", "outputs/runs/model-v1"), ("resume-from", None), ("selection", "work/reports/model-selection.json"))
    add("evaluate", evaluate, ("checkpoint", ...), data, ("output", "outputs/evaluation.json"))
    add("export", export, ("checkpoint", ...), ("output", "outputs/final"), ("metrics", "outputs/evaluation.json"), ("split-report", "work/reports/split-report.json"), ("splits", "work/splits"))
    add("chat", chat, ("model", "outputs/final"), ("max-new-tokens", 64, int), ("temperature", 0.8, float), ("top-p", 0.9, float), ("repetition-penalty", 1.1, float), ("seed", 42, int))
    add("audit", completion, ("run", "outputs/runs/model-v1"), ("model", "outputs/final"), ("database", "work/snapshot/chat.db"), ("output", "work/reports/completion-audit.json"), ("tests", []), passed="ready")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    for k in PATHS:
        if getattr(a, k, None):
            setattr(a, k, str(Path(getattr(a, k)).expanduser().resolve()))
    try:
        report = a.command(a)
    except ValueError as e:
        print(f"chatloom: {e}", file=sys.stderr)
        return 2
    if report is not None:
        print(json.dumps(report, indent=2, sort_keys=True, default=str))
    return int(a.passed is not None and not report[a.passed])


if __name__ == "__main__":
    sys.exit(main())
