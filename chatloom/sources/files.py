"""Files of the driver: private folders, keys, JSON documents, JSON lines, snapshots, hashes."""

from __future__ import annotations

import hashlib
import json
import os
import secrets
import sqlite3
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqlite import open_readonly


def private_dir(path: str | Path) -> Path:
    """Makes the folder; every level that it makes is 0700."""
    p = Path(path)
    made = [x for x in (p, *p.parents) if not x.exists()]
    p.mkdir(parents=True, exist_ok=True)
    for x in made:
        x.chmod(0o700)
    return p


def write_text(path: str | Path, text: str) -> Path:
    """Writes a 0600 file as a whole or not at all."""
    p = Path(path)
    private_dir(p.parent)
    fd, tmp = tempfile.mkstemp(dir=p.parent)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, p)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise
    return p


def write_json(path: str | Path, value: object) -> Path:
    return write_text(path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def load_or_create_key(path: str | Path) -> bytes:
    """32 random bytes, kept in a 0600 file; a shorter key is refused."""
    p = Path(path)
    private_dir(p.parent)
    try:
        fd = os.open(p, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    except FileExistsError:
        key = p.read_bytes()
        if len(key) < 32:
            raise ValueError(f"the key in {p} is too short") from None
        return key
    with os.fdopen(fd, "wb") as f:
        f.write(key := secrets.token_bytes(32))
    return key


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def sha256_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files anywhere that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def snapshot(source: str | Path, destination: str | Path) -> dict:
    """A consistent copy of a live database by SQLite's backup, checked, with a manifest beside it. The source must not change meanwhile."""
    src, dst = Path(source), Path(destination)
    if not src.exists():
        raise FileNotFoundError(src)
    if src.resolve() == dst.resolve():
        raise ValueError("source and destination are the same file")
    before, tmp = src.stat(), private_dir(dst.parent) / f".{dst.name}.tmp"
    tmp.unlink(missing_ok=True)
    os.close(os.open(tmp, os.O_WRONLY | os.O_CREAT, 0o600))
    a, b = open_readonly(src), sqlite3.connect(tmp)
    try:
        a.backup(b, pages=2048)
        check = b.execute("PRAGMA quick_check").fetchone()[0]
    finally:
        a.close()
        b.close()
    after = src.stat()
    if check != "ok" or (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
        tmp.unlink()
        raise RuntimeError("the source changed during the copy" if check == "ok" else f"the copy is damaged: {check}")
    os.replace(tmp, dst)
    manifest = {"source_size": before.st_size, "source_mtime_ns": before.st_mtime_ns, "snapshot_size": dst.stat().st_size, "snapshot_sha256": sha256_file(dst), "quick_check": check, "source_open_mode": "read-only", "sqlite_version": sqlite3.sqlite_version}
    write_json(dst.parent / "manifest.json", manifest)
    return manifest


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one a line; blank lines are skipped and anything else fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def check_jsonl(path: str | Path) -> int:
    """Reads one local file of JSON objects, one a line, and gives their count; a line that is none is a ValueError with its number."""
    n = 0
    with open(path, encoding="utf-8") as f:
        for number, line in enumerate(f, 1):
            if line.strip():
                try:
                    whole = isinstance(json.loads(line), dict)
                except json.JSONDecodeError:
                    whole = False
                if not whole:
                    raise ValueError(f"{path}, line {number}: not a JSON object")
                n += 1
    return n


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", private: bool = False) -> None:
    """Keys in sorted order, nulls kept. Private, on a local file system: the folder 0700, its files 0600."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)
    if private:
        Path(path).chmod(0o700)
        for f in Path(path).iterdir():
            f.chmod(0o600)


def append_metric(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")
