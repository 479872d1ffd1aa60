"""Intermediate tables, written in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_scratch: list[str] = []
_left: dict[str, SparkSession] = {}
_named: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where driver and executors are one process does a folder of that process stand in for it; a cluster without the
    setting is an error."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="chatloom-"))
        atexit.register(shutil.rmtree, _own_scratch[0], True)
    return _own_scratch[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet and reads it back. Whoever made it discards it once nothing reads it any more; a table under a result that is not
    computed yet has to stay, and goes when the driver ends."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, tag: str, column: str, parts: int) -> DataFrame:
    """written(), dealt to `parts` parts by a column: a join on that column leaves the table where it is, if Spark would not take more parts itself. The catalog knows it until it is
    discarded."""
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.format("parquet").bucketBy(parts, column).option("path", path).saveAsTable(name)
    _left[path] = df.sparkSession
    _named.add(name)
    return df.sparkSession.table(name)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    name = folder.rsplit("/", 1)[-1]
    if name in _named:
        _named.discard(name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def discard(*tables: DataFrame) -> None:
    """Deletes the files under tables that written() made."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)
            for path in [p for p in _left if folder.endswith(p.split(":", 1)[-1])]:
                del _left[path]


def left_over() -> set[str]:
    """Paths of the tables that are written and not discarded."""
    return set(_left)


def discard_paths(paths: set[str], but_those_under: DataFrame) -> set[str]:
    """Deletes written tables, except those that a table still reads; gives these."""
    reads = [f.split(":", 1)[-1] for f in but_those_under.inputFiles()] if paths else []
    needed = {p for p in paths if any(p.split(":", 1)[-1].lstrip("/") in f for f in reads)}
    for p in paths - needed:
        if spark := _left.pop(p, None):
            _delete(spark, p)
    return needed


@atexit.register
def _sweep() -> None:
    for path, spark in _left.items():
        with contextlib.suppress(Exception):  # the JVM may have gone before
            _delete(spark, path)
