"""Access to the input tables, the session's shared folder and small shared steps."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()
#: Spark removes a query's shuffle files when the query ends, else when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the workers, once a context, where they would not find it by path."""
    context = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if context.applicationId in _shipped or str(ROOT) in known:
        return
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(ROOT / "seqspark", Path(folder, "code", "seqspark"), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/seqspark", "zip", Path(folder, "code")))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is set and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or "/tmp/checkpoints/seqspark"


_recorded: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that ``stored`` writes inside the block."""
    _recorded.append([])
    try:
        yield _recorded[-1]
    finally:
        _recorded.pop()


def remove(spark: SparkSession, paths: list[str], read_by: DataFrame) -> None:
    """Removes folders that ``stored`` wrote, but for those that a DataFrame reads."""
    used = {name.rsplit("/", 2)[-2] for name in read_by.inputFiles()} if paths else set()
    for path in paths:
        if path.rsplit("/", 1)[-1] not in used:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives executors. Its shuffle files go at once."""
    spark = df.sparkSession
    ship_code(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    for paths in _recorded:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
