"""The Spark session that the engine's queries expect."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def get_session(app: str = "lexloom", master: str | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """UTC, adaptive execution, Arrow; ``partitions`` defaults to the local cores."""
    cores = os.cpu_count() or 8
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions or cores),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def traced(spark: SparkSession, trace_id: str | None = None, user_id: str | None = None) -> Iterator[str]:
    """Jobs inside carry the trace and user ids as tags and description; yields the trace id (a new one if none is given)."""
    trace = trace_id or uuid.uuid4().hex
    tags = [f"trace-{trace}", *([f"user-{user_id}"] if user_id else [])]
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    for tag in tags:
        spark.addTag(tag)
    context.setJobDescription(f"trace {trace}" + (f", user {user_id}" if user_id else ""))
    try:
        yield trace
    finally:
        for tag in tags:
            spark.removeTag(tag)
        context.setLocalProperty("spark.job.description", before)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    staged = Path(folder) / "src" / top.name
    shutil.copytree(top, staged, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", staged.parent, top.name))


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set as the checkpoint folder.

    Where neither is set, a temporary folder of our own serves on a single machine; on a cluster that raises,
    as other machines would not see it.
    """
    context = spark.sparkContext
    if root := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = context.applicationId
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dirs[app] = f"file://{path}"
    return _own_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    """The address of a new folder of this name in the shared one."""
    return f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors. ``row_group``: bytes of one, if not Parquet's own."""
    path = scratch(df.sparkSession, name)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by keys to as many tasks as a shuffle has, before a costly step: a table of one small file is one task otherwise."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
