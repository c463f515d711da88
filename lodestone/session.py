"""Session set-up: a local factory for tests and benches, and shipping this package to executors."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benches use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestone")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession | None = None) -> None:
    """Give executors this package, once an application, so that Python tasks can import it.

    A Python function takes the files along that are known when it is built, so this
    comes before each of them (:func:`map_arrow`, :func:`map_pandas`).
    """
    spark = spark or SparkSession.active()
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def _give_back() -> None:
    """Returns freed memory to the system, as workers are reused and wait between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with a function that needs this package at the executors; a task gives its memory back when it ends."""
    ship(df.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _give_back()

    return df.mapInArrow(apply, schema)


def map_pandas(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInPandas`` with a function that needs this package at the executors."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or one set on the context.

    Only a session on this machine alone (``local``) gets a temporary folder where none is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: one computation, lineage cut, readable by every executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
