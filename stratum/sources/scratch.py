"""Intermediate tables in a folder that the driver and all executors share, and their removal.

The folder is `spark.checkpoint.dir`; only in local mode a temporary one stands in where none is set. What a
`scratch` block stores goes when the block ends; everything else goes when the application exits.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_temporary: list[str] = []
_folders: dict[str, str] = {}  # of each application
_block: ContextVar[str | None] = ContextVar("block", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _temporary:
        _temporary.append(tempfile.mkdtemp(prefix="stratum-"))
        atexit.register(shutil.rmtree, _temporary[0], True)
    return "file://" + _temporary[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the block's folder, or in that of the application."""
    folder = _block.get()
    if folder is None:
        key = f"{spark.sparkContext.applicationId} {scratch_root(spark)}"
        if key not in _folders:
            _folders[key] = f"{scratch_root(spark)}/stratum-{uuid.uuid4().hex[:12]}"
            atexit.register(_at_exit, spark, _folders[key])
        folder = _folders[key]
    return f"{folder}/{tag}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or of a path without a scheme, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    if (plain := local_path(path)) is not None:
        shutil.rmtree(plain, ignore_errors=True)
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder of the store; `new` must not be there."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new)]
    if not paths[0].getFileSystem(spark._jsc.hadoopConfiguration()).rename(*paths):
        raise OSError(f"{old} could not be renamed to {new}")


def _at_exit(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may be gone
        delete(spark, path)


def make_dirs(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A block whose stored tables are removed at its end, also after a failure: read or store results within."""
    path = scratch_path(spark, "block")
    token = _block.set(path)
    try:
        yield path
    finally:
        _block.reset(token)
        delete(spark, path)


def settled(spark: SparkSession, tag: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of `build`, stored; what `build` stored on the way is removed."""
    path = scratch_path(spark, tag)
    with scratch(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
