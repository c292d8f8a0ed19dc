"""Helpers shared by the operators: fresh column names, skew-proof group joins, the memory and code of workers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, local_path, scratch, scratch_path, scratch_root, settled, stored  # noqa: F401

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bound on the number of groups that `attach_groups` ever broadcasts.
MAX_HEAVY_GROUPS = 50_000

_held: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Called in a worker by an operator that remembers things between tasks: what other operators remember there is
    dropped, and freed memory goes back to the system."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    _held[name] = drop
    if others:
        release()


def release() -> None:
    """Collect garbage of this worker and give freed memory back to the system."""
    gc.collect()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(work: Callable) -> Callable:
    """`work` on a partition's batches, after which the worker, which Spark keeps, gives freed memory back."""

    def run(batches):
        yield from work(batches)
        release()

    return run


def byte_slices(lengths: np.ndarray, rows: int, size: int):
    """(first, end) of runs of at most `rows` texts and, but for a single one, `size` bytes."""
    ends, a = np.cumsum(lengths, dtype=np.int64), 0
    while a < len(lengths):
        most = (ends[a - 1] if a else 0) + size
        b = min(max(int(np.searchsorted(ends, most, side="right")), a + 1), a + rows)
        yield a, b
        a = b


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that clash with none of `df`'s, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty.

    `lower` maps an all-ASCII text right and runs over bytes, so only other texts take `translate`.
    """
    text = F.coalesce(c, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def heavy_limit(total_rows: int) -> int:
    """Groups above this size number at most MAX_HEAVY_GROUPS among `total_rows` rows."""
    return max(100, -(-total_rows // MAX_HEAVY_GROUPS))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total_rows: int) -> DataFrame:
    """Inner join of `rows` with one row per `key` of `groups`, whatever the size of the largest group.

    Groups of over `heavy_limit` rows are broadcast (at most MAX_HEAVY_GROUPS of them can exist), the
    others join by a shuffle in which no key has more rows than that limit.
    """
    limit = heavy_limit(total_rows)
    heavy, light = groups.filter(F.col(size) > limit), groups.filter(F.col(size) <= limit)
    by_broadcast = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    by_shuffle = rest.join(light, key)
    return by_broadcast.unionByName(by_shuffle)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


#: Bytes of a batch that goes to a Python worker; Spark's own default is sixteen times that.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and keep their batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="stratum-code-")  # of the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/stratum_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for base, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(f"{base}/{name}", os.path.relpath(f"{base}/{name}", os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
