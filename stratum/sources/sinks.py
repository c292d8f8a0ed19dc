"""Result, metrics and run-log files."""

from __future__ import annotations

import csv
import json
import os
import re
import shutil
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import delete, move

PREFIX, QUERY_PREFIX, RUN_PREFIX = "STRATUM_METRICS", "STRATUM_ENGINE_QUERY", "STRATUM_ENGINE_RUN"


def result_lines(df: DataFrame, quoted: bool = False) -> DataFrame:
    """A line per row, fields joined by commas. Without `quoted` a comma in a field is not told apart."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    if quoted:
        cells = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def write_results(df: DataFrame, path: str, quoted: bool = False, single: bool = False) -> int:
    """Overwrite `path` with the result lines; returns how many, counted as they are written. The result is a folder of
    parts or, with `single`, one file by one task, for results of moderate size."""
    seen = Observation()
    lines = result_lines(df, quoted).observe(seen, F.count(F.lit(1)).alias("rows"))
    if not single:
        lines.write.mode("overwrite").text(path)
        return seen.get["rows"]
    folder = f"{path}.{uuid.uuid4().hex[:8]}"
    try:
        lines.coalesce(1).write.text(folder)
        (part,) = [n for n in os.listdir(folder) if n.startswith("part-")] or [None]
        if part is None:
            open(path, "w").close()
        else:
            os.replace(f"{folder}/{part}", path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return seen.get["rows"]


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header each, quoted where needed. An old one stays until the new one is whole."""
    spark, fresh = df.sparkSession, f"{path}.{uuid.uuid4().hex[:8]}"
    try:
        df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(fresh)
        delete(spark, path)
        move(spark, fresh, path)
    finally:
        delete(spark, fresh)


def sorted_rows(df: DataFrame) -> DataFrame:
    return df.orderBy(*df.columns)


def metrics_line(prefix: str = PREFIX, /, **values: object) -> str:
    return " ".join([prefix, *(f"{k}={v}" for k, v in values.items())])


def parse_metrics(line: str, prefix: str = PREFIX) -> dict[str, int] | None:
    """The line's integers; None if it is no such line or any value is none."""
    head, *pairs = line.split() or [""]
    if head != prefix or not pairs or any(not re.fullmatch(r"\w+=-?\d+", p) for p in pairs):
        return None
    return {k: int(v) for k, v in (p.split("=") for p in pairs)}


def metrics_column(line: Column, key: str) -> Column:
    """The same of a column of lines, for logs of any size."""
    good = line.rlike(rf"^{PREFIX}( \w+=-?\d+)+$")
    return F.when(good, F.regexp_extract(line, rf" {key}=(-?\d+)", 1)).try_cast("long")


def append_rows(path: str, rows: Sequence[dict]) -> None:
    """Append to a CSV log. If rows have columns that the log has not, these follow the old ones and the file is written
    anew, atomically; else only the rows are written."""
    columns: list[str] = []
    if os.path.exists(path):
        with open(path, newline="", encoding="utf-8") as f:
            columns = next(csv.reader(f), [])
    merged = list(dict.fromkeys([*columns, *(k for row in rows for k in row)]))
    if columns and merged == columns:
        with open(path, "a", newline="", encoding="utf-8") as f:
            csv.DictWriter(f, columns, restval="").writerows(rows)
        return
    old: list[dict] = []
    if columns:
        with open(path, newline="", encoding="utf-8") as f:
            old = list(csv.DictReader(f))
    temporary = f"{path}.{uuid.uuid4().hex[:8]}"
    with open(temporary, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, merged, restval="")
        writer.writeheader()
        writer.writerows([*old, *rows])
    os.replace(temporary, path)


def append_frame(df: DataFrame, path: str) -> DataFrame:
    """The same for tables of any size: appended Parquet, read with merged columns."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", True).parquet(path)


def append_json(path: str, record: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")
