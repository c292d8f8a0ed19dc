r"""CSV and TSV sources of fixed-width relations.

The fast path is Spark's reader. The strict path keeps every corner of the original line format: a quote counts
at a field's start only, "" inside quotes is a quote, text after a closing quote loses its first character and
starts a new field, a blank line is a record of empty fields, short lines are filled and long ones cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import byte_length, null_marker, present
from ..schema import Relation


class HeaderError(ValueError):
    pass


def parse_line(line: str) -> list[str]:
    fields, at, size = [], 0, len(line)
    while True:
        if at < size and line[at] == '"':
            value, at = [], at + 1
            while at < size:
                end = line.find('"', at)
                if end < 0:
                    value.append(line[at:])
                    at = size
                elif line[end + 1 : end + 2] == '"':
                    value.append(line[at : end + 1])
                    at = end + 2
                else:
                    value.append(line[at:end])
                    at = end + 1
                    break
            fields.append("".join(value))
            if at >= size:
                return fields
            at += 1  # a comma, or what stands in its place
        else:
            end = line.find(",", at)
            if end < 0:
                fields.append(line[at:])
                return fields
            fields.append(line[at:end])
            at = end + 1


def check_header(header: str | None, relation: Relation) -> int:
    """How many fields the file has: its header must be the first names of the relation, in order."""
    if header is None:
        raise HeaderError("the file is empty")
    names = parse_line(header.removeprefix("﻿"))
    if names != relation.names[: len(names)]:
        raise HeaderError(f"the header {names} does not start the schema {relation.names}")
    return len(names)


@dataclass
class Loaded:
    """`rows` fit; `rejects` (path, line, field, needed, allowed) do not and were skipped."""

    rows: DataFrame
    rejects: DataFrame

    def report(self, most: int = 20) -> list[str]:
        """A warning for each of the first rejects and a total."""
        first, total = self.rejects.orderBy("path", "line").limit(most).collect(), self.rejects.count()
        out = [f"line {r['line']} skipped: {r['field']} requires {r['needed']} UTF-8 bytes but field allows {r['allowed']}" for r in first]
        if total > most:
            out.append(f"further warnings suppressed after {most}")
        return out + ([f"{total} rows skipped"] if total else [])


def _first_over(relation: Relation) -> Column:
    """The first field that is too wide, as (field, needed, allowed), or null."""
    first = F.lit(None).cast("struct<field:string,needed:int,allowed:int>")
    for f in reversed(relation.fields):
        needed = byte_length(F.col(f.name))
        first = F.when(needed > f.width, F.struct(F.lit(f.name).alias("field"), needed.alias("needed"), F.lit(f.width).alias("allowed"))).otherwise(first)
    return first


def _fields(names: list[str], value: str) -> list[str]:
    return (parse_line(value) + [""] * len(names))[: len(names)]


def _strict_rows(lines: DataFrame, relation: Relation) -> DataFrame:
    """The records of the lines (path, start, mid, value), without each file's header; path, start and mid stay."""
    names = relation.names

    def parse(batches):
        last = None
        for batch in batches:
            kept, rows = [], []
            for k, (path, start, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                if (path, start) != last:
                    last = (path, start)
                    if start == 0:
                        check_header(value, relation)
                        continue
                kept.append(k)
                rows.append(_fields(names, value))
            head = batch.take(pa.array(kept, pa.int64())).columns[:3]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array([r[c] for r in rows], pa.string()) for c in range(len(names)))], names=["path", "start", "mid", *names])

    return lines.mapInArrow(parse, "path string, start long, mid long, " + ", ".join(f"`{n}` string" for n in names))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path and start of the split, a number that grows along the split, and the line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("mid"), "value")


def _numbered(rejects: DataFrame, lines: DataFrame) -> DataFrame:
    """Rejects with their line in the file, from 1: the lines of the splits before and those of its own. Only the rejects
    and a row for each split shuffle."""
    splits = lines.groupBy("path", "start").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return rejects.join(placed, ["path", "start"]).withColumn("line", F.col("ahead") + F.col("mid") - F.col("first") + 1).select("path", "line", "reject__.*")


def read_csv(spark: SparkSession, path: str, relation: Relation, strict: bool = False) -> Loaded:
    """A CSV file, or a folder of them, with a header in each. Rejects have their path and line; they are found by
    another pass, which nothing but the rejects needs."""
    header = spark.read.text(path).limit(1).collect()
    count = check_header(header[0][0] if header else None, relation)
    names, lines = relation.names, _lines(spark, path)
    if strict:
        parsed = _strict_rows(lines, relation)
        rows, every = parsed.select(names), parsed
    else:
        read = spark.read.schema(relation.struct()).option("header", True).option("escape", '"').option("enforceSchema", True).csv(path)
        fill = lambda get: [present(get(n)).alias(n) if k < count else F.lit("").alias(n) for k, n in enumerate(names)]
        rows = read.select(fill(F.col))
        own = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"escape": '"'})
        firsts = lines.filter("start = 0").groupBy("path").agg(F.min("mid").alias("mid"))
        body = lines.filter(F.trim("value") != "").join(firsts, ["path", "mid"], "left_anti")
        every = body.select("path", "start", "mid", own.alias("r")).select("path", "start", "mid", *fill(lambda n: F.col(f"r.`{n}`")))
    fits = F.lit(True)
    for f in relation.fields:
        fits = fits & (byte_length(F.col(f.name)) <= f.width)
    rejects = every.withColumn("reject__", _first_over(relation)).filter("reject__ is not null").select("path", "start", "mid", "reject__")
    return Loaded(rows.filter(fits), _numbered(rejects, lines))


def read_dump(spark: SparkSession, path: str, relation: Relation, columns: dict[str, str]) -> DataFrame:
    r"""A tab-separated dump (gzip or not) without quoting; `columns`: source name by field name. \N becomes empty;
    a missing column is an error at once, an over-wide or multi-line value one when rows are read."""
    df = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    if missing := [c for c in columns.values() if c not in df.columns]:
        raise ValueError(f"missing column: {', '.join(missing)}")
    out = []
    for f in relation.fields:
        value = null_marker(F.col(f"`{columns[f.name]}`"))
        wide = F.raise_error(F.concat(F.lit(f"{f.name} exceeds {f.width} UTF-8 bytes: "), byte_length(value).cast("string")))
        lines = F.raise_error(F.lit(f"{f.name} has a line break"))
        out.append(F.when(byte_length(value) > f.width, wide).when(value.rlike("[\r\n]"), lines).otherwise(value).alias(f.name))
    return df.select(*out)
