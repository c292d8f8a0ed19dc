"""Scan, selection, projection, join and index access as DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import is_plain, plain, sort_key
from ..sources.scratch import scratch, stored

#: Name of the stored sort key of an indexed field.
KEY = "{}__key"


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def select(df: DataFrame, predicate: Column | Callable) -> DataFrame:
    """Rows that satisfy a Column. A Python callable over a row's fields as a dict works too, by a slow UDF."""
    if callable(predicate) and not isinstance(predicate, Column):
        test = F.udf(lambda row: bool(predicate(row.asDict())), "boolean")
        return df.filter(test(F.struct(*df.columns)))
    return df.filter(predicate)


def select_range(df: DataFrame, field: str, start: str, end: str, width: int, order: str = "signed") -> DataFrame:
    """start <= field <= end. order: "signed" (the order of padded bytes as signed numbers, by the stored key if
    there is one) or "binary" (plain string order, the same for ASCII). Without a stored key, only values that string
    order may misplace get one."""
    if order == "binary":
        return df.filter(F.col(field).between(start, end))
    if order != "signed":
        raise ValueError(f"unknown order: {order}")
    key = KEY.format(field)
    ends = sort_key(F.lit(start), width), sort_key(F.lit(end), width)
    if key in df.columns:
        return df.filter(F.col(key).between(*ends))
    own = F.col(field).cast("string")
    hit = sort_key(own, width).between(*ends)
    if is_plain(start, width) and is_plain(end, width):
        hit = F.when(plain(own, width), own.between(start, end)).otherwise(hit)
    return df.filter(hit)


def select_equal(df: DataFrame, field: str, value: str) -> DataFrame:
    return df.filter(F.col(field) == F.lit(value))


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A subset of fields, in order; an unknown one is an error at once."""
    if unknown := [f for f in fields if f not in df.columns]:
        raise ValueError(f"unknown field: {', '.join(unknown)}")
    return df.select(*fields)


@contextmanager
def materialized(df: DataFrame) -> Iterator[DataFrame]:
    """The result stored for several reads and removed at the end of the block, also after a failure."""
    with scratch(df.sparkSession):
        yield stored(df, "materialized")


def equi_join(outer: DataFrame, inner: DataFrame, outer_field: str, inner_field: str, output: Sequence[str]) -> DataFrame:
    """Inner join on one pair of fields. Fields of `output` come from the outer side if it has that name."""
    if unknown := [f for f in output if f not in outer.columns and f not in inner.columns]:
        raise ValueError(f"unknown field: {', '.join(unknown)}")
    key = "join__key"
    inner_only = [f for f in output if f not in outer.columns]
    right = inner.select(F.col(inner_field).alias(key), *inner_only)
    return outer.join(right, outer[outer_field] == right[key], "inner").select(*[outer[f] if f in outer.columns else right[f] for f in output])


def build_index(df: DataFrame, field: str, width: int, path: str, partitions: int | None = None, order: str = "signed") -> None:
    """A copy of `df` sorted by the field's key, with the key stored: range filters skip files and row groups."""
    key = KEY.format(field)
    keyed = df.withColumn(key, sort_key(F.col(field), width) if order == "signed" else F.col(field))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str, field: str) -> DataFrame:
    df = spark.read.parquet(path)
    if KEY.format(field) not in df.columns:
        raise ValueError(f"{path} is no index on {field}")
    return df


def index_range(index: DataFrame, field: str, start, end, width: int, ordered: bool = False, order: str = "signed") -> DataFrame:
    """The rows that a scan with the same range gives; in key order if asked. `order` is that of the index: one in
    binary order serves numbers and dates too."""
    hits = select_range(index, field, start, end, width) if order == "signed" else index.filter(F.col(KEY.format(field)).between(start, end))
    hits = hits.orderBy(KEY.format(field)) if ordered else hits
    return hits.drop(KEY.format(field))


def index_search(index: DataFrame, field: str, value: str, width: int) -> DataFrame:
    return index_range(index, field, value, value, width)


def preview(df: DataFrame, text: str, order_by: Sequence[str], first: int = 250, page: int = 0, page_rows: int = 25) -> DataFrame:
    """A page of those among the first rows in which any column contains the text, whatever the case."""
    head = df.orderBy(*order_by).limit(first)
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
    return head.filter(hit).orderBy(*order_by).offset(page * page_rows).limit(page_rows)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of each side the other lacks, repeats counted. Each side is computed once."""
    sides = [df.toDF(*[f"c{k}" for k in range(len(df.columns))]).withColumn("n", F.lit(n)) for df, n in ((a, 1), (b, -1))]
    both = sides[0].union(sides[1])
    more = both.groupBy(*both.columns[:-1]).agg(F.sum("n").alias("n"))
    total = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0))
    return more.agg(total(F.col("n")).alias("only_left"), total(-F.col("n")).alias("only_right"))
