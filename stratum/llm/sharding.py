"""Contiguous shards of near equal bytes, in DataFrame functions only.

Rows are sorted by (id, size, checksum) over range partitions; each partition's totals are summed, a prefix
over those few totals gives each partition's global offset, and a running sum inside the partition gives
each row's. The byte axis is cut at equal targets: a row goes to the shard that its middle byte lies in.

Defined results: a null text has no bytes, its row size 1; rows equal in id, size and checksum lie beside one
another in any order; null ids come first; with fewer rows than shards some shards are empty; an empty table
gives an empty result; other columns are ignored by `assign_shards` and kept by `write_shards`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

#: Rows of a range partition aimed at, and partitions at most: the prefix runs over one row per partition.
PARTITION_ROWS, MAX_PARTITIONS = 200_000, 16_384


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def _positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, text_crc32, pos (global row number), start (bytes before it), total (bytes of all)."""
    spark = docs.sparkSession
    narrow = stored(_narrow(docs, id_col, text_col), "sizes")
    rows = narrow.count()
    parts = min(MAX_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS)))
    order = ["id", "size", "text_crc32"]
    ranged = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total")
    )
    inside = Window.partitionBy("part").orderBy("line")
    within = ranged.select("*", (F.row_number().over(inside) - 1).alias("nth"), (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("ahead"))
    placed = within.join(F.broadcast(offsets), "part")  # one row per partition: MAX_PARTITIONS rows at most, or the session's own number
    return placed.select(*order, (F.col("rows_before") + F.col("nth")).alias("pos"), (F.col("bytes_before") + F.col("ahead")).alias("start"), "total")


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, shard, slot (its place in the shard, from 0)."""
    placed = stored(_positions(docs, id_col, text_col).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * start + size) * {shards} div (2 * total)")).cast("int")), "placed")
    first = placed.groupBy("shard").agg(F.min("pos").alias("first"))  # a row per shard
    out = placed.join(F.broadcast(first), "shard")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("pos") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write `docs` as Parquet folders shard=0.. under `path`. Shards being contiguous, the first key of each
    (`shards` rows) places every row; no row joins. A name clash with `shard` gets underscores."""
    (shard,) = fresh(docs, "shard")
    marks = assign_shards(docs, shards, id_col, text_col)
    key = F.struct("id", "size", "text_crc32")
    firsts = marks.withColumnRenamed(id_col, "id").groupBy("shard").agg(F.min(key).alias("key")).orderBy("shard").select("shard", "key.*").collect()
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    own = F.struct(F.col(id_col), (F.octet_length(text) + 1).cast("long"), F.crc32(text))
    at = F.lit(firsts[0]["shard"] if firsts else 0)
    for f in firsts[1:]:
        at = F.when(own >= F.struct(F.lit(f["id"]).cast(docs.schema[id_col].dataType), F.lit(f["size"]).cast("long"), F.lit(f["text_crc32"]).cast("long")), F.lit(f["shard"])).otherwise(at)
    docs.withColumn(shard, at).write.partitionBy(shard).parquet(path)
