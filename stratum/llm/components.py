"""Connected components of links between nodes, by alternating large-star and small-star steps.

Every step is a group minimum and a join over stored tables; nothing is collected. Large nodes' rows are
combined before they shuffle, and meet their minimum by a broadcast of bounded size. A step's tables go when the next
one is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import attach_groups, delete, scratch_path


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, `total` of them. A step's new edges, in the same form."""
    own = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = own.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = attach_groups(own, least, "u", "n", 2 * total if large else total)
    if large:
        new = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return new.filter("u != v").distinct()


def connected_components(links: DataFrame, a: str, b: str, most_steps: int = 60) -> DataFrame:
    """(node, component) of every node in a link with another; the component is its smallest node."""
    spark, paths = links.sparkSession, []

    def keep(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges stored, in place of those before, and their number and checksum, taken as they are written."""
        path, seen = scratch_path(spark, "edges"), Observation()
        checked = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark"))
        checked.write.parquet(path)
        paths.append(path)
        for old in paths[:-1]:
            delete(spark, old)
            paths.remove(old)
        told = seen.get
        return spark.read.schema(df.schema).parquet(path), (told.get("n") or 0, told.get("mark"))

    pair = links.filter(F.col(a) != F.col(b))
    edges, sign = keep(pair.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most_steps):
        near, _ = keep(_star(edges, sign[0], True))
        before, (edges, sign) = sign, keep(_star(near, sign[0], False))
        if sign == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
