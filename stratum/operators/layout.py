"""What rows would occupy in pages, what plans would read, and how an LRU pool would serve them."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def with_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Row numbers from 0 in a global order, without one task that sees all rows: range partitions, an offset for
    each from their totals, and the place within. All columns break ties."""
    spark = df.sparkSession
    keys = [*order, *[c for c in df.columns if c not in order]]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part__", F.spark_partition_id()).withColumn("line__", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranked")
    totals = ranged.groupBy("part__").agg(F.count(F.lit(1)).alias("rows__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part__", F.coalesce(F.sum("rows__").over(before), F.lit(0)).alias("offset__"))  # a row per partition
    return ranged.join(F.broadcast(offsets), "part__").select(*df.columns, (F.col("offset__") + F.col("line__").bitwiseAND((1 << 33) - 1)).alias(name))


def record_ids(df: DataFrame, order: Sequence[str], page_rows: int) -> DataFrame:
    """page_id and slot_id of each row loaded in that order."""
    ranked = with_rank(df, order, "rank__")
    return ranked.select(*df.columns, F.expr(f"rank__ div {page_rows}").alias("page_id"), F.expr(f"rank__ % {page_rows}").alias("slot_id"))


def page_count(rows, page_rows: int):
    """Pages of a table; an empty one has a page too."""
    return F.greatest(F.lit(1), F.ceil(rows / page_rows)).cast("bigint")


def block_pages(buffer_frames: int) -> int:
    """Pages of an outer block: half of the frames but one."""
    n = (buffer_frames - 1) // 2
    if n < 1:
        raise ValueError("the buffer needs at least 3 frames")
    return n


def io_cost(movies_pages: int, workedon_pages: int, directors_pages: int, people_pages: int, rows: int, rows_per_movies_page: int, rows_per_join_page: int, buffers: Sequence[int]) -> list[tuple[int, int]]:
    """(buffer, page reads and writes) of the three-table plan by nested blocks."""
    out = []
    for b in buffers:
        n = block_pages(b)
        first = -(-rows // (n * rows_per_movies_page)) * directors_pages
        out.append((b, workedon_pages + directors_pages + movies_pages + first + -(-rows // (n * rows_per_join_page)) * people_pages))
    return out


def selectivity_bounds(df: DataFrame, field: str, selectivities: Sequence[float]) -> DataFrame:
    """The field's value at rank ceil(sel * n) for each selectivity."""
    spark = df.sparkSession
    values = with_rank(df.select(field), [field], "rank__")
    total = df.agg(F.count(F.lit(1)).alias("n__"))
    wanted = spark.createDataFrame([(float(s),) for s in selectivities], "sel double").crossJoin(total)  # one row
    wanted = wanted.select("sel", (F.greatest(F.lit(1), F.least(F.ceil(F.col("sel") * F.col("n__")), F.col("n__"))) - 1).alias("rank__"))
    return values.join(F.broadcast(wanted), "rank__").select("sel", field)


def lru_simulation(accesses: DataFrame, trace: str, seq: str, page: str, buffers: Sequence[int], pinned: str | None = None) -> DataFrame:
    """Hits, misses and evictions of an LRU pool per trace and buffer size.

    A trace is cut into slices of range partitions, played side by side for all buffer sizes. A pool's content at a
    slice's border is the last pages touched before it, so each slice tells the last max(buffers) pages that it
    touched, and a fold over these short lists gives every slice the content that it begins with.

    `pinned`: a boolean column, true while that access's page may not be evicted until its next unpinned access. What a
    pool holds then depends on all before, so one task plays a trace; a pool whose frames are all pinned is an error."""
    if pinned:
        return _pinned_simulation(accesses, trace, seq, page, buffers, pinned)
    spark, most = accesses.sparkSession, max(buffers)
    kind, of = accesses.schema[trace].dataType.simpleString(), accesses.schema[page].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = accesses.select(F.col(trace).alias("trace__"), F.col(seq).alias("seq__"), F.col(page).alias("page__"))
    ranged = stored(narrow.repartitionByRange(n, "trace__", "seq__", "page__").withColumn("slice__", F.spark_partition_id()), "slices")
    last = ranged.groupBy("trace__", "slice__", "page__").agg(F.max(F.struct("seq__", "page__")).alias("at__"))
    nth = Window.partitionBy("trace__", "slice__").orderBy(F.desc("at__"))
    tops = last.withColumn("nth__", F.row_number().over(nth)).filter(F.col("nth__") <= most)
    tops = tops.groupBy("trace__", "slice__").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth__", "page__"))), lambda x: x["page__"]).alias("top__"))  # max(buffers) pages at most

    def fold(pdf):
        import pandas as pd

        held: list = []
        rows = []
        for slice_, top in pdf.sort_values("slice__")[["slice__", "top__"]].itertuples(index=False):
            rows.append((pdf["trace__"].iloc[0], slice_, held))
            own = list(top)
            held = (own + [p for p in held if p not in set(own)])[:most]
        return pd.DataFrame(rows, columns=["trace__", "slice__", "held__"])

    starts = tops.groupBy("trace__").applyInPandas(fold, f"trace__ {kind}, slice__ int, held__ array<{of}>")  # short lists, one a slice

    def play(pdf, state):
        import pandas as pd

        pages, held, rows = pdf.sort_values(["seq__", "page__"], kind="stable")["page__"].tolist(), list(state["held__"].iloc[0]), []
        for size in buffers:
            pool = OrderedDict.fromkeys(reversed(held[:size]))
            hits = 0
            for p in pages:
                if p in pool:
                    hits += 1
                    pool.move_to_end(p)
                else:
                    if len(pool) >= size:
                        pool.popitem(last=False)
                    pool[p] = None
            rows.append((pdf["trace__"].iloc[0], size, hits, len(pages) - hits))
        return pd.DataFrame(rows, columns=["trace__", "buffer", "hits", "misses"])

    keys = ["trace__", "slice__"]
    played = ranged.groupBy(keys).cogroup(starts.groupBy(keys)).applyInPandas(play, f"trace__ {kind}, buffer long, hits long, misses long")
    totals = played.groupBy("trace__", "buffer").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    pages = last.groupBy("trace__").agg(F.count_distinct("page__").alias("pages__"))
    return totals.join(pages, "trace__").select(F.col("trace__").alias(trace), "buffer", "hits", "misses", (F.col("misses") - F.least("buffer", "pages__")).alias("evictions"))


def _pinned_simulation(accesses: DataFrame, trace: str, seq: str, page: str, buffers: Sequence[int], pinned: str) -> DataFrame:
    def play(pdf):
        import pandas as pd

        pdf, rows = pdf.sort_values([seq, page], kind="stable"), []
        for size in buffers:
            pool: OrderedDict = OrderedDict()
            hits = misses = evictions = 0
            for p, held in zip(pdf[page], pdf[pinned], strict=True):
                if p in pool:
                    hits += 1
                    pool.move_to_end(p)
                else:
                    misses += 1
                    if len(pool) >= size:
                        victim = next((k for k, pin in pool.items() if not pin), None)
                        if victim is None:
                            raise RuntimeError("all frames are pinned")
                        del pool[victim]
                        evictions += 1
                pool[p] = bool(held)
            rows.append((pdf[trace].iloc[0], size, hits, misses, evictions))
        return pd.DataFrame(rows, columns=[trace, "buffer", "hits", "misses", "evictions"])

    kind = accesses.schema[trace].dataType.simpleString()
    return accesses.select(trace, seq, page, pinned).groupBy(trace).applyInPandas(play, f"{trace} {kind}, buffer long, hits long, misses long, evictions long")
