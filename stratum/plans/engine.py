"""Admission-controlled queries on one session, and a benchmark that checks every result."""

from __future__ import annotations

import statistics
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import multiset_difference
from ..sources.sinks import QUERY_PREFIX, RUN_PREFIX, metrics_line
from ..sources.workload import Workload

Plan = Callable[[str, str], DataFrame]
OK, FAILED, MISMATCH = 0, 1, 2


def frame_budget(pool: int, concurrent: int) -> int:
    if concurrent < 1:
        raise ValueError("at least one query must be admitted")
    if pool // concurrent < 3:
        raise ValueError("the pool gives a query fewer than 3 frames")
    return pool // concurrent


@dataclass(frozen=True)
class IoCounters:
    """What the tasks of a job group read and wrote, by Spark's own metrics."""

    read_bytes: int = 0
    read_rows: int = 0
    written_bytes: int = 0
    shuffle_read_bytes: int = 0
    shuffle_written_bytes: int = 0
    spilled_bytes: int = 0

    @property
    def total_bytes(self) -> int:
        return self.read_bytes + self.written_bytes


def io_of_group(spark: SparkSession, group: str) -> IoCounters:
    """Counters of the stages that ran for a job group; skipped stages read nothing."""
    sc = spark.sparkContext
    core = sc._jsc.sc()
    core.listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), core.statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    found = []
    for s in sorted(stages):
        data = store.lastStageAttempt(s)
        found.append((data.inputBytes(), data.inputRecords(), data.outputBytes(), data.shuffleReadBytes(), data.shuffleWriteBytes(), data.diskBytesSpilled()))
    return IoCounters(*map(sum, zip(*found, strict=True))) if found else IoCounters()


@dataclass(frozen=True)
class Outcome:
    rows: int
    wait_ns: int
    run_ns: int
    io: IoCounters = IoCounters()

    @property
    def latency_ns(self) -> int:
        return self.wait_ns + self.run_ns


class AdmissionEngine:
    """At most `concurrent` queries run; others wait, none is refused. The order of admission is not promised."""

    def __init__(self, spark: SparkSession, pool: int, concurrent: int):
        self.spark, self.budget = spark, frame_budget(pool, concurrent)
        self._permits = threading.Semaphore(concurrent)

    def run(self, plan: Callable[[], DataFrame], use: Callable[[DataFrame], int] = DataFrame.count) -> Outcome:
        """Run `use` on the plan's result. An error reaches the caller and frees the permit."""
        asked = time.perf_counter_ns()
        with self._permits:
            began = time.perf_counter_ns()
            sc = self.spark.sparkContext
            group = f"query-{uuid.uuid4().hex[:8]}"
            sc.setJobGroup(group, "admitted query", interruptOnCancel=True)
            sc.setLocalProperty("spark.scheduler.pool", threading.current_thread().name)
            try:
                rows = use(plan())
            finally:
                sc.setLocalProperty("spark.scheduler.pool", None)
                sc.setLocalProperty("spark.jobGroup.id", None)
            spent = time.perf_counter_ns() - began
            return Outcome(rows, began - asked, spent, io_of_group(self.spark, group))


@dataclass(frozen=True)
class Config:
    pool: int
    concurrent: int
    clients: int
    repetitions: int
    warmups: int = 0

    def __post_init__(self):
        frame_budget(self.pool, self.concurrent)
        if self.clients < 1 or self.repetitions < 1 or self.warmups < 0:
            raise ValueError("clients and repetitions must be positive, warm-ups not negative")


@dataclass(frozen=True)
class QueryRecord:
    workload: str
    repetition: int
    warmup: bool
    status: int
    rows: int
    wait_ns: int
    run_ns: int
    error: str = ""
    task: int = 0
    read_bytes: int = 0
    written_bytes: int = 0


@dataclass(frozen=True)
class RunSummary:
    """Records of a benchmark, and what it left behind: cached tables and scratch folders."""

    records: tuple[QueryRecord, ...]
    makespans_ns: tuple[int, ...]
    config: Config | None = None
    workloads: int = 0
    residual_tables: int = 0

    @property
    def mismatches(self) -> int:
        return sum(r.status == MISMATCH for r in self.records)

    @property
    def success(self) -> bool:
        return all(r.status == OK for r in self.records) and not self.residual_tables

    def lines(self) -> list[str]:
        """A line per measured query and one for the run, of key=value pairs."""
        own = [r for r in self.records if not r.warmup]
        out = [metrics_line(QUERY_PREFIX, task_id=r.task, workload=r.workload, repetition=r.repetition, status_code=r.status, result_count=r.rows, client_latency_ns=r.wait_ns + r.run_ns, admission_wait_ns=r.wait_ns, execution_ns=r.run_ns) for r in own]
        c, good = self.config, sum(r.status == OK for r in own)
        settings = {"buffer_size": c.pool, "max_concurrent": c.concurrent, "clients": c.clients, "frame_budget": frame_budget(c.pool, c.concurrent), "warmups": c.warmups, "repetitions": c.repetitions} if c else {}
        spans = ",".join(map(str, self.makespans_ns))
        return [*out, metrics_line(RUN_PREFIX, **settings, workloads=self.workloads, queries=len(own), successful=good, failed=len(own) - good, makespans_ns=spans, read_bytes=sum(r.read_bytes for r in own), written_bytes=sum(r.written_bytes for r in own), result_mismatches=self.mismatches, residual_tables=self.residual_tables)]


def cached_tables(spark: SparkSession) -> int:
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def benchmark(spark: SparkSession, plan: Plan, workloads: Sequence[Workload], config: Config) -> RunSummary:
    """Sequential baselines, checked warm-ups, then repetitions, each a batch that is drained before the next.
    Clients take every `clients`-th task. A baseline without rows is an error."""
    before = cached_tables(spark)
    baselines = {w.name: plan(w.start, w.end).persist() for w in workloads}
    records, spans = [], []
    try:
        for name, df in baselines.items():
            if df.isEmpty():
                raise ValueError(f"workload {name} has no rows")
        engine = AdmissionEngine(spark, config.pool, config.concurrent)

        def one(task: int, w: Workload, repetition: int, warmup: bool) -> QueryRecord:
            same = True

            def use(df: DataFrame) -> int:
                nonlocal same
                held = df.persist()
                try:
                    same = sum(multiset_difference(held, baselines[w.name]).first()) == 0
                    return held.count()
                finally:
                    held.unpersist(blocking=True)

            try:
                o = engine.run(lambda: plan(w.start, w.end), use)
            except Exception as e:  # recorded: a benchmark goes on after a failed query
                return QueryRecord(w.name, repetition, warmup, FAILED, 0, 0, 0, str(e)[:500], task)
            return QueryRecord(w.name, repetition, warmup, OK if same else MISMATCH, o.rows, o.wait_ns, o.run_ns, "" if same else "the rows differ from the baseline's", task, o.io.read_bytes, o.io.written_bytes)

        def batch(repetition: int, warmup: bool) -> tuple[list[QueryRecord], int]:
            start = threading.Event()

            def client(k: int) -> list[QueryRecord]:
                start.wait()
                return [one(t, w, repetition, warmup) for t, w in list(enumerate(workloads))[k :: config.clients]]

            with ThreadPoolExecutor(config.clients) as pool:
                waiting = [pool.submit(client, k) for k in range(config.clients)]
                began = time.perf_counter_ns()
                start.set()
                records = [r for f in waiting for r in f.result()]
            return records, time.perf_counter_ns() - began

        for k in range(config.warmups):
            records += batch(k, True)[0]
        for k in range(config.repetitions):
            done, span = batch(k, False)
            records += done
            spans.append(span)
    finally:
        for df in baselines.values():
            df.unpersist(blocking=True)
    return RunSummary(tuple(records), tuple(spans), config, len(workloads), max(0, cached_tables(spark) - before))


def nearest_rank(values: Sequence[float], share: float) -> float | None:
    if not values:
        return None
    ordered = sorted(values)
    return ordered[max(0, -(-int(round(share * len(ordered) * 1e9)) // 10**9) - 1)]


def summarize(summary: RunSummary) -> dict[str, float | int | None]:
    """Count, ok, failed, latency statistics in ms, makespan and throughput of the measured queries."""
    own = [r for r in summary.records if not r.warmup]
    good = [(r.wait_ns + r.run_ns) / 1e6 for r in own if r.status == OK]
    span = sum(summary.makespans_ns) / 1e9
    mean = lambda f: f(good) if good else None
    return {"queries": len(own), "ok": len(good), "failed": len(own) - len(good), "mean_ms": mean(statistics.fmean), "median_ms": mean(statistics.median), "p95_ms": nearest_rank(good, 0.95), "min_ms": mean(min), "max_ms": mean(max), "makespan_s": span, "throughput": len(good) / span if span else None}


def summary_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """The same statistics of a table of measurements; p95 by nearest rank."""
    v = F.col(value)
    return df.groupBy(key).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.round(F.expr(f"percentile_disc(0.95) within group (order by `{value}`)"), 6).alias("p95"), F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"), F.round(F.sum(v), 4).alias("total")
    )


def workload_table(df: DataFrame, keys: Sequence[str], value: str, first: str) -> DataFrame:
    """Runs, the least `first`, mean and interpolated p95 per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.min(first).alias("first"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"))


def ratio_to_first(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean per key over the mean of the first key: speed-up or change against a base."""
    means = df.groupBy(key).agg(F.avg(value).alias("m"))
    base = means.agg(F.min_by("m", key).alias("b"))  # one row
    return means.crossJoin(base).select(key, F.round(F.col("m") / F.col("b"), 6).alias("ratio"), F.round(100 * (F.col("m") / F.col("b") - 1), 6).alias("change_percent"))


def latest_run(df: DataFrame, run: str = "run_id", status: str = "status", warmup: str = "warmup") -> DataFrame:
    """Measured, successful rows of the last run."""
    last = df.agg(F.max(run).alias("last__"))
    return df.join(F.broadcast(last), F.col(run) == F.col("last__")).drop("last__").filter((F.col(status) == "ok") & ~F.col(warmup))


def host_usage(samples: DataFrame, host: str, at: str, busy: str, total: str) -> DataFrame:
    """Least, greatest and mean CPU use per host from successive samples of running counters, in percent. A pair of
    samples counts if time went on between them and neither lacks a counter; samples without one are passed over."""
    w = Window.partitionBy(host).orderBy(at)
    whole = samples.filter(F.col(busy).isNotNull() & F.col(total).isNotNull())
    more, spent = F.col(total) - F.lag(total).over(w), F.col(busy) - F.lag(busy).over(w)
    use = whole.select(host, more.alias("more"), spent.alias("spent")).filter("more > 0")
    cpu = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("spent") / F.col("more") * 100))
    return use.select(host, cpu.alias("cpu")).groupBy(host).agg(F.round(F.min("cpu"), 6).alias("least"), F.round(F.max("cpu"), 6).alias("most"), F.round(F.avg("cpu"), 6).alias("mean"), F.count("cpu").alias("samples"))


def host_memory(samples: DataFrame, host: str, available: str, swap: str, load: str) -> DataFrame:
    """Least and mean available memory, most swap used and highest load per host; a missing value is passed over, and
    how many samples had any is told."""
    some = F.count_if(F.coalesce(available, swap, load).isNotNull())
    return samples.groupBy(host).agg(F.min(available).alias("available_least"), F.round(F.avg(available), 6).alias("available_mean"), F.max(swap).alias("swap_most"), F.max(load).alias("load_most"), F.count(F.lit(1)).alias("attempted"), some.alias("successful"))


def process_peaks(samples: DataFrame, process: str, resident: str, minor: str, major: str) -> DataFrame:
    """Greatest resident size and fault counts per process; a sample is whole if it has them all."""
    whole = F.col(resident).isNotNull() & F.col(minor).isNotNull() & F.col(major).isNotNull()
    return samples.groupBy(process).agg(F.max(resident).alias("resident_most"), F.max(minor).alias("minor_faults"), F.max(major).alias("major_faults"), F.count(F.lit(1)).alias("attempted"), F.count_if(whole).alias("successful"), F.count_if(~whole).alias("failed"))
