"""python -m stratum.cli: prepare, pre-process, run-query, bench, bench-processes."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from .operators.layout import block_pages
from .plans.credits import credits_in_range
from .plans.engine import Config, benchmark, summarize
from .plans.processes import ProcessConfig, run_groups
from .schema import MOVIES, PEOPLE, WORKEDON
from .sources.catalog import Catalog
from .sources.delimited import read_csv, read_dump
from .sources.sinks import append_json, append_rows, metrics_line, write_csv, write_results
from .sources.workload import check_bounds, read_workloads

# The dumps, the relations that they give, their files, and the source column of each field.
DUMPS = (
    ("title.basics.tsv.gz", MOVIES, "title.csv", {"movieId": "tconst", "title": "primaryTitle"}),
    ("title.principals.tsv.gz", WORKEDON, "workedon.csv", {"movieId": "tconst", "personId": "nconst", "category": "category"}),
    ("name.basics.tsv.gz", PEOPLE, "name.csv", {"personId": "nconst", "name": "primaryName"}),
)


class Once(argparse.Action):
    """A flag that may be given once."""

    def __call__(self, parser, namespace, values, option=None):
        if option in (seen := vars(namespace).setdefault("_seen", set())):
            parser.error(f"{option} is given twice")
        seen.add(option)
        setattr(namespace, self.dest, True if self.nargs == 0 else values)


def catalog(root: str) -> Catalog:
    c = Catalog(root)
    for relation in (MOVIES, WORKEDON, PEOPLE):
        c.add_table(relation)
    c.add_index("movies", "title")
    return c


def prepare(spark: SparkSession, source: str, output: str) -> None:
    """Local dumps to CSV folders; an old folder stays if its dump is at fault. Dumps are not fetched."""
    for dump, relation, name, columns in DUMPS:
        write_csv(read_dump(spark, f"{source}/{dump}", relation, columns), f"{output}/{name}")
        print(f"{name}: {spark.read.option('header', True).csv(f'{output}/{name}').count():,} rows")


def pre_process(spark: SparkSession, source: str, root: str, strict: bool) -> None:
    c = catalog(root)
    for _, relation, name, _ in DUMPS:
        loaded = read_csv(spark, f"{source}/{name}", relation, strict)
        c.store(loaded.rows, relation.name)
        for line in loaded.report():
            print(f"{name}: {line}", file=sys.stderr)
    c.store_index(spark, "movies", "title")


def plan_of(spark: SparkSession, root: str, indexed: bool):
    c = catalog(root)
    movies = c.index(spark, "movies", "title") if indexed else c.table(spark, "movies")
    return lambda start, end: credits_in_range(movies, c.table(spark, "workedon"), c.table(spark, "people"), start, end, indexed=indexed)


def process_metrics(spark: SparkSession) -> dict[str, int]:
    """Heap and CPU of the driver's JVM; CPU of -1 where it is not told."""
    beans = spark._jvm.java.lang.management.ManagementFactory
    heap = beans.getMemoryMXBean().getHeapMemoryUsage()
    peak = sum(p.getPeakUsage().getUsed() for p in beans.getMemoryPoolMXBeans() if p.getType().name() == "HEAP" and p.getPeakUsage())
    spent = spark._jvm.java.lang.ProcessHandle.current().info().totalCpuDuration()
    return {"heap_used_bytes": heap.getUsed(), "heap_committed_bytes": heap.getCommitted(), "heap_pool_peak_sum_bytes": peak, "cpu_ns": spent.get().toNanos() if spent.isPresent() else -1}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("stratum", allow_abbrev=False)
    sub = p.add_subparsers(dest="command", required=True)
    commands = {n: sub.add_parser(n, allow_abbrev=False) for n in ("prepare", "pre-process", "run-query", "bench", "bench-processes")}
    flag = lambda n, *names: [commands[n].add_argument(x, action=Once, nargs=0, default=False) for x in names]
    need = lambda n, kind, *names: [commands[n].add_argument(x, action=Once, type=kind, required=True) for x in names]
    need("prepare", str, "--source-dir", "--output-dir")
    need("pre-process", str, "--source")
    flag("pre-process", "--strict")
    for name, kind in (("start", str), ("end", str), ("buffer", int)):
        commands["run-query"].add_argument(name, type=kind)
    need("run-query", str, "--output")
    flag("run-query", "--index", "--metrics", "--single-file")
    need("bench", int, "--buffer-size", "--max-concurrent", "--clients", "--repetitions", "--warmups")
    need("bench-processes", str, "--concurrency")
    need("bench-processes", int, "--buffer-size", "--repetitions", "--warmups")
    for n in ("bench", "bench-processes"):
        need(n, str, "--workload", "--output-dir")
        flag(n, "--index")
    for n in ("pre-process", "run-query", "bench", "bench-processes"):
        commands[n].add_argument("--root", action=Once, default="data/tables")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "run-query":
        check_bounds(args.start, args.end, MOVIES.width("title"))
        block_pages(args.buffer)
    if args.command == "bench-processes":
        config = ProcessConfig(tuple(map(int, args.concurrency.split(","))), args.repetitions, args.warmups, args.buffer_size, os.path.abspath(args.root), args.index)
        rows, groups = run_groups(read_workloads(args.workload, MOVIES.width("title")), config)
        os.makedirs(args.output_dir, exist_ok=True)
        append_rows(f"{args.output_dir}/processes.csv", rows)
        append_rows(f"{args.output_dir}/summary.csv", groups)
        append_json(f"{args.output_dir}/runs.jsonl", vars(config) | {"groups": groups})
        return 0 if all(r["status"] == "ok" for r in rows) else 1
    spark = SparkSession.builder.config("spark.scheduler.mode", "FAIR").getOrCreate()
    if args.command == "prepare":
        prepare(spark, args.source_dir, args.output_dir)
    elif args.command == "pre-process":
        pre_process(spark, args.source, args.root, args.strict)
    elif args.command == "run-query":
        began = time.perf_counter_ns()
        rows = write_results(plan_of(spark, args.root, args.index)(args.start, args.end), args.output, single=args.single_file)
        if args.metrics:
            print(metrics_line(elapsed_ns=time.perf_counter_ns() - began, result_count=rows, **process_metrics(spark)), file=sys.stderr)
    else:
        config = Config(args.buffer_size, args.max_concurrent, args.clients, args.repetitions, args.warmups)
        summary = benchmark(spark, plan_of(spark, args.root, args.index), read_workloads(args.workload, MOVIES.width("title")), config)
        print("\n".join(summary.lines()))
        os.makedirs(args.output_dir, exist_ok=True)
        append_rows(f"{args.output_dir}/queries.csv", [vars(r) for r in summary.records])
        append_json(f"{args.output_dir}/runs.jsonl", summarize(summary))
        return 0 if summary.success else 1
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        sys.exit(1)
