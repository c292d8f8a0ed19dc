"""A benchmark of isolated processes: each query is a run of the command line in a process of its own."""

from __future__ import annotations

import datetime as dt
import subprocess
import sys
import tempfile
import threading
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from ..sources.sinks import parse_metrics
from ..sources.workload import Workload


@dataclass(frozen=True)
class ProcessConfig:
    concurrency: tuple[int, ...]
    repetitions: int
    warmups: int
    buffer_size: int
    root: str
    indexed: bool = False
    sample_ms: int = 50

    def __post_init__(self):
        if not self.concurrency or min(self.concurrency) < 1 or self.repetitions < 1 or self.warmups < 0 or self.buffer_size < 3 or self.sample_ms < 1:
            raise ValueError("concurrency, repetitions and sampling must be positive, warm-ups not negative, the buffer at least 3")


def _resident(pid: int) -> int | None:
    """Resident bytes of a process and its children's, where the system tells."""
    try:
        import psutil

        p = psutil.Process(pid)
        return sum(q.memory_info().rss for q in [p, *p.children(recursive=True)])
    except Exception:  # the process may be gone
        return None


def run_process(w: Workload, config: ProcessConfig) -> dict:
    """One workload in its own process: exit, wall time, its own metrics and the peak of its memory."""
    with tempfile.TemporaryDirectory(prefix="stratum-process-") as folder:
        command = [sys.executable, "-m", "stratum.cli", "run-query", w.start, w.end, str(config.buffer_size), "--root", config.root, "--output", f"{folder}/result", "--metrics", *["--index"] * config.indexed]
        started, began, peak = dt.datetime.now(dt.UTC).isoformat(), time.perf_counter_ns(), 0
        with subprocess.Popen(command, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True) as p:
            said: list[str] = []
            reader = threading.Thread(target=lambda: said.append(p.stderr.read()))
            reader.start()
            while p.poll() is None:
                peak = max(peak, _resident(p.pid) or 0)
                time.sleep(config.sample_ms / 1000)
            reader.join()
        wall = time.perf_counter_ns() - began
        text = "".join(said)
        metrics = next((m for line in text.splitlines() if (m := parse_metrics(line))), None)
        good = p.returncode == 0 and metrics is not None
        own = metrics or {}
        cpu = own.get("cpu_ns", -1)
        return {
            "started_at": started, "workload": w.name, "start_range": w.start, "end_range": w.end, "buffer_size": config.buffer_size, "use_index": config.indexed,
            "status": "ok" if good else "failed", "exit_code": p.returncode, "query_ms": own["elapsed_ns"] / 1e6 if "elapsed_ns" in own else None, "wall_ms": wall / 1e6,
            "cpu_ms": cpu / 1e6 if cpu >= 0 else None, "result_count": own.get("result_count"), "peak_bytes": peak or None, "error": "" if good else " | ".join(text.strip().splitlines()[-5:]),
        }


def run_groups(workloads: Sequence[Workload], config: ProcessConfig) -> tuple[list[dict], list[dict]]:
    """(a row per process, a row per group): every workload and repetition at each concurrency, warm-ups before."""
    rows, groups = [], []
    for workers in config.concurrency:
        for warmup, repetitions in ((True, config.warmups), (False, config.repetitions)):
            tasks = [(w, k) for k in range(1, repetitions + 1) for w in workloads]
            began = time.perf_counter()
            with ThreadPoolExecutor(workers) as pool:
                done = list(pool.map(lambda t: run_process(t[0], config) | {"repetition": t[1]}, tasks))
            span = time.perf_counter() - began
            rows += [r | {"concurrency": workers, "warmup": warmup} for r in done]
            if not warmup:
                good = sum(r["status"] == "ok" for r in done)
                groups.append({"concurrency": workers, "queries": len(done), "ok": good, "failed": len(done) - good, "makespan_s": span, "throughput": good / span})
    return rows, groups
