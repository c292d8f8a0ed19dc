"""Workload files: named title ranges."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

HEADER = ["name", "start_range", "end_range"]


@dataclass(frozen=True)
class Workload:
    name: str
    start: str
    end: str

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a workload needs a name")


def read_workloads(path: str, width: int | None = None) -> list[Workload]:
    """Exact header, three fields a line, blank lines skipped, an unclosed quote is an error."""
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    if not lines or next(csv.reader([lines[0]]), None) != HEADER:
        raise ValueError(f"the header must be {','.join(HEADER)}")
    out = []
    for n, line in enumerate(lines[1:], 2):
        if not line.strip():
            continue
        try:
            (fields,) = csv.reader(io.StringIO(line), strict=True)
        except (csv.Error, ValueError) as e:
            raise ValueError(f"line {n}: {e}") from None
        if len(fields) != 3:
            raise ValueError(f"line {n}: {len(fields)} fields, not 3")
        check_bounds(fields[1], fields[2], width)
        out.append(Workload(*fields))
    return out


def check_bounds(start: str, end: str, width: int | None) -> None:
    for bound in (start, end):
        if width is not None and len(bound.encode()) > width:
            raise ValueError(f"bound exceeds {width} UTF-8 bytes: {len(bound.encode())}")
