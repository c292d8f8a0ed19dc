"""Query traces: a validated model of the trace document, events as a table, and replay to a cursor.

A document has the run, its counters, the plan as a tree, the relations by name and the ordered events. Events are a
DataFrame of EVENT_SCHEMA, of any number; only `to_json` of a document that carries its events holds them in memory.
The order of events is `seq`; `timeMs` is pacing only.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.layout import with_rank
from ..sources.scratch import stored

VERSION, COMMAND = 1, "run_query"
# The wire names of the event types, of the plan nodes, of join sides and of tree nodes.
EVENT_TYPES = (
    "operator.open", "operator.next", "operator.emit", "operator.close",
    "buffer.hit", "buffer.miss", "buffer.page_load", "buffer.evict", "buffer.pin", "buffer.unpin", "buffer.flush",
    "scan.page_begin", "scan.page_end",
    "filter.pass", "filter.reject",
    "bnl.block_begin", "bnl.block_end", "bnl.hash_build", "bnl.probe", "bnl.match",
    "btree.search_begin", "btree.node_visit", "btree.range_leaf_begin", "btree.range_emit", "btree.search_end",
    "query.result", "query.complete",
)
NODE_TYPES = ("PROJECT", "BNL_JOIN", "SELECTION", "SCAN", "INDEX_SCAN", "MATERIALIZE")
JOIN_SIDES, TREE_NODES = ("LEFT", "RIGHT"), ("INTERNAL", "LEAF")
# The fields of an event.
_PAGE = "struct<fileId:string,pageId:int>"
EVENT_SCHEMA = (
    "trace string, seq long, timeMs long, type string, operatorId string, "
    f"page {_PAGE}, frame struct<frameId:int,dirty:boolean,pinCount:int,evictedPage:{_PAGE}>, recordId struct<pageId:int,slotId:int>, "
    "join struct<blockId:int,side:string,key:string,matches:int>, "
    "btree struct<indexFileId:string,nodePageId:int,nodeType:string,key:string,rangeStart:string,rangeEnd:string>, "
    "result struct<ordinal:long,fields:map<string,string>>, message string"
)


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class TraceRun:
    id: str
    start: str
    end: str
    buffer_size: int
    indexed: bool = False
    started_at: str = "1970-01-01T00:00:00+00:00"
    wall_clock_ms: int = 0
    command: str = COMMAND

    def __post_init__(self):
        _check(bool(self.id.strip()), "a run needs an id")
        _check(bool(self.command.strip()), "a run needs a command")
        _check(self.buffer_size >= 1, "the buffer needs a frame")
        _check(self.wall_clock_ms >= 0, "a run's time must not be negative")
        dt.datetime.fromisoformat(self.started_at)

    def document(self) -> dict:
        return {"id": self.id, "command": self.command, "startedAt": self.started_at, "range": {"start": self.start, "end": self.end}, "bufferSize": self.buffer_size, "indexed": self.indexed, "wallClockMs": self.wall_clock_ms}

    @classmethod
    def of(cls, d: dict) -> TraceRun:
        return cls(d["id"], d["range"]["start"], d["range"]["end"], d["bufferSize"], d["indexed"], d["startedAt"], d["wallClockMs"], d["command"])


@dataclass(frozen=True)
class TraceSummary:
    """Counters under the document's own names."""

    pagesRead: int = 0
    bufferHits: int = 0
    bufferMisses: int = 0
    evictions: int = 0
    recordsExamined: int = 0
    recordsEmitted: int = 0
    operatorNextCalls: int = 0
    btreeNodeVisits: int = 0

    def __post_init__(self):
        _check(min(asdict(self).values()) >= 0, "counts must not be negative")


@dataclass(frozen=True)
class TraceTable:
    file_id: str
    record_size: int
    record_count: int | None = None

    def __post_init__(self):
        _check(bool(self.file_id.strip()), "a table needs a file")
        _check(self.record_size >= 1, "a record needs a byte")
        _check(self.record_count is None or self.record_count >= 0, "counts must not be negative")


@dataclass(frozen=True)
class PlanNode:
    id: str
    type: str
    label: str
    detail: str | None = None
    children: tuple[PlanNode, ...] = ()

    def __post_init__(self):
        _check(bool(self.id.strip()) and bool(self.label.strip()), "a plan node needs an id and a label")
        _check(self.type in NODE_TYPES, f"unknown plan node type: {self.type}")

    def document(self) -> dict:
        return {"id": self.id, "type": self.type, "label": self.label, "detail": self.detail, "children": [c.document() for c in self.children]}

    @classmethod
    def of(cls, d: dict) -> PlanNode:
        return cls(d["id"], d["type"], d["label"], d.get("detail"), tuple(cls.of(c) for c in d.get("children") or ()))

    def rows(self, parent: str | None = None) -> list[tuple[str, str | None, str, str, str | None]]:
        """(id, parent, type, label, detail) of the tree, for a table."""
        return [(self.id, parent, self.type, self.label, self.detail), *(r for c in self.children for r in c.rows(self.id))]


@dataclass(frozen=True)
class QueryTrace:
    run: TraceRun
    summary: TraceSummary
    plan: PlanNode
    tables: dict[str, TraceTable] = field(default_factory=dict)
    events: tuple[dict, ...] = ()
    schema_version: int = VERSION

    def __post_init__(self):
        _check(self.schema_version == VERSION, f"unknown schema version: {self.schema_version}")
        for e in self.events:
            _check(e.get("type") in EVENT_TYPES, f"unknown event type: {e.get('type')}")
            _check(min(e["seq"], e["timeMs"]) >= 0, "an event's place and time must not be negative")

    def to_json(self) -> str:
        tables = {n: {"fileId": t.file_id, "recordSize": t.record_size, "recordCount": t.record_count} for n, t in self.tables.items()}
        return json.dumps({"schemaVersion": self.schema_version, "run": self.run.document(), "summary": asdict(self.summary), "plan": self.plan.document(), "tables": tables, "events": list(self.events)})

    @classmethod
    def from_json(cls, text: str) -> QueryTrace:
        d = json.loads(text)
        tables = {n: TraceTable(t["fileId"], t["recordSize"], t.get("recordCount")) for n, t in d["tables"].items()}
        return cls(TraceRun.of(d["run"]), TraceSummary(**d["summary"]), PlanNode.of(d["plan"]), tables, tuple(d["events"]), d["schemaVersion"])


def credits_plan(start: str, end: str, category: str, indexed: bool) -> PlanNode:
    """The logical steps of the three-table query. How Spark ran them is in its own plan."""
    scan = PlanNode("movies", "INDEX_SCAN", "movies by title", f"{start}..{end}") if indexed else PlanNode("range", "SELECTION", "title in range", f"{start}..{end}", (PlanNode("movies", "SCAN", "movies"),))
    directed = PlanNode("category", "SELECTION", "category", category, (PlanNode("workedon", "SCAN", "workedon"),))
    credits = PlanNode("credits", "MATERIALIZE", "movieId, personId", None, (directed,))
    first = PlanNode("join1", "BNL_JOIN", "movieId", None, (scan, credits))
    second = PlanNode("join2", "BNL_JOIN", "personId", None, (first, PlanNode("people", "SCAN", "people")))
    return PlanNode("root", "PROJECT", "title, name", None, (second,))


def result_events(df: DataFrame, trace: str, time_ms: int = 0) -> DataFrame:
    """A query.result event per row of `df`, in the rows' own order, numbered without a task that sees them all."""
    ranked = with_rank(df, [], "ordinal__")
    fields = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))
    own = {"trace": F.lit(trace), "seq": F.col("ordinal__") + 1, "timeMs": F.lit(time_ms), "type": F.lit("query.result"), "operatorId": F.lit("root"), "result": F.struct(F.col("ordinal__").alias("ordinal"), fields.alias("fields"))}
    return _as_events(ranked, own)


def _as_events(df: DataFrame, own: dict[str, Column]) -> DataFrame:
    shape = df.sparkSession.createDataFrame([], EVENT_SCHEMA).schema
    return df.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


def trace_query(df: DataFrame, run: TraceRun, plan: PlanNode, tables: dict[str, TraceTable]) -> tuple[QueryTrace, DataFrame]:
    """Run a query once and trace what Spark tells: its rows, as stored events of any number, and the time. No page
    events: Spark has no pages. The document comes without events; `with_events` adds them."""
    spark, at, began = df.sparkSession, dt.datetime.now(dt.UTC), time.perf_counter()
    results = stored(result_events(df, run.id), "trace")
    rows = results.count()
    spent = int((time.perf_counter() - began) * 1000)
    ends = spark.createDataFrame([(0, 0, "operator.open"), (rows + 1, spent, "query.complete")], "seq long, timeMs long, type string")
    events = results.unionByName(_as_events(ends, {"trace": F.lit(run.id), "seq": F.col("seq"), "timeMs": F.col("timeMs"), "type": F.col("type"), "operatorId": F.lit("root")}))
    done = TraceRun(run.id, run.start, run.end, run.buffer_size, run.indexed, at.isoformat(), spent, run.command)
    return QueryTrace(done, TraceSummary(recordsEmitted=rows), plan, tables), events


def with_events(trace: QueryTrace, events: DataFrame) -> QueryTrace:
    """The document with its events, in memory: for a replay, not for a large result."""
    rows = events.filter(F.col("trace") == trace.run.id).drop("trace").orderBy("seq").toJSON().collect()
    return QueryTrace(trace.run, trace.summary, trace.plan, trace.tables, tuple(map(json.loads, rows)))


def new_run_id() -> str:
    return f"run-{uuid.uuid4().hex[:12]}"


def valid_events(events: DataFrame) -> DataFrame:
    """Events that keep the rules: a known type, a place and a time, no negative number, no blank file, known sides."""
    whole = lambda c: F.coalesce(F.col(c) >= 0, F.lit(True))
    named = lambda page: F.coalesce(F.trim(F.col(f"{page}.fileId")) != "", F.col(page).isNull())
    keep = F.col("type").isin(*EVENT_TYPES) & (F.col("seq") >= 0) & (F.col("timeMs") >= 0)
    for number in ("page.pageId", "frame.frameId", "frame.pinCount", "frame.evictedPage.pageId", "recordId.pageId", "recordId.slotId", "join.blockId", "join.matches", "btree.nodePageId", "result.ordinal"):
        keep = keep & whole(number)
    keep = keep & named("page") & named("frame.evictedPage")
    keep = keep & F.coalesce(F.col("join.side").isin(*JOIN_SIDES), F.lit(True)) & F.coalesce(F.col("btree.nodeType").isin(*TREE_NODES), F.lit(True))
    return events.filter(F.coalesce(keep, F.lit(False)))


def _upto(events: DataFrame, cursor: int | None) -> DataFrame:
    return events if cursor is None else events.filter(F.col("seq") <= cursor)


def replay_counters(events: DataFrame, cursor: int | None = None, trace: str = "trace") -> DataFrame:
    """Counters and marks of each trace at a cursor (its last event if beyond): a page is read with each miss; a result
    event without a result does not count; the active operator is the last one named."""
    times = lambda when: F.count_if(when).alias
    kind = F.col("type")
    last = F.max_by(F.struct("type", "frame"), "seq")
    touched = F.when(F.col("last.type").isin("buffer.hit", "buffer.page_load"), F.col("last.frame.frameId"))
    evicting = F.when(F.col("last.type") == "buffer.evict", F.col("last.frame.frameId"))
    at = _upto(events, cursor).groupBy(trace).agg(
        times(kind == "buffer.miss")("pagesRead"),
        times(kind == "buffer.hit")("bufferHits"),
        times(kind == "buffer.miss")("bufferMisses"),
        times(kind == "buffer.evict")("evictions"),
        times((kind == "query.result") & F.col("result").isNotNull())("recordsEmitted"),
        times(kind == "btree.node_visit")("btreeNodeVisits"),
        F.max("seq").alias("seq"),
        F.max_by("operatorId", F.when(F.coalesce(F.col("operatorId"), F.lit("")) != "", F.col("seq"))).alias("activeOperatorId"),
        last.alias("last"),
    )
    return at.withColumn("touchedFrameId", touched).withColumn("evictingFrameId", evicting).drop("last")


def replay_frames(events: DataFrame, cursor: int | None = None, trace: str = "trace") -> DataFrame:
    """What each frame holds at a cursor: the page of its last load; nothing after an eviction."""
    loads = (F.col("type") == "buffer.page_load") & F.col("page").isNotNull()
    changes = _upto(events, cursor).filter(F.col("frame").isNotNull() & (loads | (F.col("type") == "buffer.evict")))
    last = changes.groupBy(trace, F.col("frame.frameId").alias("frameId")).agg(F.max_by(F.struct("type", "page", "frame"), "seq").alias("e"))
    return last.filter("e.type = 'buffer.page_load'").select(trace, "frameId", "e.page.fileId", "e.page.pageId", "e.frame.pinCount", "e.frame.dirty")


def replay_results(events: DataFrame, cursor: int | None = None, trace: str = "trace") -> DataFrame:
    """The rows emitted up to a cursor, by seq; a missing field is empty."""
    own = _upto(events, cursor).filter((F.col("type") == "query.result") & F.col("result").isNotNull())
    return own.select(trace, "seq", *[F.coalesce(F.try_element_at("result.fields", F.lit(n)), F.lit("")).alias(n) for n in ("title", "name")])


def running_counts(events: DataFrame, trace: str, seq: str, kind: str, names: dict[str, str]) -> DataFrame:
    """Of every event the counts so far in its trace: `names` gives a counter's name by event type."""
    w = Window.partitionBy(trace).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return events.select(trace, seq, *[F.sum(F.when(F.col(kind) == k, 1).otherwise(0)).over(w).cast("bigint").alias(n) for k, n in names.items()])
