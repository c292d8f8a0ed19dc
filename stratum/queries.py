"""Queries over the test tables, one or more per operator, and their SQL for DuckDB.

The relations of the three-table query are mapped: movies from part, credits from lineitem, people from supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codec import fits_width, from_fixed, mebibytes, nanos_to_millis, null_marker, sort_key, to_fixed
from .operators.layout import block_pages, lru_simulation, page_count, record_ids, selectivity_bounds
from .operators.relational import build_index, equi_join, index_range, index_search, materialized, multiset_difference, open_index, preview, project, select_equal, select_range
from .plans.credits import credits_in_range
from .plans.engine import host_memory, host_usage, latest_run, process_peaks, ratio_to_first, summary_by, workload_table
from .plans.trace import EVENT_SCHEMA, EVENT_TYPES, TraceRun, credits_plan, replay_counters, replay_frames, replay_results, running_counts, trace_query, valid_events
from .schema import PEOPLE, Relation
from .sources.delimited import read_csv, read_dump
from .sources.scratch import scratch_path, stored
from .sources.sinks import append_frame, metrics_column, result_lines, sorted_rows, write_csv, write_results

WIDTH = 482


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def movies(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"))


def workedon(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("movieId"), F.col("l_suppkey").alias("personId"), F.col("l_returnflag").alias("category"))


def people(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("personId"), F.col("s_name").alias("name"))


_indexes: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, d: str, field: str = "title", order: str = "signed") -> DataFrame:
    """The copy sorted by a field in the shared folder: built once per application and table, removed when it exits."""
    key = (spark.sparkContext.applicationId, d, field)
    if key not in _indexes:
        path = scratch_path(spark, f"{field}-index")
        build_index(movies(spark, d), field, WIDTH, path, order=order)
        _indexes[key] = path
    return open_index(spark, _indexes[key], field)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return credits_in_range(movies(spark, d), workedon(spark, d), people(spark, d), "large", "medium", "R", WIDTH)


def flagship_binary(spark, d):
    return credits_in_range(movies(spark, d), workedon(spark, d), people(spark, d), "large", "medium", "R", WIDTH, order="binary")


def flagship_indexed(spark, d):
    return credits_in_range(_index(spark, d), workedon(spark, d), people(spark, d), "large", "medium", "R", WIDTH, indexed=True)


def flagship_ordered(spark, d):
    return sorted_rows(flagship(spark, d))


def scan_full(spark, d):
    return _t(spark, d, "part").select("p_partkey", "p_name")


def q_select_range(spark, d):
    return select_range(scan_full(spark, d), "p_name", "large", "medium", WIDTH)


def select_range_signed(spark, d):
    docs = _t(spark, d, "documents").filter(fits_width(F.col("text"), WIDTH))
    return docs.filter(sort_key(F.col("text"), WIDTH) <= sort_key(F.lit("Mz"), WIDTH)).select("doc_id")


def q_select_equal(spark, d):
    return select_equal(_t(spark, d, "lineitem"), "l_returnflag", "R").select("l_orderkey", "l_linenumber")


def project_pipelined(spark, d):
    return project(select_equal(_t(spark, d, "lineitem"), "l_returnflag", "R"), ["l_partkey", "l_suppkey"])


def project_materialized(spark, d):
    path = scratch_path(spark, "projection")
    with materialized(project_pipelined(spark, d)) as held:  # read twice, removed after the block
        held.select("*", F.lit(held.count()).cast("bigint").alias("total")).write.parquet(path)
    return spark.read.parquet(path)


def join_inner(spark, d):
    return equi_join(movies(spark, d), workedon(spark, d), "movieId", "movieId", ["movieId", "title", "personId"])


def join_empty_string_key(spark, d):
    left = movies(spark, d).select(F.when(F.col("movieId") % 500 == 0, "").otherwise(F.col("movieId").cast("string")).alias("k"), "title")
    right = people(spark, d).select(F.when(F.col("personId") % 50 == 0, "").otherwise(F.col("personId").cast("string")).alias("k"), "name")
    return equi_join(left, right, "k", "k", ["k", "title", "name"])


def index_exact(spark, d):
    ix = _index(spark, d)
    return index_search(ix, "title", movies(spark, d).agg(F.min("title")).first()[0], WIDTH)


def q_index_range(spark, d):
    return index_range(_index(spark, d), "title", "large", "medium", WIDTH, ordered=True)


def index_range_numeric(spark, d):
    hits = index_range(_index(spark, d, "movieId", "binary"), "movieId", 10, 60, WIDTH, order="binary")
    return hits.select(F.col("movieId").alias("p_partkey"), F.col("title").alias("p_name"))


def index_duplicate_start(spark, d):
    """From the most repeated title on: all its copies belong to the result."""
    titles = movies(spark, d).groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    start = titles.orderBy(F.desc("n"), "title").first()["title"]
    return index_range(_index(spark, d), "title", start, start + "~", WIDTH)


def width_accept(spark, d):
    return _t(spark, d, "documents").filter(fits_width(F.col("text"), WIDTH)).select("doc_id")


def width_reject(spark, d):
    return _t(spark, d, "documents").filter(~fits_width(F.col("text"), WIDTH)).select("doc_id", F.octet_length("text").alias("needed"))


def q_null_marker(spark, d):
    marked = _t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "\\N").otherwise(F.col("s_name")).alias("x"))
    return marked.select("s_suppkey", null_marker(F.col("x")).alias("x"))


def fixed_roundtrip(spark, d):
    short = _t(spark, d, "documents").filter(fits_width(F.col("text"), WIDTH))
    return short.select("doc_id", from_fixed(to_fixed(F.col("text"), WIDTH)).alias("text"))


def q_result_lines(spark, d):
    return result_lines(flagship(spark, d))


def result_count(spark, d):
    return flagship(spark, d).agg(F.count(F.lit(1)).alias("n"))


def bench_summary(spark, d):
    return summary_by(_t(spark, d, "events"), "event_type", "value")


def workload_summary(spark, d):
    return workload_table(_t(spark, d, "events"), ["event_type"], "value", "event_id")


def speedup_vs_base(spark, d):
    return ratio_to_first(_t(spark, d, "events"), "event_type", "value")


def replay(spark, d):
    return running_counts(_t(spark, d, "events"), "user_id", "event_id", "event_type", {"click": "clicks", "view": "views", "purchase": "purchases"})


def q_record_ids(spark, d):
    return record_ids(scan_full(spark, d), ["p_partkey"], 8)


def _costs(spark, d, movie_rows, join_rows):
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    n = one(movies(spark, d), "m").crossJoin(one(workedon(spark, d), "w")).crossJoin(one(people(spark, d), "p"))  # one row each
    n = n.crossJoin(one(select_equal(workedon(spark, d), "category", "R"), "c")).crossJoin(one(flagship(spark, d), "r"))
    blocks = spark.createDataFrame([(b, block_pages(b)) for b in (20, 50, 100)], "b long, n long")
    pages = n.select(page_count(F.col("m"), movie_rows).alias("pm"), page_count(F.col("w"), 102).alias("pw"), page_count(F.col("p"), 35).alias("pp"), page_count(F.col("c"), 204).alias("pc"), "r")
    io = F.col("pw") + F.col("pc") + F.col("pm") + F.ceil(F.col("r") / (F.col("n") * movie_rows)) * F.col("pc") + F.ceil(F.col("r") / (F.col("n") * join_rows)) * F.col("pp")
    return pages.crossJoin(F.broadcast(blocks)).select("b", io.cast("bigint").alias("io"))


def io_cost_model(spark, d):
    return _costs(spark, d, 104, 83)


def io_cost_model_wide(spark, d):
    return _costs(spark, d, 8, 8)


def q_selectivity_bounds(spark, d):
    return selectivity_bounds(scan_full(spark, d), "p_name", [0.001, 0.01, 0.05, 0.1, 0.2, 0.5])


def q_lru_simulation(spark, d):
    return lru_simulation(_t(spark, d, "events"), "event_type", "event_id", "user_id", [20, 50, 100])


def multiset_diff(spark, d):
    return multiset_difference(flagship(spark, d), flagship_indexed(spark, d))


def multiset_diff_unequal(spark, d):
    """Inputs that differ in both directions, and in how often rows are repeated."""
    names = _t(spark, d, "part").select("p_partkey", "p_name")
    left = names.filter("p_partkey % 3 != 0").select("p_name").unionByName(names.filter("p_partkey % 7 = 0").select("p_name"))
    return multiset_difference(left, names.filter("p_partkey % 5 != 0").select("p_name"))


INGEST = Relation.of("ingest", movieId=10, title=30, note=20)


def _csv(spark, d, single: bool = False) -> str:
    """A folder of CSV files of parts, with quotes and commas; of every 40th the title is too wide."""
    wide = F.when(F.col("p_partkey") % 40 == 0, F.concat("p_name", F.lit(' - a "long", long title of 31 bytes'))).otherwise(F.concat("p_name", F.lit(', "x"')))
    rows = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("movieId"), F.when(F.octet_length(F.col("p_name")) > 20, F.col("p_name")).otherwise(wide).alias("title"))
    path = scratch_path(spark, "csv")
    write_csv(rows.orderBy(F.col("movieId").cast("long")).coalesce(1) if single else rows, path)
    return path


def csv_ingest(spark, d):
    return read_csv(spark, _csv(spark, d), INGEST).rows


def csv_ingest_strict(spark, d):
    return read_csv(spark, _csv(spark, d), INGEST, strict=True).rows


def _rejects(spark, d, strict):
    return read_csv(spark, _csv(spark, d, single=True), INGEST, strict).rejects.select(F.col("line").cast("bigint").alias("line"), "field", "needed", "allowed")


def csv_rejects(spark, d):
    return _rejects(spark, d, False)


def csv_rejects_strict(spark, d):
    return _rejects(spark, d, True)


def dump_ingest(spark, d):
    """A tab-separated dump, gzipped, with quotes and markers of missing values."""
    rows = _t(spark, d, "supplier").select(F.lit("x").alias("other"), F.concat(F.lit("nm"), "s_suppkey").alias("nconst"), F.when(F.col("s_suppkey") % 4 == 0, "\\N").otherwise(F.concat(F.lit('"'), "s_name")).alias("primaryName"))
    path = scratch_path(spark, "dump")
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("compression", "gzip").csv(path)
    return read_dump(spark, path, PEOPLE, {"personId": "nconst", "name": "primaryName"})


def result_sink(spark, d):
    """Lines written and read back, with the count that the sink told."""
    path = scratch_path(spark, "result")
    rows = write_results(flagship(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"), F.lit(rows).cast("bigint").alias("told"))


def appended_frames(spark, d):
    """Two appends of different columns, read under one header."""
    path, nation = scratch_path(spark, "log"), _t(spark, d, "nation")
    append_frame(nation.select("n_nationkey", "n_name"), path)
    return append_frame(nation.select((F.col("n_nationkey") + 100).cast(nation.schema["n_nationkey"].dataType).alias("n_nationkey"), "n_regionkey"), path)


def metrics_lines(spark, d):
    e = _t(spark, d, "events")
    tail = F.when(F.col("event_id") % 10 == 0, " x=1.5").when(F.col("event_id") % 10 == 1, "").otherwise(F.concat(F.lit(" k="), F.col("event_id")))
    line = F.concat(F.when(F.col("event_id") % 10 == 2, "OTHER").otherwise("STRATUM_METRICS"), F.lit(" rows="), F.col("user_id"), tail)
    return e.select("event_id", line.alias("line")).select("event_id", metrics_column(F.col("line"), "rows").alias("rows"), metrics_column(F.col("line"), "k").alias("k"))


def unit_conversions(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", F.round(nanos_to_millis(F.col("user_id") * 1000 - 50000), 6).alias("ms"), F.round(mebibytes(F.col("event_id") * 4096), 6).alias("mib"))


def q_latest_run(spark, d):
    runs = _t(spark, d, "events").select("event_id", F.expr("user_id % 7").alias("run_id"), F.when(F.col("event_type") == "click", "failed").otherwise("ok").alias("status"), (F.col("event_id") % 5 == 0).alias("warmup"))
    return latest_run(runs).select("event_id", "run_id")


def frame_budgets(spark, d):
    from .plans.engine import frame_budget

    rows = [(p, c, frame_budget(p, c)) for p in range(3, 60) for c in range(1, 9) if p // c >= 3]
    return spark.createDataFrame(rows, "pool long, concurrent long, budget long")


def _samples(spark, d):
    """Host samples made of events: running counters with gaps, and values that may be missing."""
    missing = lambda c, k: F.when(F.col("event_id") % 11 != k, c)
    e = _t(spark, d, "events")
    return e.select("event_type", "event_id", missing(F.expr("event_id div 3 + user_id % 5"), 3).alias("busy"), missing(F.col("event_id"), 3).alias("total"), missing(F.col("user_id"), 4).alias("available"), missing(F.expr("user_id % 13"), 5).alias("swap"), missing(F.round("value", 3), 6).alias("load"))


def host_cpu(spark, d):
    return host_usage(_samples(spark, d), "event_type", "event_id", "busy", "total")


def q_host_memory(spark, d):
    return host_memory(_samples(spark, d), "event_type", "available", "swap", "load")


def q_process_peaks(spark, d):
    return process_peaks(_samples(spark, d), "event_type", "available", "swap", "busy")


def trace_events(spark, d):
    """A stored table of trace events of all types, made of the events table: a trace per event type."""
    types = F.array(*map(F.lit, EVENT_TYPES))
    kind = F.element_at(types, (F.col("event_id") % len(EVENT_TYPES) + 1).cast("int"))
    page = F.struct(F.col("event_type").alias("fileId"), F.col("user_id").cast("int").alias("pageId"))
    frame = F.struct((F.col("user_id") % 20).cast("int").alias("frameId"), F.lit(False).alias("dirty"), F.lit(1).alias("pinCount"), F.lit(None).cast("struct<fileId:string,pageId:int>").alias("evictedPage"))
    result = F.when((F.col("type") == "query.result") & (F.col("event_id") % 2 == 0), F.struct(F.col("event_id").alias("ordinal"), F.map_from_arrays(F.array(F.lit("title")), F.array(F.col("event_type"))).alias("fields")))
    e = _t(spark, d, "events").withColumn("type", kind)
    wanted = {"trace": F.col("event_type"), "seq": F.col("event_id"), "timeMs": F.col("event_id"), "type": F.col("type"), "operatorId": F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("op"), F.col("event_id") % 9)), "page": F.when(F.col("type") != "buffer.evict", page), "frame": F.when(F.col("type").startswith("buffer."), frame), "result": result}
    shape = spark.createDataFrame([], EVENT_SCHEMA).schema
    return stored(e.select(*[wanted.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]), "events")


def trace_counters(spark, d):
    return replay_counters(valid_events(trace_events(spark, d)), 5000)


def trace_frames(spark, d):
    return replay_frames(valid_events(trace_events(spark, d)), 5000)


def trace_results(spark, d):
    return replay_results(valid_events(trace_events(spark, d)))


def query_events(spark, d):
    """The flagship query's own trace: its result events, whose order is the rows' own."""
    _, events = trace_query(flagship(spark, d), TraceRun("flagship", "large", "medium", 20), credits_plan("large", "medium", "R", False), {})
    shown = events.select("seq", "type", *[F.try_element_at("result.fields", F.lit(n)).alias(n) for n in ("title", "name")])
    return shown


def plan_nodes(spark, d):
    return spark.createDataFrame(credits_plan("large", "medium", "R", True).rows(), "id string, parent string, type string, label string, detail string")


def preview_filter(spark, d):
    return preview(_t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "auto", ["c_custkey"])


QUERIES = {
    "flagship": flagship, "flagship_binary": flagship_binary, "flagship_indexed": flagship_indexed, "flagship_ordered": flagship_ordered,
    "scan_full": scan_full, "select_range": q_select_range, "select_range_signed": select_range_signed, "select_eq": q_select_equal,
    "project_pipelined": project_pipelined, "project_materialized": project_materialized, "join_inner": join_inner, "join_empty_string_key": join_empty_string_key,
    "index_exact": index_exact, "index_range": q_index_range, "index_range_numeric": index_range_numeric, "index_duplicate_start": index_duplicate_start,
    "width_accept": width_accept, "width_reject": width_reject, "null_marker": q_null_marker, "fixed_roundtrip": fixed_roundtrip,
    "result_lines": q_result_lines, "result_count": result_count, "bench_summary": bench_summary, "workload_summary": workload_summary, "speedup_vs_base": speedup_vs_base,
    "replay_counters": replay, "record_ids": q_record_ids, "io_cost_model": io_cost_model, "io_cost_model_wide": io_cost_model_wide, "selectivity_bounds": q_selectivity_bounds,
    "lru_simulation": q_lru_simulation, "multiset_diff": multiset_diff, "multiset_diff_unequal": multiset_diff_unequal, "preview_filter": preview_filter,
    "csv_ingest": csv_ingest, "csv_ingest_strict": csv_ingest_strict, "csv_rejects": csv_rejects, "csv_rejects_strict": csv_rejects_strict, "dump_ingest": dump_ingest,
    "result_sink": result_sink, "appended_frames": appended_frames, "metrics_lines": metrics_lines, "unit_conversions": unit_conversions, "latest_run": q_latest_run, "frame_budgets": frame_budgets,
    "host_cpu": host_cpu, "host_memory": q_host_memory, "process_peaks": q_process_peaks,
    "trace_counters": trace_counters, "trace_frames": trace_frames, "trace_results": trace_results, "query_events": query_events, "plan_nodes": plan_nodes,
}

_FL = "select p_name as title, s_name as name from part join lineitem on p_partkey = l_partkey join supplier on l_suppkey = s_suppkey where l_returnflag = 'R' and p_name between 'large' and 'medium'"
_SHORT = "octet_length(encode(text)) <= 482"


def _key(x: str) -> str:
    return f"rpad(array_to_string(list_transform(range(octet_length(encode({x}))), lambda i: printf('%02x', (('0x' || substr(hex(encode({x})), 2*i+1, 2))::int + 128) % 256)), ''), 964, '80')"


def _cost_sql(m: int, j: int) -> str:
    return f"""with n as (select (select greatest(1, ceil(count(*)/{m}.0)) from part) pm, (select greatest(1, ceil(count(*)/102.0)) from lineitem) pw, (select greatest(1, ceil(count(*)/35.0)) from supplier) pp,
        (select greatest(1, ceil(count(*)/204.0)) from lineitem where l_returnflag = 'R') pc, (select count(*) from ({_FL})) r)
        select cast(b as bigint) as b, cast(pw + pc + pm + ceil(r/(((b-1)//2)*{m}.0))*pc + ceil(r/(((b-1)//2)*{j}.0))*pp as bigint) as io from n cross join (values (20), (50), (100)) t(b)"""


_TITLE = """case when octet_length(encode(p_name)) > 20 then p_name when p_partkey % 40 = 0 then p_name || ' - a "long", long title of 31 bytes' else p_name || ', "x"' end"""
_INGEST = f"""select p_partkey::varchar as "movieId", {_TITLE} as title, '' as note from part where octet_length(encode({_TITLE})) <= 30"""
_REJECTS = f"""with r as (select row_number() over (order by p_partkey) + 1 as line, octet_length(encode({_TITLE})) as needed from part)
    select cast(line as bigint) as line, 'title' as field, cast(needed as int) as needed, cast(30 as int) as allowed from r where needed > 30"""
_SAMPLES = """with s as (select event_type, event_id, case when event_id % 11 != 3 then event_id // 3 + user_id % 5 end as busy, case when event_id % 11 != 3 then event_id end as total, case when event_id % 11 != 4 then user_id end as available,
    case when event_id % 11 != 5 then user_id % 13 end as swap, case when event_id % 11 != 6 then round(value, 3) end as load from events)"""
_EVENTS = f"""with t as (select event_type as trace, event_id as seq, [{", ".join(f"'{t}'" for t in EVENT_TYPES)}][event_id % {len(EVENT_TYPES)} + 1] as type, case when event_id % 4 != 0 then 'op' || (event_id % 9) end as op, user_id % 20 as frame, user_id, event_id % 2 = 0 as whole from events)"""
_MORE = {
    "csv_ingest": _INGEST, "csv_ingest_strict": _INGEST, "csv_rejects": _REJECTS, "csv_rejects_strict": _REJECTS,
    "dump_ingest": """select 'nm' || s_suppkey as "personId", case when s_suppkey % 4 = 0 then '' else '"' || s_name end as name from supplier""",
    "result_sink": f"select title || ',' || name as line, count(*) over () as told from ({_FL})",
    "appended_frames": "select n_nationkey, n_name, null as n_regionkey from nation union all select n_nationkey + 100, null, n_regionkey from nation",
    "metrics_lines": "select event_id, case when event_id % 10 not in (0, 2) then user_id end as rows, case when event_id % 10 > 2 then event_id end as k from events",
    "unit_conversions": "select event_id, case when user_id * 1000 - 50000 >= 0 then round((user_id * 1000 - 50000) / 1e6, 6) end as ms, round(event_id * 4096 / 1048576, 6) as mib from events",
    "latest_run": "select event_id, user_id % 7 as run_id from events where user_id % 7 = (select max(user_id % 7) from events) and event_type != 'click' and event_id % 5 != 0",
    "frame_budgets": "select p as pool, c as concurrent, p // c as budget from range(3, 60) a(p), range(1, 9) b(c) where p // c >= 3",
    "host_cpu": _SAMPLES + """, l as (select event_type, busy - lag(busy) over w as spent, total - lag(total) over w as more from s where busy is not null window w as (partition by event_type order by event_id)),
        u as (select event_type, greatest(0.0, least(100.0, spent / more * 100)) as cpu from l where more > 0)
        select event_type, round(min(cpu), 6) as least, round(max(cpu), 6) as most, round(avg(cpu), 6) as mean, count(*) as samples from u group by 1""",
    "host_memory": _SAMPLES + " select event_type, min(available) as available_least, round(avg(available), 6) as available_mean, max(swap) as swap_most, max(load) as load_most, count(*) as attempted, count(*) filter (available is not null or swap is not null or load is not null) as successful from s group by 1",
    "process_peaks": _SAMPLES + " select event_type, max(available) as resident_most, max(swap) as minor_faults, max(busy) as major_faults, count(*) as attempted, count(*) filter (available is not null and swap is not null and busy is not null) as successful, count(*) filter (available is null or swap is null or busy is null) as failed from s group by 1",
    "trace_counters": _EVENTS + """ select trace, count(*) filter (type = 'buffer.miss') as "pagesRead", count(*) filter (type = 'buffer.hit') as "bufferHits", count(*) filter (type = 'buffer.miss') as "bufferMisses", count(*) filter (type = 'buffer.evict') as evictions,
        count(*) filter (type = 'query.result' and whole) as "recordsEmitted", count(*) filter (type = 'btree.node_visit') as "btreeNodeVisits", max(seq) as seq, max_by(op, seq) filter (op is not null) as "activeOperatorId",
        nullif(max_by(case when type in ('buffer.hit', 'buffer.page_load') then cast(frame as int) else -1 end, seq), -1) as "touchedFrameId", nullif(max_by(case when type = 'buffer.evict' then cast(frame as int) else -1 end, seq), -1) as "evictingFrameId"
        from t where seq <= 5000 group by 1""",
    "trace_frames": _EVENTS + """, l as (select trace, frame, max_by(type, seq) as type, max_by(user_id, seq) as page from t where seq <= 5000 and type in ('buffer.page_load', 'buffer.evict') group by 1, 2)
        select trace, cast(frame as int) as "frameId", trace as "fileId", cast(page as int) as "pageId", cast(1 as int) as "pinCount", false as dirty from l where type = 'buffer.page_load'""",
    "trace_results": _EVENTS + " select trace, seq, trace as title, '' as name from t where type = 'query.result' and whole",
    "query_events": f"""with r as (select title, name, row_number() over (order by title, name) as seq from ({_FL}))
        select seq, 'query.result' as type, title, name from r union all select 0, 'operator.open', null, null union all select (select count(*) from r) + 1, 'query.complete', null, null""",
    "plan_nodes": """select * from (values ('root', null, 'PROJECT', 'title, name', null), ('join2', 'root', 'BNL_JOIN', 'personId', null), ('join1', 'join2', 'BNL_JOIN', 'movieId', null), ('movies', 'join1', 'INDEX_SCAN', 'movies by title', 'large..medium'),
        ('credits', 'join1', 'MATERIALIZE', 'movieId, personId', null), ('category', 'credits', 'SELECTION', 'category', 'R'), ('workedon', 'category', 'SCAN', 'workedon', null), ('people', 'join2', 'SCAN', 'people', null)) t(id, parent, type, label, detail)""",
    "multiset_diff_unequal": """with a as (select p_name from part where p_partkey % 3 != 0 union all select p_name from part where p_partkey % 7 = 0), b as (select p_name from part where p_partkey % 5 != 0)
        select (select count(*) from (select * from a except all select * from b)) as only_left, (select count(*) from (select * from b except all select * from a)) as only_right""",
}

ORACLES = {
    "flagship": _FL, "flagship_binary": _FL, "flagship_indexed": _FL, "flagship_ordered": _FL + " order by 1, 2",
    "scan_full": "select p_partkey, p_name from part",
    "select_range": "select p_partkey, p_name from part where p_name >= 'large' and p_name <= 'medium'",
    "select_range_signed": f"select doc_id from documents where {_SHORT} and {_key('text')} <= {_key(chr(39) + 'Mz' + chr(39))}",
    "select_eq": "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R'",
    "project_pipelined": "select l_partkey, l_suppkey from lineitem where l_returnflag = 'R'",
    "project_materialized": "select l_partkey, l_suppkey, count(*) over () as total from lineitem where l_returnflag = 'R'",
    "join_inner": 'select p_partkey as "movieId", p_name as title, l_suppkey as "personId" from part join lineitem on p_partkey = l_partkey',
    "join_empty_string_key": "select a.k, title, name from (select case when p_partkey % 500 = 0 then '' else p_partkey::varchar end k, p_name title from part) a join (select case when s_suppkey % 50 = 0 then '' else s_suppkey::varchar end k, s_name as name from supplier) b on a.k = b.k",
    "index_exact": 'select p_partkey as "movieId", p_name as title from part where p_name = (select min(p_name) from part)',
    "index_range": 'select p_partkey as "movieId", p_name as title from part where p_name between \'large\' and \'medium\'',
    "index_range_numeric": "select p_partkey, p_name from part where p_partkey between 10 and 60",
    "index_duplicate_start": "with s as (select p_name s from part group by 1 order by count(*) desc, p_name limit 1) select p_partkey as \"movieId\", p_name as title from part, s where p_name >= s and p_name <= s || '~'",
    "width_accept": f"select doc_id from documents where {_SHORT}",
    "width_reject": "select doc_id, cast(octet_length(encode(text)) as int) as needed from documents where octet_length(encode(text)) > 482",
    "null_marker": "select s_suppkey, case when s_suppkey % 3 = 0 then '' else s_name end as x from supplier",
    "fixed_roundtrip": f"select doc_id, text from documents where {_SHORT}",
    "result_lines": f"select title || ',' || name as line from ({_FL})",
    "result_count": f"select count(*) as n from ({_FL})",
    "bench_summary": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(quantile_disc(value, 0.95), 6) as p95, round(min(value), 6) as min, round(max(value), 6) as max, round(sum(value), 4) as total from events group by 1",
    "workload_summary": "select event_type, count(*) as runs, min(event_id) as first, round(avg(value), 6) as mean, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1",
    "speedup_vs_base": "with m as (select event_type, avg(value) m from events group by 1), b as (select m b from m order by event_type limit 1) select event_type, round(m / b, 6) as ratio, round(100 * (m / b - 1), 6) as change_percent from m, b",
    "replay_counters": "select user_id, event_id, cast(sum((event_type = 'click')::int) over w as bigint) as clicks, cast(sum((event_type = 'view')::int) over w as bigint) as views, cast(sum((event_type = 'purchase')::int) over w as bigint) as purchases from events window w as (partition by user_id order by event_id rows unbounded preceding)",
    "record_ids": "with r as (select p_partkey, p_name, row_number() over (order by p_partkey, p_name) - 1 as rn from part) select p_partkey, p_name, cast(rn // 8 as bigint) as page_id, cast(rn % 8 as bigint) as slot_id from r",
    "io_cost_model": _cost_sql(104, 83), "io_cost_model_wide": _cost_sql(8, 8),
    "selectivity_bounds": "with v as (select p_name, row_number() over (order by p_name) rn, count(*) over () n from part) select cast(s.sel as double) as sel, p_name from v join (values (0.001), (0.01), (0.05), (0.1), (0.2), (0.5)) s(sel) on rn = greatest(1, least(cast(ceil(cast(s.sel as double) * n) as bigint), n))",
    "lru_simulation": """with a as (select event_type, row_number() over (partition by event_type order by event_id) seq, user_id page from events),
        p as (select *, lag(seq) over (partition by event_type, page order by seq) prev from a),
        d as (select p.event_type, p.seq, p.prev, count(distinct x.page) n from p left join a x on x.event_type = p.event_type and x.seq > p.prev and x.seq < p.seq group by 1, 2, 3),
        u as (select event_type, count(distinct user_id) pages from events group by 1)
        select d.event_type, cast(b as bigint) as buffer, cast(sum((prev is not null and n < b)::int) as bigint) as hits, cast(sum((prev is null or n >= b)::int) as bigint) as misses,
               cast(sum((prev is null or n >= b)::int) - least(any_value(b), any_value(pages)) as bigint) as evictions from d join u using (event_type) cross join (values (20), (50), (100)) t(b) group by 1, 2""",
    **_MORE,
    "multiset_diff": "select cast(0 as bigint) as only_left, cast(0 as bigint) as only_right",
    "preview_filter": "select * from (select c_custkey, c_name, c_mktsegment from customer order by c_custkey limit 250) where contains(lower(c_custkey::varchar), 'auto') or contains(lower(c_name), 'auto') or contains(lower(c_mktsegment), 'auto') order by c_custkey limit 25",
}
