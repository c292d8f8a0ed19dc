import gzip
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from stratum import cli
from stratum.functions import codec
from stratum.functions.codec import fits_width, from_fixed, sort_key, to_fixed
from stratum.operators import layout
from stratum.operators import relational as R
from stratum.plans import engine as E
from stratum.plans import processes
from stratum.plans import trace as T
from stratum.plans.credits import credits_in_range
from stratum.schema import MOVIES, PEOPLE, WORKEDON, Relation
from stratum.sources import delimited, scratch, sinks, workload
from stratum.sources.catalog import Catalog


@pytest.fixture(scope="module")
def tables(spark):
    names = ["carmencita"] + [f"carmencita-{k:04}" for k in range(400)]
    movies = spark.createDataFrame([(f"tt{k}", n) for k, n in enumerate(names)], "movieId string, title string")
    credits = spark.createDataFrame([(f"tt{k}", f"nm{k % 50}", c) for k in range(401) for c in ("director", "actor")], "movieId string, personId string, category string")
    people = spark.createDataFrame([(f"nm{k}", f"Person {k}") for k in range(50)], "personId string, name string")
    return movies, credits, people


def padded(text, width):
    return [b - 256 if b > 127 else b for b in text.encode().ljust(width, b"\0")]


def test_layout_of_relations():
    assert [r.page_rows for r in (MOVIES, WORKEDON, PEOPLE)] == [8, 102, 35]
    assert Relation.of("x", a=9, b=30).record_bytes == 39


def test_signed_order(spark):
    pool = ["", "a", "ab", "aé", "é", "z", "Z", "a\0b", "日本", "€", "~", " "]
    rng = random.Random(5)
    pool += ["".join(rng.choice("aé€z \0") for _ in range(rng.randint(0, 4))) for _ in range(60)]
    rows = [(k, x) for k, x in enumerate(pool) if len(x.encode()) <= 12]
    got = [r[0] for r in spark.createDataFrame(rows, "k long, x string").orderBy(sort_key(F.col("x"), 12), "k").collect()]
    assert got == [k for k, _ in sorted(rows, key=lambda r: (padded(r[1], 12), r[0]))]


def test_fixed_round_trip(spark):
    df = spark.createDataFrame([("é",), ("",), ("ab",)], "x string")
    assert [r[0] for r in df.select(from_fixed(to_fixed(F.col("x"), 4))).collect()] == ["é", "", "ab"]
    assert [r[0] for r in df.select(fits_width(F.col("x"), 1)).collect()] == [False, True, False]
    with pytest.raises(Exception, match="exceeds 1 UTF-8 bytes: 2"):
        df.select(to_fixed(F.col("x"), 1)).collect()


def test_join(spark):
    a = spark.createDataFrame([("k", "outer"), ("", "e"), ("", "f")], "id string, v string")
    b = spark.createDataFrame([("k", "inner", 1), ("", "x", 2)], "id string, v string, w int")
    got = R.equi_join(a, b, "id", "id", ["w", "v", "id"])
    assert sorted(map(tuple, got.collect())) == [(1, "outer", "k"), (2, "e", ""), (2, "f", "")]
    with pytest.raises(ValueError, match="unknown field"):
        R.equi_join(a, b, "id", "id", ["nope"])
    assert R.equi_join(a, b.filter("w > 9"), "id", "id", ["id"]).count() == 0
    with pytest.raises(ValueError):
        R.project(a, ["nope"])


def test_select_with_a_callable(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert R.select(df, lambda r: r["x"] > 1).collect()[0][0] == 2


def test_query_and_index_agree(spark, tables, tmp_path):
    movies, credits, people = tables
    many = movies.unionByName(movies.filter("title = 'carmencita-0007'").crossJoin(spark.range(20)).select("movieId", "title"))
    R.build_index(many, "title", 482, str(tmp_path / "ix"), 4)
    index = R.open_index(spark, str(tmp_path / "ix"), "title")
    for start, end in (("carmencita-0007", "carmencita-0099"), ("carmencita", "carmencita"), ("z", "a"), ("carmencita-0007", "carmencita-0007")):
        scan = credits_in_range(many, credits, people, start, end)
        both = credits_in_range(index, credits, people, start, end, indexed=True)
        assert tuple(R.multiset_difference(scan, both).first()) == (0, 0)
    assert R.index_search(index, "title", "carmencita-0007", 482).count() == 21
    assert "PushedFilters: [IsNotNull(title__key)" in R.index_range(index, "title", "a", "b", 482)._jdf.queryExecution().toString() or "title__key" in R.index_range(index, "title", "a", "b", 482)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        R.open_index(spark, str(tmp_path / "ix"), "movieId")


def key_of_padded(c, width):
    return F.translate(F.decode(F.rpad(F.encode(c, "UTF-8"), width, F.lit(b"\x00")), "ISO-8859-1"), "".join(map(chr, range(256))), "".join(chr(0x100 + (b ^ 0x80)) for b in range(256)))


def seconds(df):
    began = time.perf_counter()
    rows = df.collect()
    return time.perf_counter() - began, rows


def test_keys_and_ranges_of_odd_values(spark):
    pool = ["", "a", "ab", "abc", "aé", "é", "z", "a\0b", "a\0", "\0", "a\0é", "ab\0", "日本", "~", "abcdefghijkl", "abcdefghijklm", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(pool)], "k long, x string")
    assert df.filter(~F.equal_null(sort_key(F.col("x"), 12), key_of_padded(F.col("x"), 12))).count() == 0
    fitting = [(k, x) for k, x in enumerate(pool) if x is not None and len(x.encode()) <= 12]
    for start in ("", "a", "ab", "a\0b", "é", "abcdefghijkl"):
        for end in ("a", "ab", "z", "é", "a\0é", "~"):
            got = {r["k"] for r in R.select_range(df.filter("k != 15"), "x", start, end, 12).collect()}
            assert got == {k for k, x in fitting if padded(start, 12) <= padded(x, 12) <= padded(end, 12)}, (start, end)
    digits = spark.createDataFrame([(9,), (10,), (60,), (100,)], "x long")
    assert [r[0] for r in R.select_range(digits, "x", "10", "60", 12).collect()] == [10, 60, 100]


def test_padding_costs_no_translation(spark):
    df = spark.range(0, 4000, 1, 1).select(F.concat(F.lit("title "), F.col("id").cast("string")).alias("x"))
    lengths = lambda key: df.select(F.length(key(F.col("x"), 20000)).alias("n")).agg(F.sum("n"))
    before, rows = seconds(lengths(key_of_padded))
    after, same = seconds(lengths(sort_key))
    scan, hits = seconds(R.select_range(df, "x", "title 1", "title 2", 20000))
    assert same == rows and len(hits) == 1112
    assert after < before / 3 and scan < before / 3


def test_multiset_difference_reads_each_side_once(spark, tmp_path):
    rows = [("a", 1.0), ("a", 1.0), ("a", 1.0), (None, 2.0), (None, 2.0), ("b", float("nan")), ("c", 0.0), ("d", None)]
    spark.createDataFrame(rows, "x string, y double").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 2.0), (None, 2.0), ("b", float("nan")), ("c", -0.0), ("e", None)], "other string, y double").write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    diff = R.multiset_difference(a, b)
    assert tuple(diff.first()) == (a.exceptAll(b).count(), b.exceptAll(a).count()) == (3, 2)
    assert diff._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in diff.schema] == [("only_left", "bigint", False), ("only_right", "bigint", False)]
    assert tuple(R.multiset_difference(a.limit(0), b).first()) == (0, 7) and tuple(R.multiset_difference(a.limit(0), b.limit(0)).first()) == (0, 0)
    assert tuple(R.multiset_difference(a.select("x", "x"), b.select("other", "other")).first()) == (3, 2)
    with pytest.raises(Exception, match="same number of columns"):
        R.multiset_difference(a, b.select("y"))


def test_catalog(spark, tables, tmp_path):
    c = Catalog(str(tmp_path))
    c.add_table(MOVIES)
    c.add_index("movies", "title")
    c.store(tables[0], "movies")
    c.store_index(spark, "movies", "title")
    assert c.table(spark, "movies").count() == c.index(spark, "movies", "title").count() == 401
    with pytest.raises(KeyError):
        c.table(spark, "nothing")


@pytest.mark.parametrize(
    ("line", "fields"),
    [('"Café, ""Noir"""', ['Café, "Noir"']), (" padded ", [" padded "]), ("tt3", ["tt3"]), ('""', [""]), ('a"b', ['a"b']), ('"tt7"z,q', ["tt7", "", "q"]), ("", [""]), ("a,", ["a", ""]), ('"open', ["open"])],
)
def test_line_parser(line, fields):
    assert delimited.parse_line(line) == fields


@pytest.mark.parametrize("strict", [False, True])
def test_csv(spark, tmp_path, strict):
    relation = Relation.of("movies", movieId=10, title=10, year=4)
    path = tmp_path / "m.csv"
    path.write_text('movieId,title\ntt1,"A, b"\ntt2,abcdefghijklmnopqrstuvw\ntt3,\n', encoding="utf-8")
    loaded = delimited.read_csv(spark, str(path), relation, strict)
    assert sorted(map(tuple, loaded.rows.collect())) == [("tt1", "A, b", ""), ("tt3", "", "")]
    (reject,) = loaded.rejects.collect()
    assert (reject["field"], reject["needed"], reject["allowed"]) == ("title", 23, 10)
    assert loaded.report()[-1] == "1 rows skipped"
    path.write_text("title,movieId\n")
    with pytest.raises(delimited.HeaderError):
        delimited.read_csv(spark, str(path), relation)


def test_dump(spark, tmp_path):
    path = tmp_path / "d.tsv"
    path.write_text('nconst\tprimaryName\nnm1\t"Q" A, b\nnm2\t\\N\n')
    columns = {"personId": "nconst", "name": "primaryName"}
    assert sorted(map(tuple, delimited.read_dump(spark, str(path), PEOPLE, columns).collect())) == [("nm1", '"Q" A, b'), ("nm2", "")]
    path.write_text("nconst\tprimaryName\nnm1\t" + "é" * 53 + "\n")
    with pytest.raises(Exception, match="name exceeds 105 UTF-8 bytes: 106"):
        delimited.read_dump(spark, str(path), PEOPLE, columns).collect()
    with pytest.raises(ValueError, match="missing column"):
        delimited.read_dump(spark, str(path), PEOPLE, {"personId": "nconst", "name": "other"})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a, b", "c")], "title string, name string")
    assert sinks.write_results(df, str(tmp_path / "r")) == 1
    assert sinks.result_lines(df).first()[0] == "a, b,c"
    assert sinks.result_lines(df, quoted=True).first()[0] == '"a, b",c'
    line = sinks.metrics_line(rows=3, query_ns=5)
    assert sinks.parse_metrics(line) == {"rows": 3, "query_ns": 5}
    assert sinks.parse_metrics(line + " x=y") is None
    assert spark.createDataFrame([(line,), ("x",)], "l string").select(sinks.metrics_column(F.col("l"), "rows")).collect()[0][0] == 3
    log = str(tmp_path / "log.csv")
    sinks.append_rows(log, [{"a": 1}])
    sinks.append_rows(log, [{"a": 2, "b": 3}])
    assert open(log).read().split() == ["a,b", "1,", "2,3"]


def test_workloads(tmp_path):
    path = tmp_path / "w.csv"
    path.write_text('name,start_range,end_range\nsmall,a,az\n\n"m, x",m,mz\n')
    assert [w.name for w in workload.read_workloads(str(path), 482)] == ["small", "m, x"]
    for bad in ("name,start\n", "name,start_range,end_range\na,b\n", 'name,start_range,end_range\n"a,b,c\n', "name,start_range,end_range\na,b," + "é" * 300 + "\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            workload.read_workloads(str(path), 482)


def test_engine(spark, tables):
    plan = lambda a, b: credits_in_range(*tables, a, b)
    loads = [workload.Workload("a", "carmencita", "carmencita-0099"), workload.Workload("b", "carmencita-0100", "carmencita-0199")]
    summary = E.benchmark(spark, plan, loads, E.Config(18, 2, 2, 2, 1))
    assert summary.success and len(summary.records) == 6
    assert E.summarize(summary)["ok"] == 4
    assert {r.rows for r in summary.records} == {101, 100}
    engine = E.AdmissionEngine(spark, 6, 2)
    with pytest.raises(RuntimeError):
        engine.run(lambda: (_ for _ in ()).throw(RuntimeError("x")))
    assert engine.run(lambda: spark.range(3)).rows == 3  # the permit was freed
    with pytest.raises(ValueError):
        E.AdmissionEngine(spark, 5, 2)
    with pytest.raises(ValueError):
        E.benchmark(spark, plan, [workload.Workload("none", "zz", "zzz")], E.Config(18, 2, 1, 1))
    assert E.nearest_rank(list(range(1, 21)), 0.95) == 19 and E.nearest_rank([], 0.95) is None


def test_host_usage_and_latest_run(spark):
    samples = spark.createDataFrame([("h", 1, 0.0, 0.0), ("h", 2, 5.0, 10.0), ("h", 3, 30.0, 20.0)], "h string, t int, b double, n double")
    assert tuple(E.host_usage(samples, "h", "t", "b", "n").first()) == ("h", 50.0, 100.0, 75.0, 2)
    runs = spark.createDataFrame([("1", "ok", False), ("2", "ok", False), ("2", "failed", False), ("2", "ok", True)], "run_id string, status string, warmup boolean")
    assert E.latest_run(runs).count() == 1


def test_layout(spark):
    df = spark.createDataFrame([(k, f"t{k % 7}") for k in range(50)], "k long, t string")
    ids = {r["k"]: (r["page_id"], r["slot_id"]) for r in layout.record_ids(df, ["k"], 8).collect()}
    assert ids == {k: (k // 8, k % 8) for k in range(50)}
    assert layout.io_cost(20, 10, 3, 2, 100, 8, 8, [20])[0] == (20, 33 + 2 * 3 + 2 * 2)
    with pytest.raises(ValueError):
        layout.block_pages(2)
    got = {r["sel"]: r["t"] for r in layout.selectivity_bounds(df, "t", [0.1, 1.0]).collect()}
    order = sorted(f"t{k % 7}" for k in range(50))
    assert got == {0.1: order[4], 1.0: order[49]}
    access = spark.createDataFrame([("x", s, p) for s, p in enumerate("ABACAB")], "trace string, seq long, page string")
    assert tuple(layout.lru_simulation(access, "trace", "seq", "page", [2]).first()) == ("x", 2, 2, 4, 2)


def mini_trace(spark):
    """A pool of two frames: load A, load B, hit A, then a miss of C that evicts B; one result."""
    page = lambda k: {"fileId": "t.csv", "pageId": k}
    frame = lambda k, **more: {"frameId": k, "pinCount": 1, "dirty": False, **more}
    events = [
        {"type": "operator.open", "operatorId": "scan"},
        {"type": "buffer.miss", "operatorId": "scan", "page": page(0)},
        {"type": "buffer.page_load", "operatorId": "scan", "page": page(0), "frame": frame(0)},
        {"type": "buffer.miss", "operatorId": "scan", "page": page(1)},
        {"type": "buffer.page_load", "operatorId": "scan", "page": page(1), "frame": frame(1)},
        {"type": "buffer.hit", "operatorId": "scan", "page": page(0), "frame": {"frameId": 0}},
        {"type": "buffer.miss", "operatorId": "scan", "page": page(2)},
        {"type": "buffer.evict", "operatorId": "scan", "frame": {"frameId": 1, "evictedPage": page(1)}},
        {"type": "buffer.page_load", "operatorId": "scan", "page": page(2), "frame": frame(1)},
        {"type": "query.result", "operatorId": "project", "result": {"ordinal": 0, "fields": {"title": "Pinned", "name": "Ada Pageman"}}},
    ]
    rows = [json.dumps({"trace": "mini", "seq": k, "timeMs": k, **e}) for k, e in enumerate(events)]
    return spark.read.schema(T.EVENT_SCHEMA).json(spark.sparkContext.parallelize(rows))


def test_replay(spark):
    events = mini_trace(spark)
    assert T.valid_events(events).count() == 10
    frames = lambda c: {r["frameId"]: r["pageId"] for r in T.replay_frames(events, c).collect()}
    counts = lambda c: T.replay_counters(events, c).first().asDict()
    assert frames(0) == {} and counts(0)["pagesRead"] == 0 and T.replay_results(events, 0).count() == 0
    assert frames(4) == {0: 0, 1: 1} and counts(4)["touchedFrameId"] == 1
    assert counts(5)["bufferHits"] == 1 and counts(5)["touchedFrameId"] == 0
    assert frames(7) == {0: 0} and counts(7)["evictingFrameId"] == 1 and counts(7)["evictions"] == 1
    assert frames(8) == {0: 0, 1: 2}
    last = counts(9999)
    assert last == counts(9) == counts(None) and last["seq"] == 9 and last["activeOperatorId"] == "project"
    assert [last[k] for k in ("pagesRead", "bufferHits", "bufferMisses", "evictions", "recordsEmitted", "btreeNodeVisits")] == [3, 1, 3, 1, 1, 0]
    assert [tuple(r)[2:] for r in T.replay_results(events).collect()] == [("Pinned", "Ada Pageman")]


def test_invalid_events_are_told(spark):
    good = {"trace": "t", "seq": 0, "timeMs": 0, "type": "buffer.hit"}
    bad = [{"type": "buffer.load"}, {"seq": -1}, {"timeMs": -1}, {"type": None}, {"page": {"fileId": " ", "pageId": 0}}, {"page": {"fileId": "f", "pageId": -1}}, {"frame": {"frameId": -1}}, {"frame": {"frameId": 0, "pinCount": -1}}, {"join": {"side": "OUTER"}}, {"join": {"matches": -1}}, {"btree": {"nodeType": "ROOT"}}, {"result": {"ordinal": -1, "fields": {}}}]
    events = spark.read.schema(T.EVENT_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(good | b) for b in [*bad, {}, {"join": {"side": "LEFT"}}]]))
    assert T.valid_events(events).count() == 2


def test_trace_documents(spark, tables):
    run = T.TraceRun("r", "a", "b", 3)
    plan = T.credits_plan("a", "b", "director", False)
    tables_of = {"Movies": T.TraceTable("movies", 492, 401), "People": T.TraceTable("people", 115)}
    trace, events = T.trace_query(credits_in_range(*tables, "carmencita", "carmencita-0003"), run, plan, tables_of)
    assert trace.summary.recordsEmitted == 5 and T.valid_events(events).count() == events.count() == 7
    assert [r["seq"] for r in events.orderBy("seq").collect()] == list(range(7))
    whole = T.with_events(trace, events)
    assert T.QueryTrace.from_json(whole.to_json()) == whole
    d = json.loads(whole.to_json())
    assert set(d) == {"schemaVersion", "run", "summary", "plan", "tables", "events"}
    assert set(d["run"]) == {"id", "command", "startedAt", "range", "bufferSize", "indexed", "wallClockMs"} and d["run"]["command"] == "run_query"
    assert d["tables"]["Movies"] == {"fileId": "movies", "recordSize": 492, "recordCount": 401}
    assert d["plan"]["id"] == "root" and d["plan"]["children"][0]["children"][0]["children"][1]["type"] == "MATERIALIZE"
    assert [e["type"] for e in d["events"]] == ["operator.open", *["query.result"] * 5, "query.complete"]
    assert len(T.EVENT_TYPES) == len(set(T.EVENT_TYPES)) == 27
    wrong = (
        lambda: T.TraceRun(" ", "a", "b", 3), lambda: T.TraceRun("r", "a", "b", 0), lambda: T.TraceRun("r", "a", "b", 1, wall_clock_ms=-1), lambda: T.TraceRun("r", "a", "b", 1, started_at="noon"),
        lambda: T.TraceSummary(bufferHits=-1), lambda: T.PlanNode("n", "SORT", "x"), lambda: T.PlanNode("n", "SCAN", " "), lambda: T.TraceTable("", 3), lambda: T.TraceTable("f", 0), lambda: T.TraceTable("f", 1, -1),
        lambda: T.QueryTrace(run, T.TraceSummary(), plan, schema_version=2), lambda: T.QueryTrace(run, T.TraceSummary(), plan, events=({"seq": 0, "timeMs": 0, "type": "scan.row"},)),
    )
    for bad in wrong:
        with pytest.raises(ValueError):
            bad()


def test_lru_simulation_in_slices(spark):
    rng = random.Random(8)
    rows = [(t, s, rng.choice("abcdefghij" if rng.random() < 0.7 else "klmnopqrstuvwxyz")) for t in ("x", "y") for s in range(400)]
    df = spark.createDataFrame(rows, "trace string, seq long, page string")
    want = {}
    for t in ("x", "y"):
        for size in (1, 3, 7, 40):
            pool, hits, evictions = [], 0, 0
            for _, _, p in (r for r in rows if r[0] == t):
                if p in pool:
                    hits += 1
                    pool.remove(p)
                elif len(pool) == size:
                    pool.pop(0)
                    evictions += 1
                pool.append(p)
            want[(t, size)] = (hits, 400 - hits, evictions)
    got = {(r["trace"], r["buffer"]): (r["hits"], r["misses"], r["evictions"]) for r in layout.lru_simulation(df, "trace", "seq", "page", [1, 3, 7, 40]).collect()}
    assert got == want
    assert layout.lru_simulation(df.limit(0), "trace", "seq", "page", [2]).count() == 0
    pins = spark.createDataFrame([("x", s, p, True) for s, p in enumerate("abc")], "trace string, seq long, page string, held boolean")
    with pytest.raises(Exception, match="all frames are pinned"):
        layout.lru_simulation(pins, "trace", "seq", "page", [2], pinned="held").collect()


@pytest.mark.parametrize("strict", [False, True])
def test_csv_folders_and_line_numbers(spark, tmp_path, strict):
    relation = Relation.of("movies", movieId=10, title=10)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("movieId,title\ntt1,one\n\ntt2,abcdefghijkl\n", encoding="utf-8")
    (tmp_path / "m" / "b.csv").write_text("movieId,title\ntt3,three\ntt4,abcdefghijklm\n", encoding="utf-8")
    loaded = delimited.read_csv(spark, str(tmp_path / "m"), relation, strict)
    assert sorted(r["movieId"] for r in loaded.rows.collect()) == ([""] if strict else []) + ["tt1", "tt3"]
    assert sorted((r["path"][-5:], r["line"], r["needed"]) for r in loaded.rejects.collect()) == [("a.csv", 4, 12), ("b.csv", 3, 13)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)  # several splits of a file
    try:
        (tmp_path / "long.csv").write_text("movieId,title\n" + "".join(f"tt{k},{'x' * (11 if k % 100 == 7 else 5)}\n" for k in range(1000)))
        loaded = delimited.read_csv(spark, str(tmp_path / "long.csv"), relation, strict)
        assert loaded.rows.count() == 990 and sorted(r["line"] for r in loaded.rejects.collect()) == [k + 2 for k in range(7, 1000, 100)]
        assert len(loaded.report(3)) == 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_and_legacy_rows(spark, tmp_path):
    wide = Relation.of("movies", movieId=12, title=512, startYear=4, endYear=4, isAdult=1, originalTitle=512, titleType=16, runtimeMinutes=8, genres=64)
    (tmp_path / "t.csv").write_text(",".join(wide.names) + '\ntt10001000,"Café, Noir",2024,,0,Café Noir,movie,95,"Drama,Noir"\n', encoding="utf-8")
    (tmp_path / "old.csv").write_text("movieId,title\ntt0000001,Carmencita\n")
    for strict in (False, True):
        row = delimited.read_csv(spark, str(tmp_path / "t.csv"), wide, strict).rows.first()
        assert tuple(row) == ("tt10001000", "Café, Noir", "2024", "", "0", "Café Noir", "movie", "95", "Drama,Noir")
        assert tuple(delimited.read_csv(spark, str(tmp_path / "old.csv"), wide, strict).rows.first()) == ("tt0000001", "Carmencita", *[""] * 7)


def test_logs_and_units(spark, tmp_path):
    log = str(tmp_path / "log.csv")
    sinks.append_rows(log, [{"a": 1, "b": 2}])
    inode = os.stat(log).st_ino
    sinks.append_rows(log, [{"b": 3}])
    assert os.stat(log).st_ino == inode and open(log).read().split() == ["a,b", "1,2", ",3"]  # appended in place
    sinks.append_json(str(tmp_path / "runs.jsonl"), {"run": 1})
    sinks.append_json(str(tmp_path / "runs.jsonl"), {"run": 2, "é": "ü"})
    assert [json.loads(x) for x in open(tmp_path / "runs.jsonl")] == [{"run": 1}, {"run": 2, "é": "ü"}]
    units = spark.createDataFrame([(1_500_000, 3 << 20), (-1, 0)], "ns long, b long").select(codec.nanos_to_millis(F.col("ns")), codec.mebibytes(F.col("b")))
    assert [tuple(r) for r in units.collect()] == [(1.5, 3.0), (None, 0.0)]
    df = spark.createDataFrame([("b", "x, y"), ("a", "")], "title string, name string")
    assert sinks.write_results(df.orderBy("title"), str(tmp_path / "one.csv"), single=True) == 2
    assert open(tmp_path / "one.csv").read() == "a,\nb,x, y\n"
    assert sorted(tuple(r) for r in sinks.append_frame(df.select("title"), str(tmp_path / "log")).collect()) == [("a",), ("b",)]


def test_engine_failures_and_mismatches(spark, tables, tmp_path):
    loads = [workload.Workload("a", "carmencita", "carmencita-0009"), workload.Workload("b", "carmencita-0010", "carmencita-0019")]
    good = lambda a, b: credits_in_range(*tables, a, b)
    calls = {"n": 0}

    def changing(a, b):
        calls["n"] += 1
        df = good(a, b)
        return df.limit(3) if calls["n"] > 2 else df  # other rows than the baselines'

    summary = E.benchmark(spark, changing, loads, E.Config(18, 2, 2, 1))
    assert not summary.success and summary.mismatches == 2 and {r.status for r in summary.records} == {E.MISMATCH}

    def failing(a, b):
        calls["n"] += 1
        if calls["n"] > 2:
            raise OSError("the table is gone")
        return good(a, b)

    calls["n"] = 0
    summary = E.benchmark(spark, failing, loads, E.Config(18, 2, 2, 1))
    assert {r.status for r in summary.records} == {E.FAILED} and all("the table is gone" in r.error for r in summary.records)
    assert summary.residual_tables == 0 and not summary.success and E.summarize(summary)["mean_ms"] is None
    *queries, last = summary.lines()
    assert len(queries) == 2 and sinks.parse_metrics(last, sinks.RUN_PREFIX)["failed"] == 2
    assert sinks.parse_metrics(queries[0].replace("workload=a ", ""), sinks.QUERY_PREFIX)["status_code"] == E.FAILED
    # a broken file: its own error comes up, nothing stays behind, the engine goes on
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"PAR1 no table PAR1")
    engine, before = E.AdmissionEngine(spark, 6, 2), E.cached_tables(spark)
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        engine.run(lambda: spark.read.schema("a string").parquet(str(broken)))
    assert E.cached_tables(spark) == before
    done = engine.run(lambda: tables[0])
    assert done.rows == 401
    tables[0].write.parquet(str(tmp_path / "m"))
    io = engine.run(lambda: spark.read.parquet(str(tmp_path / "m")), lambda df: len(df.collect())).io
    assert io.read_rows >= 401 and io.read_bytes > 0 and io.total_bytes == io.read_bytes + io.written_bytes


def test_scratch_is_removed(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_root", lambda _: f"file://{tmp_path}/shared")
    left = lambda: [f for _, _, fs in os.walk(tmp_path) for f in fs]
    with scratch.scratch(spark):
        assert scratch.stored(tables[0], "t").count() == 401
        kept = scratch.settled(spark, "k", lambda: scratch.stored(tables[0], "inner"))
        assert kept.count() == 401
    assert not left()
    with pytest.raises(RuntimeError), scratch.scratch(spark):
        scratch.stored(tables[0], "t")
        raise RuntimeError
    with R.materialized(tables[0]) as held:
        assert held.count() == held.count() == 401
    assert not left()
    import stratum.queries as queries

    for name in ("project_materialized", "record_ids", "flagship_indexed", "lru_simulation", "csv_rejects", "trace_frames"):
        monkeypatch.setattr(queries, "_indexes", {})
        with scratch.scratch(spark):
            queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert not left(), name


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    """Dumps made into CSV folders and tables by the command line."""
    root = tmp_path_factory.mktemp("cli")
    (root / "dumps").mkdir()
    table = lambda name, rows: gzip.open(root / "dumps" / name, "wt", encoding="utf-8").write("".join("\t".join(r) + "\n" for r in rows))
    table("title.basics.tsv.gz", [("tconst", "titleType", "primaryTitle", "genres"), ("tt0000001", "movie", "Café, Noir", "Drama"), ("tt2", "short", '"Rolling in the Deep Dish', "Comedy"), ("tt3", "tvSeries", "Third", "\\N")])
    table("title.principals.tsv.gz", [("tconst", "ordering", "nconst", "category"), ("tt0000001", "1", "nm0000001", "director"), ("tt2", "2", "nm2", "writer"), ("tt3", "3", "nm3", "director")])
    table("name.basics.tsv.gz", [("nconst", "primaryName", "birthYear"), ("nm0000001", "Person One", "1970"), ("nm2", "Person Two", "1980"), ("nm3", "Person Three", "\\N")])
    assert cli.main(["prepare", "--source-dir", str(root / "dumps"), "--output-dir", str(root / "csv")]) == 0
    assert cli.main(["pre-process", "--source", str(root / "csv"), "--root", str(root / "tables"), "--strict"]) == 0
    return root


def test_cli_prepares_dumps(spark, prepared):
    lines = lambda n: sorted(x for f in (prepared / "csv" / n).glob("part-*") for x in f.read_text(encoding="utf-8").splitlines())
    assert lines("title.csv") == sorted(["movieId,title", 'tt0000001,"Café, Noir"', 'tt2,"""Rolling in the Deep Dish"', "tt3,Third"])
    assert lines("workedon.csv") == sorted(["movieId,personId,category", "tt0000001,nm0000001,director", "tt2,nm2,writer", "tt3,nm3,director"])
    before = lines("name.csv")
    with gzip.open(prepared / "dumps" / "name.basics.tsv.gz", "wt") as f:
        f.write("nconst\nnm1\n")
    with pytest.raises(ValueError, match="missing column"):
        cli.main(["prepare", "--source-dir", str(prepared / "dumps"), "--output-dir", str(prepared / "csv")])
    assert lines("name.csv") == before == sorted(["personId,name", "nm0000001,Person One", "nm2,Person Two", "nm3,Person Three"])


def test_cli_runs_queries(spark, prepared, capsys):
    root, out = str(prepared / "tables"), str(prepared / "result.csv")
    for more in ([], ["--index"]):
        assert cli.main(["run-query", "Café", "Z", "20", "--root", root, "--output", out, "--single-file", "--metrics", *more]) == 0
        assert sorted(open(out, encoding="utf-8").read().splitlines()) == ["Café, Noir,Person One", "Third,Person Three"]
        got = sinks.parse_metrics(capsys.readouterr().err.splitlines()[-1])
        assert got["result_count"] == 2 and got["elapsed_ns"] > 0 and got["heap_pool_peak_sum_bytes"] > 0
    for bad in (["a", "é" * 242, "20"], ["a", "b", "2"]):
        with pytest.raises(ValueError):
            cli.main(["run-query", *bad, "--root", root, "--output", out])
    for bad in (["a", "b", "x"], ["a", "b", "20", "--nothing"], ["a", "b"], ["a", "b", "20", "--index", "--index"]):
        with pytest.raises(SystemExit):
            cli.main(["run-query", *bad, "--output", out])
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_cli_benchmarks(spark, prepared, capsys):
    (prepared / "w.csv").write_text("name,start_range,end_range\nall,A,Z\n")
    base = ["bench", "--root", str(prepared / "tables"), "--workload", str(prepared / "w.csv"), "--output-dir", str(prepared / "bench"), "--buffer-size", "18", "--max-concurrent", "2", "--clients", "2", "--warmups", "1"]
    assert cli.main([*base, "--repetitions", "2"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert [x.split()[0] for x in said] == [sinks.QUERY_PREFIX] * 2 + [sinks.RUN_PREFIX]
    assert "result_mismatches=0" in said[-1] and len(open(prepared / "bench" / "queries.csv").readlines()) == 4
    assert json.loads(open(prepared / "bench" / "runs.jsonl").read())["ok"] == 2
    for bad in ([*base, "--repetitions", "2", "--clients", "3"], base):
        with pytest.raises(SystemExit):
            cli.main(bad)
    one = processes.run_process(workload.Workload("all", "A", "Z"), processes.ProcessConfig((1,), 1, 0, 20, str(prepared / "tables")))
    assert one["status"] == "ok" and one["result_count"] == 2 and one["wall_ms"] > one["query_ms"] > 0
    lost = processes.run_process(workload.Workload("all", "A", "Z"), processes.ProcessConfig((1,), 1, 0, 20, str(prepared / "none")))
    assert lost["status"] == "failed" and lost["exit_code"] != 0 and lost["error"]
    with pytest.raises(ValueError):
        processes.ProcessConfig((0,), 1, 0, 20, "x")


def test_host_memory_and_process_peaks(spark):
    rows = [("h", 1, 100, 5, 0.5, None), ("h", 2, None, 9, None, 3), ("h", 3, None, None, None, 4)]
    df = spark.createDataFrame(rows, "host string, at int, available long, swap long, load double, faults long")
    assert tuple(E.host_memory(df, "host", "available", "swap", "load").first()) == ("h", 100, 100.0, 9, 0.5, 3, 2)
    assert tuple(E.process_peaks(df, "host", "swap", "faults", "faults").first()) == ("h", 9, 4, 4, 3, 1, 2)
    still = spark.createDataFrame([("h", 1, 1.0, 5.0), ("h", 2, None, 6.0), ("h", 3, 2.0, 5.0), ("h", 4, 2.5, 7.0)], "h string, t int, b double, n double")
    assert tuple(E.host_usage(still, "h", "t", "b", "n").first()) == ("h", 25.0, 25.0, 25.0, 1)  # no time went on in one pair


def test_counters_of_a_stream(spark, tmp_path):
    from stratum.streaming.replay import read_events, windowed_counters

    (tmp_path / "in").mkdir()
    rows = [{"trace": "t", "seq": k, "timeMs": k, "type": "buffer.hit" if k % 3 else "buffer.miss", "at": f"2026-01-01T00:0{k // 6}:00Z"} for k in range(12)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    counters = windowed_counters(read_events(spark, str(tmp_path / "in")))
    query = counters.writeStream.format("memory").queryName("counters_of_a_stream").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["window"]["start"].minute, r["type"]): r["events"] for r in spark.table("counters_of_a_stream").collect()}
    assert got == {(m, t): n for m in (0, 1) for t, n in (("buffer.miss", 2), ("buffer.hit", 4))}


def test_entry_without_optional_parts():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "flagship" in entry.queries()
