"""Operators against brute force on random rows, their scale-relevant corners, the pipeline, and what they leave behind."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratum.llm import common, decontamination, lm_score, near_dedup, pieces, quality, queries, secrets, sharding, token_output, warc
from stratum.llm.shingles import shingle_set, shingle_sets, word_hashes, words
from stratum.sources import scratch

from .test_operators import lowered, make_rows, plain_components

P = pytest.importorskip("public_tokenizers")


def test_token_output_keeps_added_tokens(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "plain words only", None, "<|endoftext|> \n <|endoftext|>", "x" * 30_000, "word " * 9000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3])]
    got = collections.Counter(map(tuple, token_output.token_digests(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()))
    fresh, at, want = Tokenizer.from_file(path), 0, collections.Counter()
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*fresh.encode(t or "", add_special_tokens=False).ids, 0]
        want[(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert got == want


def test_token_files_of_several_segments(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "GROUP", 2)
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 300)  # several segments and files
    monkeypatch.setattr(token_output, "FILE_IDS", 700)
    path = P.path("byte_bpe_50k.json")
    rows = [(k, f"text number {k} " * (k % 7)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = token_output.WordEncoder(path)
    folder = f"file://{tmp_path}"
    manifest = token_output.write_tokens(docs, path, folder)
    got = {r["doc_id"]: r for r in token_output.read_tokens(spark, folder, manifest).collect()}
    at = 0
    for k, t in rows:
        ids = [*whole.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert (got[k]["start"], got[k]["n_tokens"], np.frombuffer(got[k]["ids"], "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    parts = [token_output.encode_file([k], [3], np.array([k, 5, 0], np.uint64)) for k in range(3)]
    data, place, found = b"".join(x for p in parts for x in p), 0, []
    while place < len(data):
        ids, counts, tokens, place = token_output.decode_segment(data, place)
        found.append((ids, counts.tolist(), tokens.tolist()))
    assert found == [([k], [3], [k, 5, 0]) for k in range(3)]
    other = token_output.WordEncoder(P.path("word_bpe_49k.json"))  # no byte-level kind: whole texts
    assert not other.by_words
    ids, counts = other.encode(pa.array(["Some words", "", "and more"]))
    assert ids.tolist() == [i for t in ("Some words", "", "and more") for i in other.tokenizer.encode(t, add_special_tokens=False).ids] and len(counts) == 3


def test_pieces_of_odd_texts_equal_plain_search():
    model = pieces.zipf_lattice(P.path("piece_bpe_32k.model"))
    rng = random.Random(11)
    atoms = ["the", "House", "  ", " ", "\n", "\n\n", " \n", "é", "語", "\0", "x" * 50, "1", "...", "\t", "😀", "▁", "a b"]
    texts = ["", " ", "\n", " a", "a ", "a  b", "a\n", "\na", *("".join(rng.choices(atoms, k=rng.randint(1, 9))) for _ in range(150))]
    got = model.encode_many(pa.array(texts, pa.large_string()), 3)
    for text, (best, good) in zip(texts, got, strict=True):
        assert good and all(model.decode(ids) == text for _, ids in best)
        want = model.search(" " + text, 3) if text else [(0.0, ())]
        assert [round(s, 6) for s, _ in best] == [round(s, 6) for s, _ in want]
        assert len({ids for _, ids in best}) == len(best)


def test_slices_of_texts():
    texts = [t for _, t in make_rows(5, 40)]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        for a, b in ((0, len(texts)), (7, 60), (31, 32), (50, len(texts)), (9, 9)):
            hashes, ends = word_hashes(column[a:b])
            own = [w for t in texts[a:b] for w in words(t)]
            assert hashes.tolist() == [xxhash.xxh3_64_intdigest(w) for w in own] and np.diff(ends).tolist() == [len(words(t)) for t in texts[a:b]]
            for t, s in zip(texts[a:b], shingle_sets(column[a:b], 3), strict=True):
                w = words(t)
                assert len(s) == len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else ()) and (s == shingle_set(t, 3)).all()


def test_small_slices_change_nothing(spark, monkeypatch):
    rows = make_rows(6, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    jobs = [
        lambda: near_dedup.near_duplicates(docs, size=3, percent=85), lambda: lm_score.score_texts(docs).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)),
        lambda: token_output.token_digests(docs, P.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_crc32"), lambda: pieces.encode_texts(docs, P.path("piece_bpe_32k.model")).select("doc_id", "ids", "round_trip"),
    ]
    whole = [collections.Counter(map(tuple, job().collect())) for job in jobs]
    for module in (near_dedup, lm_score, token_output, pieces):
        monkeypatch.setattr(module, "SLICE_ROWS", 7)
    assert [collections.Counter(map(tuple, job().collect())) for job in jobs] == whole


def brute_tiles(item, doc, k):
    """Words of the item that greedy tiles cover, by trying every match again and again."""
    item_free, doc_free, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and item_free[i + n] and doc_free[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return covered
        covered += n
        item_free[i : i + n] = [False] * n
        doc_free[j : j + n] = [False] * n


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", ("item_id", "text", block))  # 60: several blocks and the filter
    monkeypatch.setattr(decontamination, "FILTER_BITS", 1 << 17)
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randint(2, 14)))) for k in range(20)] + [(3, "a b c d e f a"), (50, None), (51, "")]
    docs = []
    for k in range(60):
        own = [rng.choice("abcdefxyz") for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            item = (rng.choice(items[:20])[1]).split()
            a = rng.randrange(len(item))
            at = rng.randint(0, len(own))
            own[at:at] = item[a : a + rng.randint(1, 8)]
        docs.append((k, " ".join(own).upper() if k % 2 else "  ".join(own)))
    docs += [(60, None), (61, ""), (0, docs[0][1]), (None, items[0][1]), (62, ". ".join([items[2][1]] * 40)), (63, "q " * 30_000 + items[5][1])]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    got = collections.Counter((r["doc_id"], r["item_id"], r["matched_words"]) for r in decontamination.find_contamination(df, bench, 0.5, 3).collect())
    want = collections.Counter()
    for i, t in docs:
        own = (t or "").lower().replace(".", " ").split()
        own = own if len(own) < 20_000 else ["q"] + own[30_000:]
        for n, x in items:
            item = (x or "").split()
            if len(item) >= 3 and (covered := brute_tiles(item, own, 3)) and covered / len(item) >= 0.5:
                want[(i, n, covered)] += 1
    assert got == want
    clean = decontamination.drop_contaminated(df, bench, 0.5, 3)
    assert clean.columns == df.columns
    marked = {i for i, _, _ in want}
    assert collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter(i for i, _ in docs if i not in marked)


def test_decontamination_of_repeated_phrases():
    phrase = "alpha beta gamma delta epsilon zeta eta theta"
    items = decontamination.Items([(n, f"item{n} word{n} {phrase} tail{n} end{n} more{n}") for n in range(1000)])
    began = time.perf_counter()
    found = items.find(" filler ".join([phrase] * 2000), 0.5)
    assert len(found) == 1000 and {x[2] for x in found} == {8} and time.perf_counter() - began < 10
    twice = decontamination.Items([(0, f"{phrase} and {phrase} or {phrase}")])
    assert twice.find(" filler ".join([phrase] * 50))[0][2] == 24


KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]


def brute_links(text):
    """Base and linked spans by trying all scopes."""
    patterns = {
        "assign": r"""(?a)(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
        "weak_id": r"""(?i:access_?key_?id|client_?id|user_?name|account_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}|(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+""",
        "weak_secret": "[A-Za-z0-9+/]{24,}={0,2}",
        "endpoint": r"(?i:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mongodb|redis|amqp)://[A-Za-z0-9._-]+(?::[0-9]+)?|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])(?::[0-9]+)?",
    }
    mixed = lambda x: all(re.search(c, x) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    keep = {"assign": lambda m: len(m[1]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32, "weak_secret": lambda m: mixed(m[0])}
    parts = [(m.start(), KINDS.index(k), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if keep.get(k, lambda _: True)(m)]
    scopes, at = [], 0
    for m in [*re.finditer(r"\n[ \t]*\n\s*", text, re.ASCII), None]:
        stop = m.start() if m else len(text)
        for w in range(0, len(text) + 1, secrets.REACH):
            lo, hi = max(at, w), min(stop, w + 2 * secrets.REACH)
            if lo < hi:
                scopes.append((lo, hi))
        at = m.end() if m else stop
    linked = set()
    for lo, hi in scopes:
        own = [p for p in parts if lo <= p[0] < hi]
        has_id, has_secret = any(p[3] in ("access", "weak_id") for p in own), any(p[3] in ("assign", "hex", "weak_secret") for p in own)
        linked |= {p for p in own if (p[3] == "weak_id" and has_secret) or (p[3] == "weak_secret" and has_id) or (p[3] == "endpoint" and has_id and has_secret)}
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    base = [p for p in parts if p[1] < 3]
    return hashlib.sha256(line(base).encode()).hexdigest(), line([*base, *linked])


def test_secret_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(secrets, "REACH", 60)
    rng = random.Random(2)
    bits = ["token=abcdefgh12", "AKIA" + "Z9" * 8, "0f" * 20, "user_name: bob", "me.x@mail.example.com", "aB3dE5gH7jK9mN1pQ3sT5vX7zB9", "https://a.example.com:80", "10.0.0.1:22", "1.2.3.4.5", "password = short", "\n\n", "\n \t\n", "\n", "é😀", "\x01", "some prose that goes on", "x" * 40, "@", "login=abc"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(250)] + ["", "a@b.c", "token=abcdefgh1 " * 50 + "\n\n".join(["me@x.yz"] * 40)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[0], 1), (7, texts[7], 1)], "doc_id long, text string, rid int").repartition(3)
    got = collections.Counter((r["doc_id"], r["base_sha256"], r["spans"]) for r in secrets.secret_digests(df).collect())
    want = collections.Counter((i, *brute_links(t)) for i, t in [*enumerate(texts), (None, texts[0]), (7, texts[7])])
    assert got == want
    assert sum("weak" in s or "endpoint" in s for _, _, s in got) > 50


def test_secret_scan_of_many_matches(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh1 me@x.yz\n\n" * 20_000)], "doc_id long, text string")
    secrets.secret_digests(df.limit(0)).collect()
    began = time.perf_counter()
    (r,) = secrets.secret_digests(df).collect()
    assert r["n_assign"] == 20_000 and r["spans"].count("weak_id") == 20_000 and time.perf_counter() - began < 60


def test_families_of_near_copies(spark, monkeypatch):
    """Rounds of further pivots give the components that all pairs give."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "CROWD", 20)
    monkeypatch.setattr(near_dedup, "PIVOTS", 4)
    rng = random.Random(12)
    base, rows = [f"w{k}" for k in range(150)], []
    for share, many in ((0.028, 90), (0.05, 60), (0.01, 40)):
        for _ in range(many):
            rows.append((len(rows), " ".join(rng.choice("abcdefgh") + str(rng.randrange(999)) if rng.random() < share else w for w in base)))
    rows += [(None, rows[0][1]), (5, rows[5][1]), (900, "w1 w2 w3"), (901, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sig string").repartition(4)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, size=3, percent=85).collect())
    assert got == collections.Counter(plain_components(rows, 3, 85))


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_HEAVY_GROUPS", 1)
    from stratum.llm.components import connected_components

    links = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(30)] + [(5000, 5000), (5001, 399), (5001, 399)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").distinct().collect()}
    assert got == {k: 0 for k in [*range(400), 5001]} | {1000 + k: 1000 for k in range(31)}


def test_shards_of_rows(spark, tmp_path):
    rows = make_rows(3, 60)
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, shard int").repartition(4)
    marks = sharding.assign_shards(docs, 5).collect()
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    key = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    want = collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in marks)
    got = collections.Counter((*key(r["doc_id"], r["text"]), r["_shard"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert {k for k in want if k[0] is not None} == {k for k in got if k[0] is not None} and sum(got.values()) == sum(want.values())
    assert {k for k in want if k[0] is None} == {k for k in got if k[0] is None}


def test_quality_of_long_and_repeated_texts(spark):
    rng = random.Random(6)
    good = lambda n: " ".join(rng.choice(["the", "house", "stands", "by", "river", "and", "green", "fields"]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["BUY!!", "NOW!!", "CLICK$$$", "HERE%%%", "WIN***"]) for _ in range(n))
    data = [(k, good(80) if k % 2 else bad(80), k % 2) for k in range(200)]
    more = [(1000, good(40_000)), (1001, bad(40_000)), (1002, "x"), (1003, good(60)), (1003, good(60)), (None, bad(60))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + more, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    got = collections.defaultdict(list)
    for r in quality.score_quality(docs, labels).collect():
        got[r["doc_id"]].append(r["predicted"])
    assert got[1000] == [1] and got[1001] == [0] and got[1003] == [1, 1] and got[None] == [0]
    again = quality.score_quality(docs, labels).orderBy("doc_id").collect()
    assert again == quality.score_quality(docs.repartition(7), labels.repartition(3)).orderBy("doc_id").collect()  # the same whatever the order


def test_quality_beats_chance_on_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op10_quality(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = scored.filter(F.col("predicted") == F.col("quality")).count()
    assert right >= 0.85 * scored.count() > 0


def test_archives_log_their_gaps(spark, tmp_path):
    records = [warc.make_record(k, "http://a/", b"payload %d" % k * 20, hashlib.sha256(b"payload %d" % k * 20).hexdigest(), None, False) for k in range(6)]
    (tmp_path / "w").mkdir()
    data = bytearray(b"".join(map(warc.member, records)))
    at = len(warc.member(records[0])) + 30
    data[at] ^= 0x55
    (tmp_path / "w" / "a.warc.gz").write_bytes(data)
    records, gaps, place = warc.quarantined(warc.read_folder(spark, f"file://{tmp_path}/w"), f"file://{tmp_path}/log")
    assert sorted(r["page_id"] for r in records.collect()) == [0, 2, 3, 4, 5]
    (gap,) = gaps.collect()
    assert gap["file"].endswith("a.warc.gz") and gap["gap"] and gap["start"] < at < gap["end"] and place.endswith("log")


def test_archives_of_many_equal_rows(spark):
    big = "<p>" + "é" * 200
    rows = [(0, "u", big)] * 50 + [(0, "v", big)] * 30 + [(0, None, big), (4, "u", big), (None, "u", big), (None, None, None), (None, None, None), (9, "u", "s" * 100), (9, "u", "s" * 100)]
    got = warc.archive_digests(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    count = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    n = len(big.encode())
    assert count == {(0, "response", None, n): 1, (0, "revisit", 0, n): 80, (4, "revisit", 0, n): 1, (None, "revisit", 0, n): 1, (None, "response", None, 0): 2, (9, "response", None, 100): 1, (9, "revisit", 9, 100): 1}
    assert len({r["payload_digest"] for r in got}) == 3


def test_pipeline_runs(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if model.score(t or "") >= quality.THRESHOLD}
    first = pipeline.quality(spark, docs, sf)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == set(kept) and 0 < len(kept) < len(rows)
    last = {}
    for i, t in kept.items():
        last[lowered(t)] = max(last.get(lowered(t), -1), i)
    kept = {i: kept[i] for i in last.values()}
    groups = plain_components(list(kept.items()), 5, 80)
    kept = {c if n else i: kept[c if n else i] for i, n, c in groups}
    items = decontamination.Items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], short_items=True)
    kept = {i: t for i, t in kept.items() if not items.find(t, decontamination.COVERAGE)}
    got = pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(kept) and len(got) == len(kept)
    lattice = pieces.lattice(P.path("piece_bpe_32k.model"))
    assert all(r["round_trip"] and lattice.decode(r["ids"]) == (kept[r["doc_id"]] or "") for r in got)
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_leave_nothing_behind(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(scratch, "scratch_root", lambda _: f"file://{tmp_path}/shared")
    with scratch.scratch(spark):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs]
