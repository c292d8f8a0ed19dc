"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become sequences of words (runs of letters and digits, lower-cased). Runs of
MIN_MATCH words whose rolling (Karp-Rabin) hash is that of a run of an item seed a match; seeds are compared
word by word, so a hash collision costs time only. Matches of a document and an item are tiled: the longest
match free of earlier tiles is marked, again and again, until none of MIN_MATCH words is left. The share of
the item's words that tiles cover decides; tiles may stand in any order, so reordered passages count.

The join of seeds is a broadcast one: items come in blocks of a bounded size, and documents never shuffle. If there are
several blocks, one pass with a filter of the items' runs, of fixed size, finds the documents that share any; the blocks
meet only these. Before an item is tiled, the words that all its seeds span must reach the threshold; and of equal
stretches of a document no more are tried than the item can hold tiles. So work on a document is in proportion to its
own words and the items it may cover.

Defined results: null and empty texts and items match nothing; nor do items of fewer than MIN_MATCH words, unless
`short_items` is set: then such an item is found where all its words stand in one run;
rows equal in id are reported each for itself; an empty table of either kind gives an empty result; other
columns are ignored by `find_contamination` and kept by `drop_contaminated`.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hold, lean, ship, stored, union_all

#: Words of a tile at least, and the share of an item's words that tiles must cover.
MIN_MATCH, COVERAGE = 5, 0.5
#: Bytes of item text in a block: bounds what is broadcast and what a worker holds.
BLOCK_BYTES = 8_000_000
#: Bits of the filter that finds the documents to hold against several blocks.
FILTER_BITS = 1 << 27
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2^64) of each run of k ids."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k):
        out = out * _BASE + ids[j : j + len(out)].astype(np.uint64)
    return out


def tile(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in doc, words). seeds: places of equal runs of k words."""
    runs: list[list[int]] = []
    for i, j in sorted(seeds, key=lambda s: (s[1] - s[0], s[0])):
        if runs and j - i == runs[-1][1] - runs[-1][0] and i <= runs[-1][0] + runs[-1][2] - k + 1:
            runs[-1][2] = i - runs[-1][0] + k
        else:
            runs.append([i, j, k])
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    item_free, doc_free, tiles = np.ones(len(item), bool), np.ones(len(doc), bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = item_free[i : i + n] & doc_free[j : j + n]
        if free.all():
            item_free[i : i + n] = doc_free[j : j + n] = False
            tiles.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what is left of it
            if b - a >= k:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return sorted(tiles)


class Items:
    """A block of benchmark items, ready to be held against documents."""

    def __init__(self, rows: list[tuple[int, str]], k: int = MIN_MATCH, short_items: bool = False):
        self.k, self.vocabulary, self.items = k, {}, {}
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}  # by number of words: the items of those words
        for n, (item_id, text) in enumerate(rows):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            if len(ids) >= k:
                self.items[n] = (item_id, ids)
                for p, h in enumerate(_rolling(ids, k).tolist()):
                    postings[h].append((n, p))
            elif short_items and len(ids):
                self.items[n] = (item_id, ids)
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids.tolist()), []).append(n)
        self.postings = dict(postings)
        self.hashes = np.array(sorted(self.postings), np.uint64)

    def find(self, text: str | None, coverage: float = 0.0) -> list[tuple[int, float, int, int, list[tuple[int, int, int]]]]:
        """(item id, coverage, words covered, words of the item, tiles) of each item that shares a run and is covered
        that much."""
        ids = np.fromiter(map(self.vocabulary.get, words_of(text), repeat(0)), np.int64)
        out = self._tiled(ids, coverage)
        if self.short:
            out += self._whole(ids)
        return out

    def _whole(self, ids: np.ndarray) -> list[tuple[int, float, int, int, list[tuple[int, int, int]]]]:
        """The short items that stand in a text, each at its first place."""
        first: dict[int, int] = {}
        own = ids.tolist()
        for size, items in self.short.items():
            for j, run in enumerate(zip(*(own[a:] for a in range(size)), strict=False)):
                for n in items.get(run, ()):
                    first.setdefault(n, j)
        return [(self.items[n][0], 1.0, size, size, [(0, j, size)]) for n, j in sorted(first.items()) for size in (len(self.items[n][1]),)]

    def _tiled(self, ids: np.ndarray, coverage: float) -> list[tuple[int, float, int, int, list[tuple[int, int, int]]]]:
        k = self.k
        if len(ids) < k or not len(self.hashes):
            return []
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        at = np.flatnonzero(known[k:] - known[:-k] == k)
        if not len(at):
            return []
        hashes = _rolling(ids, k)[at]
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes
        at, hashes = at[hit], hashes[hit]
        wanted = self._reachable(set(hashes.tolist()), coverage)
        if not wanted:
            return []
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for j, h, copy in zip(at.tolist(), hashes.tolist(), _copies(ids, at, k), strict=True):
            for n, p in self.postings[h]:
                if copy < wanted.get(n, 0) and (self.items[n][1][p : p + k] == ids[j : j + k]).all():
                    seeds[n].append((p, j))
        out = []
        for n, pairs in sorted(seeds.items()):
            item_id, item = self.items[n]
            tiles = tile(item, ids, pairs, k)
            covered = sum(t[2] for t in tiles)
            if covered / len(item) >= coverage:
                out.append((item_id, covered / len(item), covered, len(item), tiles))
        return out

    def _reachable(self, hashes: set[int], coverage: float) -> dict[int, int]:
        """Items whose runs of these hashes could cover enough of them, and how many tiles they can hold at most."""
        runs: dict[int, list[int]] = defaultdict(list)
        for h in hashes:
            for n, p in self.postings[h]:
                runs[n].append(p)
        out = {}
        for n, places in runs.items():
            places.sort()
            size = len(self.items[n][1])
            if (sum(min(self.k, b - a) for a, b in zip(places, places[1:], strict=False)) + self.k) / size >= coverage:
                out[n] = size // self.k
        return out


def _copies(ids: np.ndarray, at: np.ndarray, k: int) -> list[int]:
    """Of each seed place how many equal stretches of neighbouring seeds come before its own. An item's tiles take the
    first copies, a tile each, so copies beyond an item's number of tiles change nothing."""
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    met: dict[bytes, int] = {}
    out = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
        stretch = ids[at[a] : at[b - 1] + k].tobytes() if b > a else b""
        met[stretch] = copy = met.get(stretch, -1) + 1
        out += [copy] * (b - a)
    return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """Blocks of (item id, text), one after another; the driver holds one block at a time."""
    rows, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter(F.col("t") != "").toLocalIterator():
        rows.append((r["i"], r["t"]))
        held += len(r["t"])
        if held >= block_bytes:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


SCHEMA = "coverage double, matched_words long, item_words long, tiles string"


def _seed_filter(benchmark: DataFrame, min_match: int, short_items: bool) -> np.ndarray:
    """A bitmap of the slots of all items' runs of hashed words, of FILTER_BITS: what is broadcast when the items are
    more than a block. A short item's slot is that of its words."""
    items, size = benchmark.select(F.col("text").alias("t")).filter(F.col("t") != ""), FILTER_BITS

    def slots(batches):
        own = np.zeros(size, bool)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                hashed = _hashed_words(t)
                if len(hashed) >= min_match or short_items:
                    own[_slots(hashed, min(min_match, len(hashed)), size)] = True
        packed = np.packbits(own, bitorder="little")
        parts = [a for a in range(0, len(packed), 1 << 12) if packed[a : a + (1 << 12)].any()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int64()), "bits": pa.array([packed[a : a + (1 << 12)].tobytes() for a in parts], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for r in items.mapInArrow(lean(slots), "part long, bits binary").toLocalIterator():
        own = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] : r["part"] + len(own)] |= own
    return out


def _hashed_words(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words_of(text)], np.uint64)


def _slots(hashed: np.ndarray, k: int, size: int) -> np.ndarray:
    """Where the runs of k hashed words are in a filter of `size` bits, a power of two."""
    return (_rolling(hashed, k) * _BASE >> np.uint64(65 - size.bit_length())).astype(np.int64) if len(hashed) else np.zeros(0, np.int64)


def _suspects(docs: DataFrame, benchmark: DataFrame, min_match: int, short_items: bool, text_col: str, flag: str) -> DataFrame:
    """`docs` with a flag: whether any run of the text has its slot in the items' filter."""
    from pyspark.sql.pandas.functions import arrow_udf

    shared = docs.sparkSession.sparkContext.broadcast(_seed_filter(benchmark, min_match, short_items))
    sizes, size = range(1, min_match + 1) if short_items else [min_match], FILTER_BITS

    @arrow_udf("boolean")
    def suspect(texts: pa.Array) -> pa.Array:
        bits, out = shared.value, []
        for t in texts:
            hashed = _hashed_words(t.as_py())
            at = [_slots(hashed, k, size) for k in sizes if len(hashed) >= k]
            out.append(any(((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1).any() for x in at))
        return pa.array(out, pa.bool_())

    return docs.withColumn(flag, suspect(F.col(text_col)))


def _several(benchmark: DataFrame) -> bool:
    """Whether the items are more than a block."""
    blocks = item_blocks(benchmark)
    return next(blocks, None) is not None and next(blocks, None) is not None


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, id_col: str = "doc_id", text_col: str = "text", short_items: bool = False) -> DataFrame:
    """Pairs of a document and an item that it covers: doc_id, item_id, coverage, matched_words, item_words and
    tiles ("item place:document place:words", counted in words)."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if _several(benchmark):  # all documents are read once, and only the suspects again for each block
        narrow = stored(_suspects(narrow, benchmark, min_match, short_items, "text", "suspect").filter("suspect").drop("suspect"), "suspects")
    frames = []
    for rows in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(rows, min_match, short_items))
        names = pa.schema([(id_col, pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("item_words", pa.int64()), ("tiles", pa.string())])

        def search(batches, shared=shared, names=names):
            hold("items", lambda: None)
            items = shared.value
            for batch in batches:
                found = []
                for i, text in zip(batch.column(0), batch.column(1), strict=True):
                    for item_id, share, covered, total, tiles in items.find(text.as_py(), coverage):
                        found.append((i.as_py(), item_id, share, covered, total, ",".join(f"{a}:{b}:{n}" for a, b, n in tiles)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), names, strict=True)], schema=names)

        frames.append(narrow.mapInArrow(lean(search), f"`{id_col}` long, item_id long, {SCHEMA}"))
    return union_all(frames) if frames else spark.createDataFrame([], f"`{id_col}` long, item_id long, {SCHEMA}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, text_col: str = "text", short_items: bool = False) -> DataFrame:
    """The rows of `docs` that cover no item."""
    spark, out, clean = docs.sparkSession, docs, None
    ship(spark)
    (flag,) = fresh(docs, "contaminated")
    if _several(benchmark):  # one pass tells the suspects; only they meet the blocks
        marked = _suspects(docs, benchmark, min_match, short_items, text_col, flag)
        clean = marked.filter(~F.col(flag)).select(*docs.columns)
        out = stored(marked.filter(F.col(flag)).select(*docs.columns), "suspects")
    for rows in item_blocks(benchmark):
        hit = _covers(spark.sparkContext.broadcast(Items(rows, min_match, short_items)), coverage)
        out = out.withColumn(flag, hit(F.col(text_col))).filter(~F.col(flag)).select(*docs.columns)
    return out if clean is None else clean.unionByName(out)


def _covers(shared, coverage: float):
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        return pa.array([bool(shared.value.find(t.as_py(), coverage)) for t in texts], pa.bool_())

    return hit
