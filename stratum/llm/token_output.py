"""Token ids as binary files of Simple-8b words.

Coding. A word is 64 bits: the top 4 select how many ids of how many bits fill the other 60. Selector 0 is an
escape: the next word holds one id raw, for ids of over 60 bits. Selector 1 stands for 120 zeros. A block of
4096 ids starts at a word of its own, and a table of word offsets lets blocks be decoded alone or all at once:
every word's id count follows from its selector, a cumulative sum places its ids, and each selector's words
are unpacked together.

A file is a run of segments. Segment: magic, counts (documents, ids, block length, blocks, words), validity byte and
id of each document, token count of each document, word offset of each block, words. All integers are little-endian.

Files hold documents in ascending id order. Writers deal documents out by id range, sort each range and begin another
segment, and another file, at a bounded number of ids; no more than a segment is held in memory. Where a file's ids
begin follows from the files before it: sums within groups of partitions, and sums of the groups.

Defined results: a null or empty text gives the end id alone; null ids come first; rows equal in id stand side
by side; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, hold, lean, scratch_path, ship, stored
from .files import attempt_name, new_file, read_file

MAGIC = b"S8BIDS01"
BLOCK = 4096
#: Ids of a segment and of a file at which another begins, rows of a range partition aimed at, and partitions whose
#: files are summed together.
SEGMENT_IDS, FILE_IDS, PARTITION_ROWS, GROUP = 2_000_000, 64_000_000, 100_000, 1024
#: Texts that are encoded together: rows and bytes at most.
SLICE_ROWS, SLICE_BYTES = 1_500, 5 << 20
#: Words a worker remembers the ids of.
CACHE_WORDS = 800_000

#: Fixed values of the format: (ids, bits of each) by selector from 2 on.
LANES = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE, ZEROS, ZERO_RUN = 0, 1, 120
_POWERS = np.array([1 << k for k in range(64)], np.uint64)
_LENGTHS = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)  # bits of small ids
_COUNTS = np.array([1, ZERO_RUN, *(c for c, _ in LANES)], np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and of the end) of uint64 ids. All blocks advance together."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    padded = np.zeros(blocks * BLOCK + ZERO_RUN, np.uint64)
    padded[:n] = ids
    most = int(padded.max())
    length = _LENGTHS[padded] if most < len(_LENGTHS) else np.searchsorted(_POWERS, padded, side="right").astype(np.uint8)
    left = np.minimum(blocks * BLOCK, n) - np.arange(blocks * BLOCK)
    np.minimum(left, BLOCK - np.arange(blocks * BLOCK) % BLOCK, out=left)
    left = np.minimum(left, ZERO_RUN).astype(np.uint8)
    choice = np.full(blocks * BLOCK, ESCAPE, np.uint8)
    # The longest of the next `count` bit lengths, by windows that double; the lanes go from short to long and longer ones win.
    window, span = length, 1
    for s, (count, bits) in reversed([(ZEROS, (ZERO_RUN, 0)), *enumerate(LANES, 2)]):
        if np.count_nonzero(length <= bits) < count:
            continue
        while span * 2 <= count:
            window = np.maximum(window[:-span], window[span:])
            span *= 2
        most = np.maximum(window[: blocks * BLOCK], window[count - span : count - span + blocks * BLOCK]) if count > span else window[: blocks * BLOCK]
        fits = (most <= bits) & (left >= count)
        np.putmask(choice, fits, s)
    size = _COUNTS[choice]
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    steps, live = [], at < end
    while live.any():
        steps.append(np.where(live, at, -1))
        at = np.where(live, at + size[np.minimum(at, blocks * BLOCK - 1)], at)
        live = at < end
    grid = np.array(steps).T
    starts, owner = grid[grid >= 0], np.repeat(np.arange(blocks), (grid >= 0).sum(1))
    chosen = choice[starts]
    width = 1 + (chosen == ESCAPE)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(LANES, 2):
        mine = chosen == s
        if mine.any():
            p, q = place[mine], starts[mine]
            for k in range(count):
                words[p] |= padded[q + k] << np.uint64(k * bits)
    raw = chosen == ESCAPE
    words[place[raw] + 1] = padded[starts[raw]]
    offsets = np.zeros(blocks + 1, np.uint64)
    offsets[1:] = np.cumsum(np.bincount(owner, weights=width, minlength=blocks).astype(np.uint64))
    return words, offsets


def unpack(words: np.ndarray) -> np.ndarray:
    """The uint64 ids of whole blocks."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():  # the word after an escape is no selector word; escapes can be neighbours
        raw, k = np.zeros(len(words), bool), 0
        for k in np.flatnonzero(selector == ESCAPE).tolist():
            if not raw[k]:
                raw[k + 1] = True
    else:
        raw = np.zeros(len(words), bool)
    counts = _COUNTS[selector].astype(np.int64)
    counts[raw] = 0
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(LANES, 2):
        mine = (selector == s) & ~raw
        if mine.any():
            w, p = words[mine], place[mine]
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[p + k] = (w >> np.uint64(k * bits)) & mask
    escaped = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[place[escaped]] = words[escaped + 1]
    return out


def encode_file(doc_ids: list, counts: list[int] | np.ndarray, ids: np.ndarray) -> list[bytes]:
    words, offsets = pack(ids.astype(np.uint64))
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    return [
        MAGIC,
        struct.pack("<5Q", len(doc_ids), len(ids), BLOCK, len(offsets) - 1, len(words)),
        valid.tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array(counts, "<u4").tobytes(),
        offsets.astype("<u8").tobytes(),
        words.astype("<u8").tobytes(),
    ]


def decode_segment(data, at: int = 0) -> tuple[list, np.ndarray, np.ndarray, int]:
    """(document ids, token counts, ids) of the segment at `at`, and the offset after it."""
    if bytes(data[at : at + 8]) != MAGIC:
        raise ValueError("not a token file")
    docs, n, _, blocks, n_words = struct.unpack_from("<5Q", data, at + 8)
    at += 48
    valid = np.frombuffer(data, np.uint8, docs, at)
    doc_ids = np.frombuffer(data, "<i8", docs, at + docs).tolist()
    counts = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 13 * docs + 8 * (blocks + 1)
    ids = unpack(np.frombuffer(data, "<u8", n_words, at))
    if len(ids) != n or int(counts.sum(dtype=np.int64)) != n:
        raise ValueError("token file is damaged: the counts differ")
    return [i if v else None for i, v in zip(doc_ids, valid.tolist(), strict=True)], counts, ids, at + 8 * n_words


# With this library's byte-level pattern a space between texts always starts a token, a newline between texts is
# one, and so does punctuation after a letter or digit; so words can be encoded alone. Texts with other white
# space or an added token's string take the whole-text path, and so do all texts of a tokenizer of another kind.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
_FIRST = "\0"  # marks a word with no space before it
#: Texts that cannot be cut at spaces and newlines: with white space at an end or side by side, other white space, or _FIRST.
_ODD = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00\t\x0B-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class WordEncoder:
    """Encodes whole texts with a tokenizers file; ids of words met before come from a bounded memory."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.by_words = kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.odd = "|".join([_ODD, *(re.escape(t["content"]) for t in kind.get("added_tokens") or ())])
        self.newline = int(np.frombuffer(self._whole(["\n"])[0], "<u4")[0]) if self.by_words else None
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded as one text with a newline after each."""
        out = []
        for a in range(0, len(words), 5_000):
            part = words[a : a + 5_000]
            ids = np.frombuffer(self._whole(["".join(w + "\n" for w in part)])[0], "<u4")
            ends = np.flatnonzero(ids == self.newline)
            flat, lo = ids.tobytes(), 0
            if len(ends) != len(part):
                raise ValueError("this tokenizer does not keep a newline between words as a token of its own")
            for hi in (ends * 4).tolist():
                out.append(flat[lo:hi])
                lo = hi + 4
        return out

    def _learn(self, words: list[str]) -> None:
        """A word stands for itself after a space; after _FIRST or a newline, for itself without one. Marks that
        end a word after a letter or digit are tokens of their own, so such a word has its parts' ids."""
        tails, bases = [], set()
        for k in words:
            base = k.rstrip(_MARKS)
            if base and base != k and base[-1].isalnum():
                tail = _FIRST + k[len(base) :]
                tails.append((k, base, tail))
                bases.add(tail)
                bases.add(base)
            else:
                bases.add(k)
        spaced, bare = [], []
        for k in bases:
            if k not in self.known:
                (bare if k[0] in "\0\n" else spaced).append(k)
        self.known.update(zip(spaced, self._words([" " + k for k in spaced]), strict=True))
        newline = np.array([self.newline], "<u4").tobytes()
        for k, ids in zip(bare, self._words([k[1:] for k in bare]), strict=True):
            self.known[k] = newline + ids if k[0] == "\n" else ids
        for k, base, tail in tails:
            self.known[k] = self.known[base] + self.known[tail]

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each text) of texts that split into words. Arrow splits them and numbers their words, so
        only a batch's distinct words are looked up."""
        marked = pc.binary_join_element_wise(pa.scalar(_FIRST, texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), CACHE_WORDS // 2))  # those met first tend to be frequent
        ids_of = list(map(self.known.get, words))
        new = [k for k, ids in enumerate(ids_of) if ids is None]
        self._learn([words[k] for k in new])
        for k in new:
            ids_of[k] = self.known[words[k]]
        taken = pa.array(ids_of, pa.large_binary()).take(coded.indices)
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64, len(taken) + 1) // 4
        before = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return np.frombuffer(data, "<u4", int(ends[-1])), np.diff(before)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as little-endian uint32, count of each text)."""
        texts = texts.cast(pa.large_string())
        if self.by_words:
            odd = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring_regex(texts, self.odd)).to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(texts), bool)
        ids, counts = np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        if not odd.all():
            ids, counts[~odd] = self._batch(texts.filter(pa.array(~odd)) if odd.any() else texts)
        if odd.any():
            own = [np.frombuffer(x, "<u4") for x in self._whole(texts.filter(pa.array(odd)).to_pylist())]
            ends = np.cumsum(counts)
            pieces, last = [], 0
            for k, x in zip(np.flatnonzero(odd).tolist(), own, strict=True):
                pieces += (ids[last : ends[k]], x)
                last = ends[k]
                counts[k] = len(x)
            ids = np.concatenate([*pieces, ids[last:]])
        return ids, counts


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _slices(lengths: np.ndarray):
    return byte_slices(lengths, SLICE_ROWS, SLICE_BYTES)


_MANIFEST = pa.schema([("place", pa.int64()), ("nth", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text of `docs`, append `end_id` and write the files. Returns the stored manifest: a
    row per file (place, nth, file, docs, ids), in order of place and nth."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))

    slices, most = (SLICE_ROWS, SLICE_BYTES), (SEGMENT_IDS, FILE_IDS)

    def segments(batches):
        """(documents, ids, byte strings) of one segment after another."""
        encoder = word_encoder(tokenizer_path)
        doc_ids, counts, held, total = [], [], [], 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in byte_slices(pc.binary_length(texts).to_numpy(), *slices):
                ids, n = encoder.encode(texts[a:b])
                ends = np.cumsum(n)
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(n) + 1)
                names, first, begin = batch.column(0)[a:b].to_pylist(), 0, 0
                while first < len(n):
                    # up to the document that fills the segment
                    last = min(int(np.searchsorted(ends, begin + most[0] - total)) + 1, len(n))
                    doc_ids += names[first:last]
                    counts.append(n[first:last] + 1)
                    held.append(ids[begin : ends[last - 1]])
                    total += int(ends[last - 1]) - begin
                    first, begin = last, int(ends[last - 1])
                    if total >= most[0]:
                        yield len(doc_ids), total, encode_file(doc_ids, np.concatenate(counts), np.concatenate(held))
                        doc_ids, counts, held, total = [], [], [], 0
        if doc_ids:
            yield len(doc_ids), total, encode_file(doc_ids, np.concatenate(counts), np.concatenate(held))

    def write(batches):
        hold("tokens", word_encoder.cache_clear)
        place, nth, coming = TaskContext.get().partitionId(), 0, segments(batches)
        while (segment := next(coming, None)) is not None:
            name, n_docs, n_ids = attempt_name(place, nth, "s8b"), 0, 0
            with new_file(folder, name) as f:
                while segment is not None:
                    f.writelines(segment[2])
                    n_docs, n_ids = n_docs + segment[0], n_ids + segment[1]
                    segment = next(coming, None) if n_ids < most[1] else None
            yield pa.RecordBatch.from_pylist([{"place": place, "nth": nth, "file": name, "docs": n_docs, "ids": n_ids}], schema=_MANIFEST)
            nth += 1

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = narrow.repartitionByRange(parts, "id").sortWithinPartitions("id")
    return stored(ranged.mapInArrow(lean(write), "place long, nth long, file string, docs long, ids long"), "manifest")


def _starts(manifest: DataFrame) -> DataFrame:
    """file and the number of ids before it. Groups of GROUP partitions are summed side by side; only their totals, a
    row for GROUP partitions, meet in one task."""
    grouped = manifest.withColumn("grp", F.expr(f"place div {GROUP}"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    ahead = grouped.groupBy("grp").agg(F.sum("ids").alias("all")).select("grp", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("grp").orderBy("place", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumn("inside", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(ahead, "grp").select("file", (F.col("ahead") + F.col("inside")).alias("before"))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Of each document, read from the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (little-endian
    unsigned 32-bit integers)."""
    ship(spark)
    schema = f"doc_id long, start long, n_tokens long, ids_crc32 long{', ids binary' * with_ids}"

    def read(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, at = read_file(f"{folder}/{name}"), 0
                while at < len(data):
                    doc_ids, counts, ids, at = decode_segment(data, at)
                    flat = ids.astype("<u4")
                    ends = np.cumsum(counts, dtype=np.int64)
                    starts = ends - counts
                    for a in range(0, len(doc_ids), 2000):
                        cut = [flat[s:e] for s, e in zip(starts[a : a + 2000].tolist(), ends[a : a + 2000].tolist(), strict=True)]
                        row = {"doc_id": pa.array(doc_ids[a : a + 2000], pa.int64()), "start": before + starts[a : a + 2000], "n_tokens": counts[a : a + 2000].astype(np.int64), "ids_crc32": pa.array(map(zlib.crc32, cut), pa.int64())}
                        if with_ids:
                            row["ids"] = pa.array([x.tobytes() for x in cut], pa.binary())
                        yield pa.RecordBatch.from_pydict(row)
                    before += len(ids)

    files = manifest.count()  # a task for each, but for very many
    return _starts(manifest).repartition(max(1, min(files, 10_000)), "file").mapInArrow(lean(read), schema)


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = scratch_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, tokenizer_path, folder, end_id, id_col, text_col)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(docs.sparkSession, folder, manifest, with_ids=False)
