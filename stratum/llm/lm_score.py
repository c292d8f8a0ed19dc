"""Language-model scores from a log-frequency Bloom filter.

Texts are read once into slabs: the distinct word hashes of some documents and each token's place among them.
Every word and every pair of neighbouring words (v w) of a slab is an n-gram with its count in the slab's
training texts. N-grams are dealt by hash into parts, whose number grows with the corpus; a part adds up the
counts, quantises them to 1 + floor(log2 count) and puts (n-gram, 1) ... (n-gram, q) into its own piece of the
Bloom filter, of BITS_EACH bits an entry. No word and no pair is left out. The same part answers the slabs: it
probes (n-gram, 1), (n-gram, 2), ... until one is absent, and the answers go back to the slabs. With them
    p(w | v) = (c(v w) + MU * p(w)) / (c(v) + MU),   p(w) = (c(w) + 1) / (N + V + 1).

The base score wants exact counts of words; the part that holds a word sends its exact count along.

Defined results: null and empty texts are one end token; a null id is not held out; with no training text all
counts are 0; rows equal in id are scored each for itself; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, hold, lean, ship, stored
from .shingles import _STEP, _mixed, word_hashes

#: Tokens of a slab (more only for a longer text) and, about, n-grams that a part receives.
SLAB, PART = 1 << 20, 1 << 20
BITS_EACH, PROBES, BLOCK_BITS, MU = 14, 6, 1 << 15, 40.0
#: Texts that are split together: rows and bytes at most.
SLICE_ROWS, SLICE_BYTES = 2_000, 2 << 20
_END, _START, _DEAL = np.uint64(0x5EED0E0D), np.uint64(0x57A27), np.uint64(0xD6E8FEB86659FD93)


def held_out(c: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(c.cast("string"), "UTF-8")), F.lit(7)) == 2, F.lit(False))


def token_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the hashes of its words and of the end token."""
    hashes, ends = word_hashes(texts)
    return [np.append(hashes[a:b], _END) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(v * _STEP) + w)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order of appearance, and the place of each of x among them."""
    coded = pa.array(x).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


@cache
def _zipper():
    return zstd.ZstdCompressor(level=1), zstd.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    """Compressed, the bytes of one significance after those of another."""
    return _zipper()[0].compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def _unpacked(data, kind: str) -> np.ndarray:
    got = np.frombuffer(_zipper()[1].decompress(data), np.uint8)
    return np.ascontiguousarray(got.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def quantised(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of a count class; 0 of level 0."""
    return np.where(level == 0, 0.0, (3.0 * np.exp2(level - 1.0) - 1) / 2)


class LogFrequencyFilter:
    """Blocks of bits, all bits of an n-gram in one of them; `level` gives an n-gram's count class, 0 if it is absent."""

    def __init__(self, blocks: int):
        self.blocks, self.bits = blocks, np.zeros(blocks * BLOCK_BITS // 8, np.uint8)

    @classmethod
    def of(cls, gram: np.ndarray, n: np.ndarray) -> LogFrequencyFilter:
        """Holds all of these distinct n-grams, of counts over 0."""
        q = quantised(n)
        out = cls(max(1, -(-int(q.sum()) * BITS_EACH // BLOCK_BITS)))
        bits = np.zeros(out.blocks * BLOCK_BITS, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            deep = gram[q >= level]
            first = out.first(deep)
            for probe in range(PROBES):
                bits[first + out.places(deep, level, probe)] = True
        out.bits = np.packbits(bits, bitorder="little")
        return out

    @staticmethod
    def places(gram: np.ndarray, level: int, probe: int) -> np.ndarray:
        return (_mixed(gram + np.uint64((level * 64 + probe + 1) * int(_STEP) % 2**64)) >> np.uint64(49)).astype(np.int64)

    def first(self, gram: np.ndarray) -> np.ndarray:
        """Where an n-gram's block begins."""
        return (_mixed(gram ^ _STEP) % np.uint64(self.blocks)).astype(np.int64) * BLOCK_BITS

    def level(self, gram: np.ndarray) -> np.ndarray:
        level, live, q = np.zeros(len(gram), np.int64), np.arange(len(gram)), 1
        while len(live) and q < 64:
            for probe in range(PROBES):
                own = gram[live]
                at = self.first(own) + self.places(own, q, probe)
                live = live[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            level[live] = q
            q += 1
        return level

    def count(self, gram: np.ndarray) -> np.ndarray:
        """The middle of each n-gram's count class."""
        return middle(self.level(gram))


class Slab:
    """Some documents as word places, and their n-grams: the words, the start, the pairs."""

    def __init__(self, lengths: bytes, held: bytes, vocabulary: bytes, tokens: bytes):
        self.lengths, self.held = np.frombuffer(lengths, "<i8"), np.frombuffer(held, bool)
        own, self.tokens = np.frombuffer(vocabulary, "<u8"), _unpacked(tokens, "<i4").astype(np.int64)
        self.words, self.starts = len(own), np.cumsum(self.lengths) - self.lengths
        every = np.append(own, _START)
        self.before = np.concatenate([[self.words], self.tokens[:-1]])
        self.before[self.starts] = self.words
        pairs, self.pair = _distinct(self.before * len(every) + self.tokens)
        self.grams = np.concatenate([every, _pair(every[pairs // len(every)], every[pairs % len(every)])])

    def trained(self) -> np.ndarray:
        """Counts of the n-grams in the documents that are not held out."""
        mask = np.repeat(~self.held, self.lengths)
        return np.concatenate([np.bincount(self.tokens[mask], minlength=self.words), [(~self.held).sum()], np.bincount(self.pair[mask], minlength=len(self.grams) - self.words - 1)]).astype(np.int64)

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams by part, where in that order each part begins and ends)."""
        part = _mixed(self.grams ^ _DEAL) % np.uint64(parts)
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1).astype(np.uint64))

    def scores(self, level: np.ndarray, exact: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document the words known, the base score and the score. level: of each n-gram; exact: counts of
        the words; total: N + V + 1."""
        counts = middle(level)
        single, behind = (counts[self.tokens] + 1) / total, counts[self.before]
        seen = np.minimum(counts[self.words + 1 + self.pair], behind)
        logs = np.log10(np.minimum((seen + MU * single) / (behind + MU), 1.0))
        base = (np.log10(exact + 1.0) - np.log10(total))[self.tokens]
        return np.add.reduceat((exact > 0)[self.tokens].astype(np.int64), self.starts), np.add.reduceat(base, self.starts), np.add.reduceat(logs, self.starts)


_SLAB = "slab long, ids array<long>, n_tokens long, train_tokens long, lengths binary, held binary, vocabulary binary, tokens binary"


def read_slabs(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """The documents as stored slabs."""
    slices = SLICE_ROWS, SLICE_BYTES

    def cut(batches):
        hold("slabs", lambda: None)
        nth, ids, held, got, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def slab():
            lengths, out = np.array([len(g) for g in got], "<i8"), np.array(held, bool)
            own, at = _distinct(np.concatenate(got))
            return pa.RecordBatch.from_pydict(
                {
                    "slab": pa.array([nth], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                    "n_tokens": pa.array([size], pa.int64()), "train_tokens": pa.array([int(lengths[~out].sum())], pa.int64()),
                    "lengths": pa.array([lengths.tobytes()], pa.binary()), "held": pa.array([out.tobytes()], pa.binary()),
                    "vocabulary": pa.array([own.astype("<u8").tobytes()], pa.binary()), "tokens": pa.array([_packed(at.astype("<i4"))], pa.binary()),
                }
            )

        for batch in batches:
            for a, b in byte_slices(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(), *slices):
                for i, out, tokens in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), token_hashes(batch.column(2)[a:b]), strict=True):
                    ids.append(i)
                    held.append(out)
                    got.append(tokens)
                    size += len(tokens)
                    if size >= most:
                        yield slab()
                        nth, ids, held, got, size = nth + 1, [], [], [], 0
        if ids:
            yield slab()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    return stored(narrow.mapInArrow(lean(cut), _SLAB), "slabs")


def _opened(batch: pa.RecordBatch, k: int) -> Slab:
    return Slab(*(batch.column(c)[k].as_py() for c in ("lengths", "held", "vocabulary", "tokens")))


_ANSWER = "slab long, part long, levels binary, counts binary, new_words long"


def _answers(slabs: DataFrame, parts: int) -> DataFrame:
    """Stored answers of the parts: of a slab's n-grams in a part the levels, and the exact counts of its words.
    new_words: in one row of each part, the distinct training words that it holds."""

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                slab = _opened(batch, k)
                n, (order, ends) = slab.trained(), slab.dealt(parts)
                grams, n, is_word = slab.grams[order], n[order].astype("<u4"), order < slab.words
                spans = [(p, a, b) for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
                for a in range(0, len(spans), 64):
                    some = spans[a : a + 64]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "slab": pa.array([batch.column("slab")[k].as_py()] * len(some), pa.int64()), "part": pa.array([p for p, _, _ in some], pa.int64()),
                            "words": pa.array([int(is_word[x:y].sum()) for _, x, y in some], pa.int64()),
                            "grams": pa.array([grams[x:y].tobytes() for _, x, y in some], pa.binary()), "n": pa.array([_packed(n[x:y]) for _, x, y in some], pa.binary()),
                        }
                    )

    def answered(part, rows):
        sizes = np.array([len(g) for _, _, g, _ in rows])
        own, at = _distinct(np.concatenate([g for _, _, g, _ in rows]))
        n = np.zeros(len(own), np.int64)
        np.add.at(n, at, np.concatenate([x for _, _, _, x in rows]))
        level = LogFrequencyFilter.of(own[n > 0], n[n > 0]).level(own).astype(np.uint8)
        is_word, begin = np.zeros(len(own), bool), 0
        out = []
        for (slab, k, _, _), size in zip(rows, sizes.tolist(), strict=True):
            here = at[begin : begin + size]
            is_word[here[:k]] = True
            out.append((slab, _packed(level[here]), _packed(n[here[:k]].astype("<i8"))))
            begin += size
        fresh = int((is_word & (n > 0)).sum())
        yield pa.RecordBatch.from_pydict(
            {
                "slab": pa.array([s for s, _, _ in out], pa.int64()), "part": pa.array([part] * len(out), pa.int64()),
                "levels": pa.array([x for _, x, _ in out], pa.binary()), "counts": pa.array([x for _, _, x in out], pa.binary()),
                "new_words": pa.array([fresh] + [0] * (len(out) - 1), pa.int64()),
            }
        )

    def answer(batches):
        part, rows = None, []
        for batch in batches:
            for s, p, k, g, n in zip(*(batch.column(c) for c in ("slab", "part", "words", "grams", "n")), strict=True):
                if rows and p.as_py() != part:
                    yield from answered(part, rows)
                    rows = []
                part = p.as_py()
                rows.append((s.as_py(), k.as_py(), np.frombuffer(g.as_buffer(), "<u8"), _unpacked(n.as_buffer(), "<u4")))
        if rows:
            yield from answered(part, rows)

    asked = slabs.mapInArrow(lean(ask), "slab long, part long, words long, grams binary, n binary")
    return stored(asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(answer), _ANSWER), "answers")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship(docs.sparkSession)
    slabs = read_slabs(docs, id_col, text_col, SLAB)
    tokens, train_tokens = slabs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    parts = max(1, -(-tokens // PART))
    answers = _answers(slabs, parts)
    distinct = answers.agg(F.coalesce(F.sum("new_words"), F.lit(0))).first()[0]

    def scored(ids, slab, rows):
        order, _ = slab.dealt(parts)
        level, exact = np.zeros(len(order), np.int64), np.zeros(slab.words, np.int64)
        level[order] = np.concatenate([_unpacked(x, "u1") for _, x, _ in rows])
        exact[order[order < slab.words]] = np.concatenate([_unpacked(x, "<i8") for _, _, x in rows])
        known, base, score = slab.scores(level, exact, train_tokens + distinct + 1)
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "held_out": pa.array(slab.held), "n_tokens": slab.lengths.astype(np.int64), "n_known": known, "base_score": base, "score": score})

    def score(batches):
        slab, rows = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if (part := batch.column("part")[k].as_py()) < 0:
                    if slab is not None:
                        yield scored(ids, slab, rows)
                    ids, slab, rows = batch.column("ids")[k].as_py(), _opened(batch, k), []
                else:
                    rows.append((part, batch.column("levels")[k].as_py(), batch.column("counts")[k].as_py()))
        if slab is not None:
            yield scored(ids, slab, rows)

    # A slab comes before its answers, and these in order of part.
    both = slabs.withColumn("part", F.lit(-1).cast("long")).unionByName(answers.drop("new_words"), allowMissingColumns=True)
    out = both.repartition("slab").sortWithinPartitions("slab", "part").mapInArrow(lean(score), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
