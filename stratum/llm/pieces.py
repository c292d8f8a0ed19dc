"""SentencePiece encoding and decoding with N-best segmentations.

The pieces come from a SentencePiece model file. Its scores are merge ranks, not probabilities, so a piece of
rank r gets the Zipf log-probability -log(r + 2) - log(H); a character outside the vocabulary takes the file's
byte pieces at a lower price. The best segmentation is thus that of the unigram model with these scores, not
the merge order's; every segmentation decodes to the text exactly.

A text's lattice falls apart, exactly, wherever no piece spans two neighbouring characters; the parts are words
or less. For each part forward Viterbi gives the best score of every prefix. These are exact heuristics for a
search that goes backward from the end: A* over (node, score of the suffix so far) pops complete segmentations
in order of their score. Forward and backward scores also give the loss of the second best segmentation, so only
the parts with the least losses need the search to give a text's N best.

Defined results: a null or empty text has no pieces, score 0 and one segmentation; a text with fewer than N
segmentations gives what it has; segmentations of equal score come in the order of the search, which is the
same each time; rows equal in id are encoded each for itself; other columns are ignored by `encode_texts`.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, hold, lean, ship

#: Segmentations of a text, price of a byte over the rarest piece, chunks a worker remembers.
N_BEST, BYTE_PRICE, CACHE_CHUNKS = 3, 3.0, 60_000
#: Characters of a chunk that is searched together with others, cells of such a search, and the texts of one step:
#: rows and bytes at most.
LONGEST, CELLS, SLICE_ROWS, SLICE_BYTES = 40, 1 << 19, 1_000, 1 << 20
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
#: Texts whose chunks are not just their words and newlines.
_ODD = r"\A[ \n]|  | \n| \z|\x00"
_SPACE = "▁"
_EMPTY, _PAD, _MULTIPLIER = np.uint64(2**64 - 1), (1 << 21) - 1, np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """Prefixes of the pieces as numbered nodes; `step` follows many edges at once by a hash table of (node, character)."""

    def __init__(self, reach: dict):
        number = {"": 0} | {p: k for k, p in enumerate(reach, 1)}
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in reach], np.uint64)
        nodes = np.array(list(map(number.__getitem__, reach)), np.int64)
        self.score = np.array([-math.inf] + [v[0] if v else -math.inf for v in reach.values()])
        self.id = np.array([0] + [v[1][0] if v else 0 for v in reach.values()], np.uint32)
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == _EMPTY
            at, first = np.unique(slot[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.keys[at], self.next[at] = keys[own], nodes[own]
            left = np.ones(len(keys), bool)
            left[own] = False
            keys, nodes, slot = keys[left], nodes[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The node after each edge, 0 where there is none."""
        keys = (node << 21 | character).astype(np.uint64)
        slot, out, live = self._slot(keys), np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(live):
            held = self.keys[slot]
            same = held == keys
            out[live[same]] = self.next[slot[same]]
            more = ~same & (held != _EMPTY)
            live, keys, slot = live[more], keys[more], (slot[more] + 1) & self.mask
        return out


class Lattice:
    """Pieces, scores and the search. `pieces`: (text with plain spaces, id, score); `bytes_ids`: id of each byte."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], byte_score: float):
        self.score = {p: (s, (i,)) for p, i, s in pieces}
        self.longest = max(map(len, self.score), default=1)
        self.reach = {p[:k]: None for p in self.score for k in range(1, len(p) + 1)} | self.score  # also what only starts a piece
        self.joined = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        if any(" " in p.lstrip(" ") for p in self.score) or any("\n" in p for p in self.score):
            raise ValueError("pieces with inner spaces or newlines are not supported")
        self.byte_ids, self.byte_score = byte_ids, byte_score
        self.text = {i: p.encode() for p, i, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.trie = Trie(self.reach)
        self.known: dict[str, tuple[bytes, float, float, bool]] = {}
        self.alternatives = lru_cache(maxsize=20_000)(self._n_best)

    def edges(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Of each end node the edges (start, score, ids) into it."""
        into: list[list] = [[] for _ in range(len(s) + 1)]
        for a, b, score, ids in self.flat_edges(s):
            into[b].append((a, score, ids))
        return into

    def flat_edges(self, s: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """(start, end, score, ids) by start, then end."""
        out, get, size = [], self.reach.get, len(s)
        for a in range(size):
            if (got := get(s[a], 0)) is None or got == 0:
                raw = s[a].encode("utf-8", "replace")
                out.append((a, a + 1, self.byte_score * len(raw), tuple([self.byte_ids[x] for x in raw])))
                if got == 0:
                    continue
            else:
                out.append((a, a + 1, got[0], got[1]))
            for b in range(a + 2, min(size, a + self.longest) + 1):
                if (got := get(s[a:b], 0)) is None:
                    continue
                if got == 0:
                    break
                out.append((a, b, got[0], got[1]))
        return out

    @staticmethod
    def forward(into) -> tuple[list[float], list]:
        """Viterbi: the best score of each prefix and the edge that gives it."""
        best, last = [0.0] + [-math.inf] * (len(into) - 1), [None] * len(into)
        for b in range(1, len(into)):
            for edge in into[b]:
                if (total := best[edge[0]] + edge[1]) > best[b]:
                    best[b], last[b] = total, edge
        return best, last

    def search(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids) of s by A* from its end."""
        into = self.edges(s)
        best, _ = self.forward(into)
        heap, count, out = [(-best[-1], 0, len(s), 0.0, None)], 0, []
        while heap and len(out) < n:
            f, _, node, suffix, path = heapq.heappop(heap)
            if node == 0:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((-f, tuple(ids)))
                continue
            for a, score, ids in into[node]:
                count += 1
                heapq.heappush(heap, (-(best[a] + suffix + score), count, a, suffix + score, (ids, path)))
        return out

    def _n_best(self, s: str, n: int) -> list[tuple[float, bytes]]:
        return [(score, np.array(ids, "<u4").tobytes()) for score, ids in self.search(s, n)]

    def _best(self, s: str) -> tuple[bytes, float, float]:
        """(ids, score, loss of the second best segmentation) of a part."""
        get, size, longest, none = self.reach.get, len(s), self.longest, -math.inf
        best, last, back, edges = [0.0] + [none] * size, [None] * (size + 1), [none] * size + [0.0], []
        for a in range(size):  # edges into a node come before those out of it
            so_far = best[a]
            got = get(s[a], 0)
            if got:
                edge = (a, a + 1, *got)
            else:
                raw = s[a].encode("utf-8", "replace")
                edge = (a, a + 1, self.byte_score * len(raw), tuple([self.byte_ids[x] for x in raw]))
            edges.append(edge)
            if so_far + edge[2] > best[a + 1]:
                best[a + 1], last[a + 1] = so_far + edge[2], edge
            if got == 0:
                continue
            for b in range(a + 2, min(size, a + longest) + 1):
                got = get(s[a:b], 0)
                if got:
                    edge = (a, b, *got)
                    edges.append(edge)
                    if so_far + got[0] > best[b]:
                        best[b], last[b] = so_far + got[0], edge
                elif got == 0:
                    break
        ids, used, node = [], set(), size
        while node:
            edge = last[node]
            used.add(edge)
            ids[:0] = edge[3]
            node = edge[0]
        second = none
        for edge in reversed(edges):  # the best path through each edge that the best one does not take
            a, b, score, _ = edge
            rest = score + back[b]
            if rest > back[a]:
                back[a] = rest
            if best[a] + rest > second and edge not in used:
                second = best[a] + rest
        return struct.pack(f"<{len(ids)}I", *ids), best[-1], best[-1] - second

    def parts(self, chunk: str) -> list[str]:
        cuts = [0, *(k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in self.joined), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Remember (ids, score, least loss, whether the ids decode to it) of chunks: short ones side by side, by
        length; a long one is the sum of its parts."""
        order = sorted(range(len(chunks)), key=lambda k: len(chunks[k]))
        short = [chunks[k] for k in order if 0 < len(chunks[k]) <= LONGEST]
        at = 0
        while at < len(short):
            most = max(1, CELLS // (self.longest * len(short[min(at + 2_000, len(short) - 1)])))
            self._learn_together(short[at : at + most])
            at += most
        for c in chunks:
            if c not in self.known:
                self._keep(c, [self._best(p) for p in self.parts(c)] if c else [])

    def _keep(self, chunk: str, parts: list[tuple[bytes, float, float]]) -> None:
        ids = b"".join(p[0] for p in parts)
        self.known[chunk] = ids, math.fsum(p[1] for p in parts), min((p[2] for p in parts), default=math.inf), self._bytes(ids) == chunk.encode("utf-8", "replace")

    def _learn_together(self, chunks: list[str]) -> None:
        """The search of `_best` over all chunks at once, a step per place and piece length; chunks with a character
        that is no piece are searched one by one."""
        n, sizes = len(chunks), np.array(list(map(len, chunks)))
        width, longest = int(sizes.max()), self.longest
        text = np.full((n, width + longest), _PAD, np.int64)
        inside = np.arange(width + longest) < sizes[:, None]
        text[inside] = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        row, at = np.nonzero(inside[:, :width])
        node, score, piece, most = np.zeros(len(row), np.int64), np.full((longest, width, n), -math.inf), np.zeros((longest, width, n), np.uint32), 1
        for k in range(longest):
            node = self.trie.step(node, text[row, at + k])
            live = np.flatnonzero(node)
            if not len(live):
                break
            row, at, node, most = row[live], at[live], node[live], k + 1
            score[k, at, row], piece[k, at, row] = self.trie.score[node], self.trie.id[node]
        score, piece = score[:most], piece[:most]
        whole = ~(np.isinf(score[0]) & inside[:, :width].T).any(0)
        best, size = np.full((width + 1, n), -math.inf), np.zeros((width + 1, n), np.int64)
        best[0], every = 0.0, np.arange(n)
        for b in range(1, width + 1):
            sizes_in = np.arange(min(b, most), 0, -1)  # the earliest start wins a tie
            into = best[b - sizes_in] + score[sizes_in - 1, b - sizes_in]
            pick = into.argmax(0)
            best[b], size[b] = into[pick, every], sizes_in[pick]
        used, node, live = np.zeros(score.shape, bool), sizes.copy(), every[whole]
        while len(live):
            k = size[node[live], live]
            node[live] -= k
            used[k - 1, node[live], live] = True
            live = live[node[live] > 0]
        back, second = np.full((width + most + 1, n), -math.inf), np.full(n, -math.inf)
        back[sizes, every] = 0.0
        for a in range(width - 1, -1, -1):
            rest = score[:, a] + back[a + 1 : a + 1 + most]
            np.maximum(back[a], rest.max(0), out=back[a])
            through = best[a] + rest
            through[used[:, a]] = -math.inf
            np.maximum(second, through.max(0), out=second)
        owner, place, kind = np.nonzero(used.transpose(2, 1, 0))
        ids, ends = piece[kind, place, owner].astype("<u4"), np.cumsum(np.bincount(owner, minlength=n)) * 4
        flat, total, begin = ids.tobytes(), best[sizes, every], 0
        good = self._bytes(flat) == "".join([c for c, w in zip(chunks, whole.tolist(), strict=True) if w]).encode("utf-8", "replace")
        for c, w, end, t, s in zip(chunks, whole.tolist(), ends.tolist(), total.tolist(), second.tolist(), strict=True):
            if not w:
                self._keep(c, [self._best(p) for p in self.parts(c)])
            elif good:  # edges have the length of their pieces, so each decodes to its own
                self.known[c] = flat[begin:end], t, t - s, True
            else:
                self._keep(c, [(flat[begin:end], t, t - s)])
            begin = end

    def _bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The n best segmentations of a whole text: (score, ids as little-endian uint32), best first."""
        return self.encode_many(pa.array([text], pa.large_string()), n)[0][0]

    def encode_many(self, texts: pa.Array, n: int = N_BEST) -> list[tuple[list[tuple[float, bytes]], bool]]:
        """Of each text its n best segmentations, and whether the best decodes to it. Arrow splits the texts and
        numbers their chunks, so that only a batch's distinct chunks are looked up."""
        out: list = [([(0.0, b"")], True)] * len(texts)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for mine in (full & ~odd, full & odd):
            if not mine.any():
                continue
            own = texts.filter(pa.array(mine))
            if odd[np.flatnonzero(mine)[0]]:
                split = pa.array([_CHUNK.findall(" " + t) for t in own.to_pylist()], pa.large_list(pa.large_string()))
            else:
                cut = pc.replace_substring(pc.replace_substring(own, "\n", "\0\n\0"), " ", "\0 ")
                split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(" ", cut.type), cut, pa.scalar("", cut.type)), "\0")
            ends = split.offsets.to_numpy() - split.offsets[0].as_py()
            for k, got in zip(np.flatnonzero(mine).tolist(), self._texts(split.flatten(), ends, n), strict=True):
                out[k] = got
        return out

    def _texts(self, chunks: pa.Array, ends: np.ndarray, n: int):
        """The results of texts given as chunks and where each text's end."""
        coded = chunks.dictionary_encode()
        names, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > CACHE_CHUNKS:
            self.known = dict(islice(self.known.items(), CACHE_CHUNKS // 2))  # those met first tend to be frequent
        if new := [c for c in names if c not in self.known]:
            self._learn(new)
        got = list(map(self.known.__getitem__, names))
        taken = pa.array([g[0] for g in got], pa.large_binary()).take(coded.indices)
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(taken) + 1)
        data, starts, sizes = memoryview(data), ends[:-1], np.diff(ends)
        total = np.add.reduceat(np.array([g[1] for g in got])[place], starts)
        good = np.logical_and.reduceat(np.array([g[3] for g in got])[place], starts)
        # Segmentations beside the best differ from it in the chunks with the n - 1 least losses only.
        loss, near, owner = np.array([g[2] for g in got])[place], [[] for _ in starts], np.repeat(np.arange(len(starts)), sizes)
        for _ in range(n - 1):
            least = np.minimum.reduceat(loss, starts)
            hit = np.flatnonzero((loss == least[owner]) & np.isfinite(loss))
            texts, first = np.unique(owner[hit], return_index=True)
            for t, k in zip(texts.tolist(), hit[first].tolist(), strict=True):
                near[t].append(k)
            loss[hit[first]] = math.inf
        for t, (a, b) in enumerate(zip(offsets[ends[:-1]].tolist(), offsets[ends[1:]].tolist(), strict=True)):
            score, ids = float(total[t]), bytes(data[a:b])
            options: list = [(0.0, ())]  # loss, what replaces which chunk
            for k in near[t]:
                own, same = self.chunk_n_best(names[place[k]], n), got[place[k]][0]  # of equal scores the best may come later here
                grown = [(so_far + own[0][0] - s, change if other == same else (*change, (k, other))) for so_far, change in options for s, other in own]
                options = heapq.nsmallest(n, grown, key=lambda x: x[0])
            found = []
            for lost, change in options:
                pieces, last = [], 0
                for k, other in sorted(change):
                    pieces += (ids[last : int(offsets[k]) - a], other)
                    last = int(offsets[k + 1]) - a
                found.append((score - lost, b"".join([*pieces, ids[last:]]) if change else ids))
            yield found, bool(good[t])

    def chunk_n_best(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        options = [(0.0, b"")]
        for p in self.parts(chunk):
            options = heapq.nsmallest(n, [(score + more, ids + other) for score, ids in options for more, other in self.alternatives(p, n)], key=lambda x: -x[0])
        return options

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation."""
        text = self._bytes(ids).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def zipf_lattice(model_path: str) -> Lattice:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    size = model.get_piece_size()
    byte_ids = [0] * 256
    ranked = []
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ranked.append((piece.replace(_SPACE, " "), i))
    norm = math.log(sum(1 / (r + 2) for r in range(len(ranked))))
    scored = [(p, i, -math.log(r + 2) - norm) for r, (p, i) in enumerate(ranked)]
    return Lattice(scored, byte_ids, -math.log(len(ranked) + 2) - norm - BYTE_PRICE)


@lru_cache(maxsize=2)
def lattice(model_path: str) -> Lattice:
    return zipf_lattice(model_path)


def encode_texts(docs: DataFrame, model_path: str, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_pieces, ids (uint32 little-endian) and score of the best segmentation, the
    ids, scores and id checksums of the N best, and whether the best decodes to the text."""
    ship(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("n_best_ids", pa.list_(pa.binary())), ("scores", pa.list_(pa.float64())), ("crc32s", pa.list_(pa.int64())), ("round_trip", pa.bool_())])

    slices = SLICE_ROWS, SLICE_BYTES

    def encode(batches):
        hold("pieces", lattice.cache_clear)
        model = lattice(model_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            for a, b in byte_slices(pc.binary_length(texts).to_numpy(), *slices):
                rows = []
                for i, (best, good) in zip(batch.column(0)[a:b].to_pylist(), model.encode_many(texts[a:b], n_best), strict=True):
                    score, ids = best[0]
                    sums = [zlib.crc32(x) for _, x in best]
                    rows.append((i, len(ids) // 4, ids, sums[0], score, [x for _, x in best], [s for s, _ in best], sums, good))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(lean(encode), "id long, n_pieces long, ids binary, ids_crc32 long, score double, n_best_ids array<binary>, scores array<double>, crc32s array<long>, round_trip boolean").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`encoded` with the text of its ids."""
    from pyspark.sql.pandas.functions import arrow_udf

    ship(encoded.sparkSession)

    @arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        model = lattice(model_path)
        return pa.array([None if x is None else model.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn(text_col, decoded(F.col(ids_col)))
