"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text that resembles good text compresses better with the good dictionary. Its score comes from the
difference of its two compressed sizes over its own size, summed over pieces of the whole text so that a
long text does not become its own dictionary, and calibrated by a logistic curve. Bytes are evidence: the
curve moves a text of n bytes by n / (n + EVIDENCE) of the way from the labels' prior.

Training takes a bounded sample of labelled rows (`TRAIN_ROWS` a label, texts of up to `TRAIN_CHARS`
characters): of each label most rows make the dictionaries, the rest, one at least, the curve. Nothing else is bounded: every row is
scored over its whole text.

Defined results: null and empty texts get the labels' prior; a document whose labels
contradict one another, or are null, is not learned from; without labelled rows of both kinds, every score is
0.5 and `keep_quality` keeps all; rows equal in id are scored each for itself; other columns are ignored by `score_quality` and kept by
`keep_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hold, release, ship

#: Bounds of the training sample, the dictionaries' size, and the pieces that texts are compressed in.
TRAIN_ROWS, TRAIN_CHARS, DICT_BYTES, PIECE, LEVEL = 2500, 20_000, 1 << 20, 2048, 12
EVIDENCE, THRESHOLD = 300, 0.7


class Model:
    """Dictionaries and the curve 1 / (1 + exp(-(prior + weight * (slope * difference + shift))))."""

    def __init__(self, texts: list[str], labels: list[int], prior: float):
        self.good = self.bad = b""
        self.slope = self.shift = self.prior = 0.0
        self._compressors = None
        if not (any(labels) and not all(labels)):
            return
        own = {q: [t for t, y in zip(texts, labels, strict=True) if y == q] for q in (1, 0)}
        curve = {q: ts[3::4] or ts[-1:] for q, ts in own.items()}
        rest = {q: [t for k, t in enumerate(ts) if k % 4 != 3][: len(ts) - 1 or 1] for q, ts in own.items()}  # a lone row serves both
        self.good, self.bad = (self._dictionary([t.encode("utf-8", "replace") for t in rest[q]]) for q in (1, 0))
        rows = [(t, q) for q, ts in curve.items() for t in ts]
        x, weight = np.array([self.difference(t) for t, _ in rows]).T
        self.slope, self.shift = self._fit(x, weight, np.array([v for _, v in rows], float))
        self.prior = float(np.log(prior / (1 - prior)))

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def rest(self) -> None:
        """Drop what can be made again."""
        self._compressors = None

    def difference(self, text: str) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one) / size of the text, over 0 for good text;
        and the weight of that evidence."""
        data = text.encode("utf-8", "replace")
        if not data:
            return 0.0, 0.0
        if self._compressors is None:
            made = [zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT) for d in (self.good, self.bad)]
            for d in made:
                d.precompute_compress(level=LEVEL)
            self._compressors = [zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False) for d in made]
        a, b = self._compressors
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        return (sum(len(b.compress(p)) for p in pieces) - sum(len(a.compress(p)) for p in pieces)) / len(data), len(data) / (len(data) + EVIDENCE)

    @staticmethod
    def _dictionary(samples: list[bytes]) -> bytes:
        """Raw content: pieces of the samples in turn, so that no long text crowds out others."""
        out, total, depth = [], 0, 0
        while total < DICT_BYTES:
            layer = [s[depth : depth + 512] for s in samples if len(s) > depth]
            if not layer:
                break
            for piece in layer:
                if total < DICT_BYTES:
                    out.append(piece)
                    total += len(piece)
            depth += 512
        return b"".join(out)[:DICT_BYTES] or b"\n" * 8

    @staticmethod
    def _fit(x: np.ndarray, weight: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
        """Newton steps of a lightly penalised logistic regression; the offset is the sample's own prior."""
        scale, offset = float((x * weight).std()) or 1.0, np.log(y.mean() / (1 - y.mean()))
        design, w = np.stack([x * weight / scale, weight], 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w + offset, -30, 30)))
            hess = design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2) * ridge * len(y)
            step = np.linalg.solve(hess, design.T @ (p - y) + ridge * len(y) * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        return float(w[0] / scale), float(w[1])

    def score(self, text: str) -> float:
        if not self.good:
            return 0.5
        x, weight = self.difference(text)
        return float(1 / (1 + np.exp(-np.clip(self.prior + weight * (self.slope * x + self.shift), -30, 30))))


def held_out(c: Column) -> Column:
    return F.pmod(F.crc32(F.encode(c.cast("string"), "UTF-8")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled rows that are not held out: the first TRAIN_ROWS of each label in hash order."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    single = usable.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).filter("q = q2 and q in (0, 1)")
    counts = {r["q"]: r["n"] for r in single.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return Model([], [], 0.5)
    picked = [r for q in (0, 1) for r in single.filter(F.col("q") == q).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).collect()]
    wanted = docs.sparkSession.createDataFrame([(r["id"], r["q"]) for r in picked], "id long, q int")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter((F.col("text") != "") & (F.char_length("text") <= TRAIN_CHARS))
    rows = text.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("q").alias("q")).orderBy(F.xxhash64("id"), "id").limit(2 * TRAIN_ROWS).collect()
    return Model([r["text"] for r in rows], [r["q"] for r in rows], counts[1] / (counts[0] + counts[1]))


def _scored(docs: DataFrame, model: Model, text_col: str, score: str) -> DataFrame:
    """All columns of `docs` and the score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES at most
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hold("quality", lambda: None)
        model = shared.value
        for texts in batches:
            yield pa.array([model.score(t.as_py() or "") for t in texts], pa.float64())
        model.rest()
        release()

    return docs.withColumn(score, scored(F.col(text_col)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col)
    scored = _scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, "text", "score")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier accepts; all of them if the labels give no classifier."""
    (score,) = fresh(docs, "score")
    model = train(docs, labels, id_col, text_col)
    if not model.good:
        return docs
    return _scored(docs, model, text_col, score).filter(F.col(score) >= threshold).select(*docs.columns)
