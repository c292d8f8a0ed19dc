"""Exact deduplication by two Bloom passes, in DataFrame functions only.

Pass 1 counts rows per slot of a one-hash filter and keeps, as bitmaps, the slots hit more than once.
Pass 2 does the same with an independent hash over the rows that hit pass 1. A row that misses either
filter is the only one of its text and passes straight through; only the rest (repeated texts and a few
false positives) shuffle, by digest, to be grouped exactly.

Defined results: a null text counts as empty; empty texts are equal to one another; a null id loses to any
other; of rows equal in text and id one stays; an empty table gives an empty result; other columns of the
input, whatever their names, are carried (`drop_exact_duplicates`) or ignored (`mark_exact_duplicates`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, attach_groups, fresh, stored

#: Bits of a pass's filter at most: 32 MB of bitmaps to broadcast. With more rows than it can tell apart
#: more rows shuffle; the result stays the same.
MAX_FILTER_BITS = 1 << 28
_BUCKET_BITS = 32_768  # of one value of bitmap_construct_agg


def text_digest(c: Column) -> Column:
    """Lower-case hex SHA-256 of the text's UTF-8 bytes after lower-casing A-Z; null counts as empty."""
    return F.sha2(F.encode(ascii_lower(c), "UTF-8"), 256)


def filter_bits(rows: int, most: int = MAX_FILTER_BITS) -> int:
    bits = _BUCKET_BITS
    while bits < 8 * rows and bits < most:
        bits *= 2
    return bits


def _slot(digest: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(bits))


def slot_bitmaps(rows: DataFrame, key: str, seed: int, bits: int) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the slots that any row hits."""
    return _bitmaps(rows.select(_slot(F.col(key), seed, bits).alias("slot")).distinct())


def _bitmaps(slots: DataFrame) -> DataFrame:
    return slots.groupBy((F.col("slot") / _BUCKET_BITS).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % _BUCKET_BITS).alias("bitmap"))


def _repeated_slots(hashes: DataFrame, digest: str, seed: int, bits: int) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the slots that more than one row hits; at most bits / 8 bytes in all."""
    slot = _slot(F.col(digest), seed, bits)
    twice = hashes.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _bitmaps(twice)


def _hits(rows: DataFrame, bitmaps: DataFrame, digest: str, seed: int, bits: int) -> tuple[DataFrame, str]:
    """`rows` with a boolean column, and its name: the row's slot has its bit set in `bitmaps`."""
    slot, bucket, bitmap, hit = fresh(rows, "slot", "bucket", "bitmap", "hit")
    at = F.col(slot) % _BUCKET_BITS
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.try_element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1)
    filt = bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
    out = rows.withColumn(slot, _slot(F.col(digest), seed, bits)).withColumn(bucket, (F.col(slot) / _BUCKET_BITS).cast("long"))
    out = out.join(F.broadcast(filt), bucket, "left")
    return out.withColumn(hit, F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop(slot, bucket, bitmap), hit


class RepeatFilter:
    """The two filters over the digests of all rows; `split` tells passing rows from candidates."""

    def __init__(self, hashes: DataFrame, digest: str, rows: int, most_bits: int = MAX_FILTER_BITS):
        self.bits = filter_bits(rows, most_bits)
        self.first = stored(_repeated_slots(hashes, digest, 1, self.bits), "bloom1")
        seen, hit = _hits(hashes, self.first, digest, 1, self.bits)
        self.second = stored(_repeated_slots(seen.filter(hit), digest, 2, self.bits), "bloom2")

    def split(self, rows: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
        """(rows that no other row equals, candidates); no row shuffles."""
        one, hit1 = _hits(rows, self.first, digest, 1, self.bits)
        two, hit2 = _hits(one, self.second, digest, 2, self.bits)
        both = F.col(hit1) & F.col(hit2)
        return two.filter(~both).drop(hit1, hit2), two.filter(both).drop(hit1, hit2)


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per row of `docs`: its id, keep_id, group_size, kept, text_sha256."""
    hashes = stored(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("rid")), "digests")
    rows = hashes.count()
    unique, candidates = RepeatFilter(hashes, "text_sha256", rows, most_bits).split(hashes, "text_sha256")
    groups = candidates.groupBy("text_sha256").agg(F.max(F.struct("id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.select("text_sha256", "group_size", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid")), "groups")
    grouped = attach_groups(candidates, groups, "text_sha256", "group_size", rows)
    alone = unique.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    several = grouped.select("id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")
    return alone.unionByName(several).withColumnRenamed("id", id_col)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """`docs` with one row of each text, that with the largest id; all its columns."""
    (digest, size, keep) = fresh(docs, "digest", "group_size", "keep_id")
    hashes = stored(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    rows = hashes.count()
    repeats = RepeatFilter(hashes, "digest", rows, most_bits)
    unique, candidates = repeats.split(docs.withColumn(digest, text_digest(F.col(text_col))), digest)
    _, narrow = repeats.split(hashes, "digest")
    groups = stored(narrow.groupBy(F.col("digest").alias(digest)).agg(F.max("id").alias(keep), F.count(F.lit(1)).alias(size)), "groups")
    best = attach_groups(candidates, groups, digest, size, rows).filter(F.col(id_col).eqNullSafe(F.col(keep)))
    return unique.select(*docs.columns).unionByName(best.dropDuplicates([digest]).select(*docs.columns))
