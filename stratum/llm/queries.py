"""Queries of this subpackage, each over its whole table, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import find_contamination
from .exact_dedup import mark_exact_duplicates
from .lm_score import score_texts
from .near_dedup import near_duplicates
from .pieces import encode_texts
from .quality import score_quality
from .secrets import secret_digests
from .sharding import assign_shards
from .token_output import token_digests
from .warc import archive_digests


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_duplicates(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(table(spark, sf_dir, "pages"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = assign_shards(table(spark, sf_dir, "documents"), 16)
    return marks.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def base_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_lm_score that SQL can state."""
    return op6_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_secret_scan that SQL can state."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10_quality SQL can state: which rows are held out, and that a prediction follows from its score."""
    scored = op10_quality(spark, sf_dir)
    return scored.select("doc_id", "held_out", F.col("score").between(0, 1).alias("in_range"), (F.col("predicted") == (F.col("score") >= 0.7).cast("int")).alias("consistent"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_sentencepiece, op3_token_output, op4_near_dedup, op5_warc, op6_lm_score, op7_secret_scan, op8_decontamination, op9_sharding, op10_quality, base_lm_score, base_secret_scan, base_quality)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# The table of CRC-32 from its rule, and the checksum of a list of bytes written as pairs of hex digits.
_CRC_TABLE = """crc_table as (select list(v order by b) as t from (select b, list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(b)))"""


def _crc(text: str) -> str:
    pairs = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {pairs}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _matches(kind: str, rank: int, pattern: str, keep: str) -> str:
    """doc_id, kind, rank, lo, hi of a pattern's matches: the texts between marks, with the lengths before them."""
    cut = f"select doc_id, unnest(string_split(regexp_replace(x, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1))) as m, generate_subscripts(string_split(regexp_replace(x, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)), 1) as k from docs"
    return f"select doc_id, '{kind}' as kind, {rank} as rank, hi - length(m) as lo, hi, m from (select *, sum(length(m)) over (partition by doc_id order by k) as hi from ({cut})) where k % 2 = 0 and {keep}"


_ASSIGN_SQL = """((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLES = {
    "op1_exact_dedup": f"""
        with t as (select doc_id, {_LOWERED} as x from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(x) as text_sha256
        from t window w as (partition by x)""",
    "op5_warc": """
        with t as (select page_id, coalesce(html, '') as h from pages),
             u as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest, min(page_id) over (partition by h) as first_id from t),
             v as (select *, payload_bytes >= 100 and page_id > first_id as again from u)
        select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first_id end as refers_to
        from v""",
    "op4_near_dedup": f"""
        with recursive t as (select doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') as w from documents),
             g as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s from t),
             n as (select doc_id, len(s) as n from g), s as (select doc_id, unnest(s) as x from g),
             p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
             e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
             l as (select a, b from e union select b, a from e),
             r as (select doc_id as d, doc_id as o from n union select r.d, l.b from r join l on l.a = r.o)
        select n.doc_id, n.n as n_shingles, min(r.o) as component_id, n.doc_id = min(r.o) as kept from n join r on r.d = n.doc_id group by 1, 2""",
    "op9_sharding": f"""
        with {_CRC_TABLE},
             d as (select doc_id, strlen(coalesce(text, '')) + 1 as size, {_crc("coalesce(text, '')")} as text_crc32 from documents, crc_table),
             o as (select *, sum(size) over w - size as begin, sum(size) over () as total from d window w as (order by doc_id, size, text_crc32 rows unbounded preceding)),
             p as (select *, least(15, ((2 * begin + size) * 16) // (2 * total)) as shard from o)
        select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, cast(shard as int) as shard, row_number() over (partition by shard order by doc_id, size, text_crc32) - 1 as slot, cast(null as int) as grown_shard from p""",
    "base_lm_score": f"""
        with {_CRC_TABLE},
             d as (select doc_id, {_crc("doc_id::varchar")} % 7 = 2 as held_out, list_append(regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+'), chr(10)) as w from documents, crc_table),
             t as (select doc_id, held_out, unnest(w) as x from d),
             c as (select x, count(*) as c from t where not held_out group by 1),
             a as (select cast(sum(c) as bigint) as n, count(*) as v from c)
        select doc_id, held_out, count(*) as n_tokens, count(c.c) as n_known, any_value(a.n) as train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (a.n + a.v + 1))), 4) as base_score
        from t left join c using (x), a group by 1, 2""",
    "base_secret_scan": f"""
        with docs as (select doc_id, coalesce(text, '') as x from documents),
             m as ({_matches("assign", 0, _ASSIGN_SQL, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 8")} union all {_matches("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16")} union all {_matches("hex", 2, "[0-9a-f]+", "length(m) >= 32")})
        select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
               sha256(coalesce(string_agg(kind || ':' || cast(lo as bigint) || ':' || cast(hi as bigint), ',' order by lo, rank), '')) as base_sha256
        from docs left join m using (doc_id) group by 1""",
    "base_quality": f"""with {_CRC_TABLE} select doc_id, {_crc("doc_id::varchar")} % 4 = 2 as held_out, true as in_range, true as consistent from documents, crc_table""",
}
