r"""Secret scanning with multipart credential linking, in DataFrame functions only.

Strong kinds are reported wherever they stand: `assign` (a named secret), `access` (an access identifier)
and `hex` (a long hexadecimal run). Weak kinds are reported only when complementary parts lie in the same
scope: `weak_id` (a named user or client, an e-mail address), `weak_secret` (a long mixed token) and `endpoint` (a URL
with a host, an IPv4 address). Scopes are the intervals that windows of 2 * REACH code points, REACH apart, cut out
of the stretches between blank lines; so parts of a stretch that are at most REACH apart share a scope. Parts are joined to
the scope intervals they start in - an interval join on bins of REACH code points -, and a scope reports
  * a weak identifier when a secret (assign, hex or weak_secret) is there,
  * a weak secret when an identifier (access or weak_id) is there,
  * an endpoint when both are there.
Scopes aggregate the roles they hold before any part meets them, so no pairs are made.

Spans are (start, end) in code points, end exclusive. One pass of a pattern marks its matches; the lengths of what lies
between the marks, summed in a window over a text's matches, give their places in time proportional to their number.

Defined results: a null text counts as empty; no match gives counts of 0 and an empty `spans`; rows equal in
id or text are reported each for itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, stored

#: Half of a scope's greatest length, in code points.
REACH = 1000
_NAMES = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter run of these letters holds no longer match
HEX = r"[0-9a-f]{32,}"
WEAK_ID = r"""(?i:access_?key_?id|client_?id|user_?name|account_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}|(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"""
WEAK_SECRET = r"[A-Za-z0-9+/]{24,}={0,2}"
ENDPOINT = r"(?i:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mongodb|redis|amqp)://[A-Za-z0-9._-]+(?::[0-9]+)?|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])(?::[0-9]+)?"
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
_BLANK_LINE = r"\n[\x20\t]*\n\s*"
_BREAK = len(KINDS)  # the rank of a blank line
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
_HIT = "array<struct<rank:int,gap:int,m:string>>"
_MARK, _OTHER = "\u0001", "\u0002"  # no pattern matches either


def _pieces(text: Column, may: Column, pattern: str) -> Column:
    """A text cut at its matches: what lies between them at even places, matches at odd ones. `may` is a cheap test
    that all texts with a match pass."""
    marked = F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}")
    return F.when(may, F.split(marked, _MARK, -1)).otherwise(F.expr("cast(array() as array<string>)"))


def _hits(pieces: str, rank: int) -> Column:
    """Of each match its rank, the code points between it and the one before, and its text."""
    matches, gaps = F.filter(pieces, lambda _, k: k % 2 == 1), F.filter(pieces, lambda _, k: k % 2 == 0)
    count = F.greatest(F.lit(0), F.expr(f"cast((size({pieces}) - 1) div 2 as int)"))
    return F.zip_with(F.slice(gaps, F.lit(1), count), matches, lambda gap, m: F.struct(F.lit(rank).alias("rank"), F.char_length(gap).alias("gap"), m.alias("m"))).cast(_HIT)


def _named(lower: Column) -> Column:
    return F.contains(lower, F.lit("password")) | F.contains(lower, F.lit("passwd")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("key"))


def _line(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _parts(scanned: DataFrame) -> DataFrame:
    """rid, rank, start, end of the matches that count; rank _BREAK: blank lines."""
    each = scanned.select("rid", F.posexplode("hits").alias("nth", "h")).select("rid", "nth", "h.*")
    size, m = F.char_length("m"), F.col("m")
    so_far = Window.partitionBy("rid", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)  # one text's matches of a kind
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(so_far).cast("int")).withColumn("start", F.col("end") - size)
    mixed = m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    counts = F.when(F.col("rank") == 0, F.char_length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= 8).when(F.col("rank") == KINDS.index("weak_secret"), mixed).otherwise(True)
    return placed.filter(counts).select("rid", "rank", "start", "end")


def _scopes(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """rid, lo, hi, k: the scope intervals of texts (rid, size)."""
    begins = texts.select("rid", "size", F.lit(0).alias("begin"), F.lit(0).alias("before")).unionByName(
        parts.filter(F.col("rank") == _BREAK).join(texts, "rid").select("rid", "size", F.col("end").alias("begin"), F.col("start").alias("before"))
    )
    following = Window.partitionBy("rid").orderBy("begin", "before")  # one text's blank lines
    stretches = begins.withColumn("stop", F.coalesce(F.lead("before").over(following), F.col("size"))).filter("begin < stop")
    windows = F.sequence(F.greatest(F.lit(0), F.expr(f"cast(begin div {REACH} as int) - 1")), F.expr(f"cast((stop - 1) div {REACH} as int)"))
    cut = stretches.select("rid", "begin", "stop", F.explode(windows).alias("k"))
    lo, hi = F.greatest(F.col("begin"), F.col("k") * REACH), F.least(F.col("stop"), (F.col("k") + 2) * REACH)
    return cut.select("rid", "k", lo.alias("lo"), hi.alias("hi")).filter("lo < hi")


def _linked(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """rid, rank, start, end of the weak parts that are to be reported."""
    binned = _scopes(parts, texts).withColumn("bin", F.explode(F.array("k", F.col("k") + 1)))
    points = parts.filter(F.col("rank") < _BREAK).withColumn("bin", F.expr(f"cast(start div {REACH} as int)"))
    met = points.join(binned, ["rid", "bin"]).filter("start >= lo and start < hi")
    kind = F.col("rank")
    weak_id, weak_secret, endpoint = (kind == KINDS.index(k) for k in ("weak_id", "weak_secret", "endpoint"))
    is_id, is_secret = (kind == KINDS.index("access")) | weak_id, (kind == KINDS.index("assign")) | (kind == KINDS.index("hex")) | weak_secret
    roles = met.groupBy("rid", "lo", "k").agg(F.max(is_id).alias("has_id"), F.max(is_secret).alias("has_secret"))
    due = (weak_id & F.col("has_secret")) | (weak_secret & F.col("has_id")) | (endpoint & F.col("has_id") & F.col("has_secret"))
    return met.join(roles, ["rid", "lo", "k"]).filter(due).select("rid", "rank", "start", "end").distinct()


def _spans(rows: DataFrame, name: str) -> DataFrame:
    """rid and its spans in order."""
    kinds = F.array(*map(F.lit, KINDS))
    span = F.struct("start", "rank", "end", F.element_at(kinds, F.col("rank") + 1).alias("kind"))
    return rows.groupBy("rid").agg(F.array_sort(F.collect_list(span)).cast(_SPAN).alias(name))  # one text's spans


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, `base` and `linked` (arrays of spans, each sorted by start and kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t, lower = F.col("text"), F.lower(F.col("text"))
    text = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    seen = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), text.alias("text"))
    # Each pattern runs once: its pieces are a column of their own, which the planner does not copy into the next step.
    cut = seen.select(
        "id",
        "rid",
        "text",
        _pieces(t, _named(lower), ASSIGN).alias("p0"),
        _pieces(t, F.contains(t, F.lit("AKIA")), ACCESS).alias("p1"),
        _pieces(t, t.rlike(r"[0-9a-f]{32}"), HEX).alias("p2"),
        _pieces(t, F.contains(t, F.lit("@")) | lower.rlike("(?:_?id|user_?name|login)[\"']?\x20*[:=]"), WEAK_ID).alias("p3"),
        _pieces(t, t.rlike("[A-Za-z0-9+/]{24}"), WEAK_SECRET).alias("p4"),
        _pieces(t, F.contains(t, F.lit("://")) | t.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]"), ENDPOINT).alias("p5"),
    )
    parted = cut.select("id", "rid", "text", F.concat(*[_hits(f"p{k}", k) for k in range(3)]).alias("strong"), F.concat(*[_hits(f"p{k}", k) for k in range(3, 6)]).alias("weak"))
    parted = parted.withColumn("blank", _pieces(t, (F.size("weak") > 0) & F.contains(t, F.lit("\n")), _BLANK_LINE))
    # Weak parts and blank lines matter only beside other parts.
    several = F.size("weak") + F.size("strong") > 1
    hits = F.when((F.size("weak") > 0) & several, F.concat("strong", "weak", _hits("blank", _BREAK))).otherwise(F.col("strong"))
    scanned = stored(parted.select("id", "rid", F.char_length("text").alias("size"), hits.alias("hits"), ((F.size("weak") > 0) & several).alias("maybe")), "secrets")
    parts = stored(_parts(scanned.filter(F.size("hits") > 0)), "parts")
    texts = scanned.filter("maybe").select("rid", "size")
    linked = stored(_linked(parts.join(texts.select("rid"), "rid", "left_semi"), texts), "linked")
    nothing = F.expr(f"cast(array() as {_SPAN})")
    plain = scanned.filter(F.size("hits") == 0).select("id", nothing.alias("base"), nothing.alias("linked"))
    own = scanned.filter(F.size("hits") > 0).select("id", "rid").join(_spans(parts.filter("rank < 3"), "base"), "rid", "left").join(_spans(linked, "linked"), "rid", "left")
    return plain.unionByName(own.select("id", F.coalesce("base", nothing).alias("base"), F.coalesce("linked", nothing).alias("linked"))).withColumnRenamed("id", id_col)


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: counts of the strong kinds, digest of their spans, and all spans as one string."""
    found = settled(docs.sparkSession, "secrets", lambda: scan_secrets(docs, id_col, text_col))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(F.encode(_line(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _line(F.array_sort(F.concat("base", "linked"))).alias("spans"))
