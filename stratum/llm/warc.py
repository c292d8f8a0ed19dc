"""WARC archives: a deduplicating writer and a salvage reader.

Writer. A record is a gzip member of its own. Of records with equal payloads of REVISIT_BYTES or more, that with
the smallest id is the response and the others are revisits that refer to it. Rows whose payload no other row
has pass a Bloom filter and are written where they were read; only the others shuffle.

Reader. Records are checked as they are read: the gzip member's own checksum, the version line, the lengths and
the block and payload digests. When a check fails the reader searches for the next offset at which a whole
record is valid - a member or a version line, whichever comes first -, reports the bytes between as a gap with the
reason, and goes on. Records of every type are read; the payload of one that is neither response nor revisit is its
whole block. A member may hold several records, and is inflated in memory; one whose checksum fails is a gap. Files are mapped, not loaded, where executors share the
folder; elsewhere Spark hands over each file's bytes.

Defined results: a null payload counts as empty, a null URL is written as urn:none, a null id has no id field and
loses to any other; rows equal in id and payload are one response and revisits; an empty table gives no files and
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import warnings
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, lean, local_path, scratch_path, ship, stored
from .exact_dedup import RepeatFilter
from .files import attempt_name, exists, read_file, write_file

#: Bytes of a file at which the writer starts another; payloads below REVISIT_BYTES are always responses.
FILE_BYTES, REVISIT_BYTES, DATE = 16 << 20, 100, "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_STEP, _GZIP = 1 << 16, b"\x1f\x8b\x08"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None, revisit: bool, size: int | None = None) -> bytes:
    """An uncompressed record. A revisit needs only the payload's `size`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if payload is not None else size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~-._") if url else "urn:none"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
        *([("X-Page-Id", str(page_id))] if page_id is not None else []),
        *([("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to))] if revisit else []),
        *([("X-Refers-To-Page-Id", str(refers_to))] if revisit and refers_to is not None else []),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


class Damaged(ValueError):
    """What failed."""


def _fields(data, at: int) -> tuple[dict[str, str], int]:
    """The header lines at `at`, however many and long, and the offset after the empty line that ends them."""
    out = {}
    while (end := data.find(b"\r\n", at)) != at:
        if end < 0:
            raise Damaged("header without an end")
        name, colon, value = bytes(data[at:end]).partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        at = end + 2
    return out, at + 2


def parse_record(data, at: int = 0) -> tuple[dict, int]:
    """The record at `at` of a buffer, checked, and the offset after it."""
    if not _VERSION.match(bytes(data[at : at + 10])):
        raise Damaged("no version line")
    fields, start = _fields(data, at + 10)
    if not (length := fields.get("content-length", "")).isdigit():
        raise Damaged("no content length")
    stop = start + int(length)
    if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
        raise Damaged("record end is not where the content length says")
    block = bytes(data[start:stop])
    if (want := fields.get("warc-block-digest", "")).startswith("sha256:") and want[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest differs")
    kind = fields.get("warc-type", "")
    record = {"type": kind, "uri": fields.get("warc-target-uri"), "fields": fields, "payload": block, "payload_bytes": len(block), "payload_digest": None}
    if kind not in ("response", "revisit"):
        record["payload_digest"] = hashlib.sha256(block).hexdigest()
    else:
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
        told = fields.get("warc-payload-digest", "")
        told = told[7:] if told.startswith("sha256:") else None
        record["payload"] = payload
        if kind == "response":
            record |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
            if told and told != record["payload_digest"]:
                raise Damaged("payload digest differs")
        else:
            record |= {"payload_bytes": int(declared[1]) if declared else None, "payload_digest": told}
    return record, stop + 4


def _member(data, at: int) -> tuple[bytes, int]:
    """The member at `at`, inflated, and the offset after it."""
    inflate, parts, here = zlib.decompressobj(31), [], at
    while not inflate.eof:
        chunk = bytes(data[here : here + _STEP])
        if not chunk:
            raise Damaged("member cut short")
        try:
            parts.append(inflate.decompress(chunk))
        except zlib.error as e:
            raise Damaged(f"member: {e}") from None
        here += len(chunk)
    return b"".join(parts), here - len(inflate.unused_data)


def _try(data, at: int, packed: bool) -> tuple[list[tuple], int]:
    """(kind, record or reason) of the record or of what the member at `at` holds, and the offset after it."""
    if not packed or data[at : at + 3] != _GZIP:
        record, after = parse_record(data, at)
        return [("record", record)], after
    whole, after = _member(data, at)
    inner = list(salvage(whole, (b"WARC/1.",)))
    if all(kind == "gap" for kind, *_ in inner):
        raise Damaged(inner[0][3] if inner else "empty member")
    return [(kind, what) for kind, _, _, what in inner], after


def salvage(data, seek_marks=(_GZIP, b"WARC/1.")):
    """Of a file's buffer: ("record", start, end, record) and ("gap", start, end, reason), covering all bytes. All
    that a member holds has the member's start and end."""
    at, size = 0, len(data)
    marks = dict.fromkeys(seek_marks, -1)  # where each is next, as far as searched

    def valid_from(seek):
        """(offset, records, offset after them) of the first valid ones at `seek` or later."""
        while seek < size:
            for m, place in marks.items():
                if place < seek:
                    marks[m] = found if (found := data.find(m, seek)) >= 0 else size
            if (seek := min(marks.values())) < size:
                try:
                    return seek, *_try(data, seek, _GZIP in marks)
                except Damaged:
                    seek += 1
        return None

    while at < size:
        try:
            held, after = _try(data, at, _GZIP in marks)
        except Damaged as e:
            found = valid_from(at + 1)
            yield "gap", at, found[0] if found else size, str(e)
            if not found:
                return
            at, held, after = found
        for kind, what in held:
            yield kind, at, after, what
        at = after


READ = "file string, start long, end long, gap string, page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records and gaps of the files (path[, content][, records]); a gap has a reason in `gap` and no record. A file
    that gives other than `records` records fails the query."""
    ship(files.sparkSession)
    has_content, has_records, schema = "content" in files.columns, "records" in files.columns, READ + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])

    def rows_of(path, data):
        number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
        for kind, start, end, what in salvage(data):
            if kind == "gap":
                yield (path, start, end, what, *[None] * (len(names) - 4))
            else:
                f = what["fields"]
                row = (path, start, end, None, number(f.get("x-page-id")), what["uri"], what["type"], number(f.get("x-refers-to-page-id")), what["payload_bytes"], what["payload_digest"])
                yield (*row, what["payload"]) if with_payload else row

    def read(batches):
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                held, size, count = [], 0, 0
                if has_content:
                    source = batch.column("content")[k].as_py()
                else:
                    source = read_file(path)
                for row in rows_of(path, source):
                    held.append(row)
                    count += row[3] is None
                    size += 200 + (len(row[-1] or b"") if with_payload else 0)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                if has_records and count != (want := batch.column("records")[k].as_py()):
                    raise ValueError(f"{path}: {count} records read, {want} written")

    return files.mapInArrow(lean(read), schema)


def read_folder(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps of all files of a folder."""
    files = spark.read.format("binaryFile").load(folder)
    return read_archives(files.select("path") if local_path(folder) else files.select("path", "content"), with_payload)


def _tied(large: DataFrame, groups: DataFrame, tied: DataFrame, total: int) -> DataFrame:
    """Rows whose id is the first of their payload, where several rows are: one response with the payload, which is
    combined before it shuffles, and the others as revisits, which are counted and need no payload."""
    met = attach_groups(large.join(tied, "digest", "left_semi"), groups, "digest", "members", total).filter(F.col("id").eqNullSafe(F.col("first.id")))
    url = F.struct(F.col("url").isNull().alias("none"), "url")
    one = met.groupBy("digest", "id").agg(F.min(url).alias("u"), F.first("payload").alias("payload"), F.first("size").alias("size"))
    responses = one.select("id", F.col("u.url").alias("url"), "payload", "size", "digest", F.col("id").alias("refers_to"), F.lit(False).alias("revisit"))
    counted = stored(met.groupBy("digest", "id", "url", "size", F.spark_partition_id().alias("place")).agg(F.count(F.lit(1)).alias("n")), "tied")
    least = counted.groupBy("digest").agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url", "place")).alias("least"), F.count(F.lit(1)).alias("members"))
    own = F.struct(F.col("url").isNull().alias("none"), "url", "place").eqNullSafe(F.col("least"))
    again = attach_groups(counted, least, "digest", "members", total).withColumn("n", F.col("n") - own.cast("int")).filter("n > 0")
    again = again.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
    revisits = again.select("id", "url", F.lit(None).cast("binary").alias("payload"), "size", "digest", F.col("id").alias("refers_to"), F.lit(True).alias("revisit"))
    return responses.unionByName(revisits)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write a record per row of `pages`; returns the stored manifest (file, records)."""
    spark = pages.sparkSession
    ship(spark)
    html = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    narrow = stored(rows.filter(F.octet_length("payload") >= REVISIT_BYTES).select("id", "digest"), "digests")
    total = narrow.count()
    repeats = RepeatFilter(narrow, "digest", total)
    unique, several = repeats.split(rows, "digest")
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    groups = repeats.split(narrow, "digest")[1].groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members"))
    groups = stored(groups, "groups")
    base = ["id", "url", "payload", "size", "digest"]
    large = several.filter(F.col("size") >= REVISIT_BYTES)
    plain = unique.unionByName(several.filter(F.col("size") < REVISIT_BYTES)).select(*base, F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    is_first = F.col("id").eqNullSafe(F.col("first.id"))
    tied = stored(repeats.split(narrow, "digest")[1].groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest").distinct(), "ties")
    marked = attach_groups(large, groups, "digest", "members", total).select(*base, F.col("first.id").alias("refers_to"), is_first.alias("is_first"))
    rest = marked.filter("not is_first").unionByName(marked.filter("is_first").join(tied, "digest", "left_anti"))
    rest = rest.withColumn("payload", F.when(F.col("is_first"), F.col("payload"))).withColumn("revisit", ~F.col("is_first")).drop("is_first")
    every = plain.unionByName(rest).unionByName(_tied(large, groups, tied, total))

    def write(batches):
        place, nth, held, size, count, out = TaskContext.get().partitionId(), 0, [], 0, 0, []

        def flush():
            name = attempt_name(place, nth, "warc.gz")
            write_file(folder, name, held)
            out.append((name, count))

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                made = member(make_record(*(x.as_py() for x in row)))
                held.append(made)
                size, count = size + len(made), count + 1
                if size >= FILE_BYTES:
                    flush()
                    nth, held, size, count = nth + 1, [], 0, 0
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"file": pa.array([n for n, _ in out], pa.string()), "records": pa.array([c for _, c in out], pa.int64())})

    return stored(every.select("id", "url", "payload", "digest", "refers_to", "revisit", "size").mapInArrow(lean(write), "file string, records long"), "manifest")


def quarantined(read: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(records, gaps, where they are): what `read_archives` gave, in one pass written apart under `path`, by default in
    the shared folder. The gaps - file, start, end, reason - are the log of what could not be read."""
    spark = read.sparkSession
    place = path or scratch_path(spark, "records")
    read.withColumn("quarantine", F.col("gap").isNotNull()).write.partitionBy("quarantine").parquet(place)
    every = spark.read.schema(read.withColumn("quarantine", F.lit(True)).schema).parquet(place)
    records = every.filter(~F.col("quarantine")).drop("quarantine", "gap")
    return records, every.filter("quarantine").select("file", "start", "end", "gap"), place


def _present(files: DataFrame) -> DataFrame:
    """The files (path, ...) that are there."""

    def look(batches):
        for batch in batches:
            yield batch.filter(pa.array([exists(p) for p in batch.column(0).to_pylist()], pa.bool_()))

    return files.mapInArrow(lean(look), files.schema)


def archive_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write the archives into the shared folder and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Fails if the records read differ in number from those written."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_archives(pages, folder, id_col, url_col, text_col)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    named = manifest.select(F.concat(F.lit(f"{folder}/"), "file").alias("path"), "records")
    if (there := _present(named).count()) != (want := manifest.count()):
        raise ValueError(f"{there} archives found, {want} written")
    files = named.select("path").repartition(max(1, min(want, 10_000)), "path")
    records, gaps, place = quarantined(read_archives(files), f"{folder}-records")
    if n := gaps.count():
        warnings.warn(f"{n} byte gaps in fresh archives, logged in {place}", stacklevel=2)
    counts = records.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("read"))
    wrong = named.join(counts, "path", "left").filter(F.coalesce("read", F.lit(0)) != F.col("records")).first()
    if wrong:
        raise ValueError(f"{wrong['path']}: {wrong['read'] or 0} records read, {wrong['records']} written; gaps are logged in {place}")
    return records.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
