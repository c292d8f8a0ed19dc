"""MinHash near-deduplication by an inverted join over signature coordinates, confirmed on full shingle sets.

1. Each text becomes a set of word shingles, a digest of the set and a signature of COORDINATES minima. Texts
   with one digest form a class with one representative; only representatives go on.
2. Every representative is posted under each (coordinate, value). Two sets of the least similarity agree in
   at least MATCHES coordinates but for a chance of about 1e-8, so a representative with fewer shared values
   is skipped, and of the others only the rarest (shared - MATCHES + 1) postings are merged: a pair that
   agrees often enough meets in one of them (prefix filter; long lists are what it skips).
3. Short lists give pairs. Long lists, where pairs would grow with the square, give families (lists that
   share a member): each member is compared with the family's pivot; those linked to it are joined and need no
   comparison with one another. In rounds, the others meet a block of their kind and some joined members, which act as
   further pivots, and join through them; a round's work is in proportion to the family. What no round joins can only
   link to a joined member x when d(pivot, x) >= d(pivot, y) - (1 - similarity), by the triangle inequality of the
   Jaccard distance. Such members meet in blocks of bounded size that keep only signatures' matches above the
   threshold, compare full sets, and give the links that join something new within the block.
4. Links make components; a component's id is its smallest document id.

Defined results: null, empty and wordless texts have an empty set and link with nothing; a text of fewer words
than a shingle has its whole sequence as its one shingle; a null id is larger than any other; of rows equal in
id, one stays; an empty table gives an empty result; other columns are ignored by `near_duplicates` and kept by
`drop_near_duplicates`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, byte_slices, fresh, heavy_limit, hold, lean, settled, ship, stored, union_all
from .components import connected_components
from .exact_dedup import _hits, filter_bits, slot_bitmaps
from .shingles import Signer, digest, shingle_sets

#: Coordinates of a signature, and those that a pair must share at a similarity of 0.85 or more
#: (chance of fewer: 1.2e-9); at 0.8, `matches_for` gives its own figure.
COORDINATES, MISS = 32, 2e-8
#: Members of a list that is merged pair by pair; members of a block.
SHORT, BLOCK = 32, 256
#: Rounds of further pivots in families of which more than CROWD members are linked to none yet, and the pivots of a
#: block in a round. They change what is compared, never the links' components.
ROUNDS, CROWD, PIVOTS = 8, 1024, 64
#: Texts that are shingled together: rows and bytes at most.
SLICE_ROWS, SLICE_BYTES = 2_000, 2 << 20


def matches_for(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest match count that a pair of this similarity falls short of with a chance of at most `miss`."""
    from math import comb

    p, total = percent / 100, 0.0
    for k in range(coordinates + 1):
        total += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if total > miss:
            return max(1, k)
    return coordinates


def _signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """rid, id, k1, k2 (a key of the row's id and text), n, digest, sig; a row per row of `docs`."""
    ship(docs.sparkSession)
    schema = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    slices = SLICE_ROWS, SLICE_BYTES

    def sign(batches):
        hold("shingles", lambda: None)
        signer = Signer(COORDINATES)
        for batch in batches:
            for a, sets in _sliced(batch.column(4), size, slices):
                head = [c[a : a + len(sets)] for c in batch.columns[:4]]
                yield pa.RecordBatch.from_arrays([*head, pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(digest, sets)), pa.binary()), pa.array([signer.sign(s).astype("<u4").tobytes() for s in sets], pa.binary())], schema=schema)

    return _keyed(docs, id_col, text_col).mapInArrow(lean(sign), "rid long, id long, k1 long, k2 long, n long, digest binary, sig binary")


def _sliced(texts: pa.Array, size: int, slices: tuple[int, int]):
    """(place of the first text, shingle sets) of slices of the texts, of so many rows and bytes at most."""
    for a, b in byte_slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), *slices):
        yield a, shingle_sets(texts[a:b], size)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i, t = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(F.monotonically_increasing_id().alias("rid"), i.alias("id"), F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit(42)).alias("k2"), t.alias("text"))


def _postings(reps: DataFrame, matches: int) -> DataFrame:
    """(key, rid): the postings to merge."""

    def spread(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(batch.num_rows, -1).astype(np.int64)
                keys = sig + (np.arange(sig.shape[1], dtype=np.int64) << 32)
                yield pa.RecordBatch.from_pydict({"key": keys.ravel(), "rid": np.repeat(batch.column(0).to_numpy(), sig.shape[1])})

    every = stored(reps.select("rid", "sig").mapInArrow(lean(spread), "key long, rid long"), "postings")
    shared = stored(every.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "lists")
    met = attach_groups(every, shared, "key", "df", every.count())
    own = met.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys")).filter(F.size("keys") >= matches)  # COORDINATES keys at most
    return own.select("rid", F.explode(F.slice("keys", F.lit(1), F.size("keys") - matches + 1)).alias("p")).select("p.key", "rid", "p.df")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """rid, n, sig, set of the representatives in `wanted` (rid, k1, k2, sig): the only texts that shuffle."""
    bits = filter_bits(wanted.count())
    bitmaps = stored(slot_bitmaps(wanted, "k1", 1, bits), "bloom")
    maybe, hit = _hits(_keyed(docs, id_col, text_col).drop("rid", "id"), bitmaps, "k1", 1, bits)
    texts = maybe.filter(hit).select("k1", "k2", "text").join(wanted, ["k1", "k2"])

    slices = SLICE_ROWS, SLICE_BYTES

    def shingle(batches):
        hold("shingles", lambda: None)
        for batch in batches:
            for a, sets in _sliced(batch.column(2), size, slices):
                head = [c[a : a + len(sets)] for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*head, pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "sig", "set"])

    return texts.select("rid", "sig", "text").mapInArrow(lean(shingle), "rid long, sig binary, set binary").dropDuplicates(["rid"])


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The sets of a binary column, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
    every = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    every = every[: len(every) // 8 * 8].view(np.uint64)
    return [every[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    return int((b[at] == a).sum()) if len(b) else 0


def _compared(pairs: DataFrame) -> DataFrame:
    """(a, b, sa, sb, ...) -> inter, total of the full sets."""

    def compare(batches):
        for batch in batches:
            got = []
            for p, q in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True):
                both = _common(p, q)
                got.append((both, len(p) + len(q) - both))
            inter, total = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "inter", "total"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(lean(compare), "a long, b long, inter long, total long")


def _block_links(percent: int, matches: int, rounds: bool):
    """Links of a block: of its left rows (side 0) with its right rows (side 1) or, without those, with one another.
    In rounds: with both; and the left rows that are thereby linked to the joined ones."""

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, rid = table.column("side").to_numpy(), table.column("rid").to_numpy()
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links: list[tuple[int, int]] = []
        new: list[int] = []
        if len(own):
            within = rounds or not len(other)
            width = len(table.column("sig")[0].as_py())
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(-1, width // 4)
            sets, dist = _arrays(table.column("set").chunk(0)), table.column("dist").to_numpy()
            size, joined, root = np.array([len(s) for s in sets]), table.column("joined").to_numpy(zero_copy_only=False), {}

            def top(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for at, k in enumerate(own.tolist()):
                rest = np.concatenate([other, own[at + 1 :]]) if within else other
                if not len(rest):
                    continue
                near = (sig[rest] == sig[k]).sum(1) >= matches
                near &= 100 * np.minimum(size[rest], size[k]) >= percent * np.maximum(size[rest], size[k])
                near &= np.abs(dist[rest] - dist[k]) <= 1 - percent / 100 + 1e-9
                for j in rest[near].tolist():
                    # joined members are linked to the pivot already: one stands for all
                    p, q = top(rid[k]), top(-1 if joined[j] else rid[j])
                    if p != q:
                        both = _common(sets[k], sets[j])
                        if 100 * both >= percent * (size[k] + size[j] - both):
                            root[max(p, q)] = min(p, q)
                            links.append((int(rid[k]), int(rid[j])))
            new = [int(rid[k]) for k in own.tolist() if rounds and top(rid[k]) == -1]
        a, b = [x for x, _ in links] + new, [y for _, y in links] + [None] * len(new)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return find


def _pivot_distances(members: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """f, rid, pivot, dist, joined: the distance of each member from its family's central one. The pivots' sets go to
    the members by (family, salt), a salt for each `heavy_limit` members."""
    pivots = members.groupBy("f").agg(F.max_by("rid", F.struct("weight", -F.col("rid"))).alias("pivot"), F.count(F.lit(1)).alias("size"))
    pivots = stored(pivots.withColumn("salts", F.ceil(F.col("size") / heavy_limit(total)).cast("int")), "pivots")
    salted = attach_groups(members.select("f", F.col("rid").alias("a"), F.col("set").alias("sa")), pivots, "f", "size", total).withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int"))
    dealt = pivots.select("f", "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.select(F.col("rid").alias("pivot"), F.col("set").alias("sb")), "pivot")
    met = _compared(salted.drop("pivot").join(dealt, ["f", "salt"]).withColumnRenamed("pivot", "b"))
    near = met.select(F.col("a").alias("rid"), F.col("b").alias("pivot"), (1 - F.col("inter") / F.col("total")).alias("dist"), (100 * F.col("inter") >= percent * F.col("total")).alias("joined"))
    return members.select("f", "rid").join(near, "rid")


def _state(state: DataFrame) -> DataFrame:
    """Of each family with members that are not joined: how many are and are not, and the least distance of those."""
    counts = state.groupBy("f").agg(F.count_if("joined").alias("n_joined"), F.count_if(~F.col("joined")).alias("n_rest"), F.min(F.when(~F.col("joined"), F.col("dist"))).alias("least"))
    return counts.filter("n_rest > 0").withColumn("size", F.col("n_joined") + F.col("n_rest")).withColumn("blocks", F.ceil(F.col("n_rest") / BLOCK).cast("int"))


def _family_links(long_lists: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links among the members of long lists (key, rid, df)."""
    slack, cols = 1 - percent / 100 + 1e-9, ["f", "i", "j", "side", "rid", "sig", "set", "dist", "joined"]
    heads = long_lists.groupBy("key").agg(F.min("rid").alias("head"), F.count(F.lit(1)).alias("size"))
    edges = attach_groups(long_lists, stored(heads, "heads"), "key", "size", long_lists.count()).select("rid", "head").distinct()
    family = connected_components(edges, "rid", "head").withColumnRenamed("node", "rid").withColumnRenamed("component", "f")
    weight = long_lists.groupBy("rid").agg(F.sum("df").alias("weight"))
    members = stored(family.join(weight, "rid").join(sets, "rid"), "members")  # the central member tends to have the longest lists
    total = members.count()
    near = stored(_pivot_distances(members, sets, percent, total), "distances")
    links = [near.filter("joined").select(F.col("rid").alias("a"), F.col("pivot").alias("b"))]
    state, held = near.select("f", "rid", "dist", "joined"), members.select("rid", "sig", "set")

    # Rounds: members that are not joined yet meet those of their block, and some that are.
    for nth in range(ROUNDS):
        crowded = stored(_state(state).filter(F.col("n_rest") > CROWD), "crowded")
        before = crowded.agg(F.sum("n_rest")).first()[0]
        if not before:
            break
        rows = attach_groups(state, crowded, "f", "size", total)
        left = rows.filter("not joined").select("f", F.pmod(F.xxhash64("rid", F.lit(nth)), "blocks").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "rid", "dist", "joined").join(held, "rid").select(cols)
        some = rows.filter(F.col("joined") & (F.col("dist") >= F.col("least") - slack) & (F.pmod(F.xxhash64("rid", F.lit(-1 - nth)), "n_joined") < PIVOTS))
        right = some.select("f", "blocks", F.lit(0).alias("j"), F.lit(1).alias("side"), "rid", "dist", "joined").join(held, "rid").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(cols)
        found = stored(left.unionByName(right).groupBy("f", "i").applyInArrow(_block_links(percent, matches, True), "a long, b long"), "found")
        links.append(found.filter("b is not null"))
        new = found.filter("b is null").select(F.col("a").alias("rid"), F.lit(True).alias("new"))
        state = stored(state.join(new, "rid", "left").select("f", "rid", "dist", (F.col("joined") | F.col("new").isNotNull()).alias("joined")), "state")
        if 5 * new.count() < before:
            break

    # What is left meets, in blocks, all that it can link with.
    rest = stored(_state(state), "rest")
    rows = attach_groups(state, rest, "f", "size", total).filter(~F.col("joined") | (F.col("dist") >= F.col("least") - slack))
    rows = stored(rows.select("f", "rid", "dist", "joined", "blocks"), "outer").join(held, "rid")
    alone = rows.filter("not joined").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    # Blocks (i, i): left rows alone; (i, j), i < j: left i, right j; (i, -1-s): left i, right slice s of the joined.
    slices = rows.filter("joined").groupBy("f").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("slices"), F.count(F.lit(1)).alias("n"))
    later = F.explode(F.sequence("block", F.col("blocks") - 1))
    left = alone.select("*", F.col("block").alias("i"), later.alias("j"), F.lit(0).alias("side")).select(cols)
    right = alone.filter("block > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")).select(cols)
    few = stored(slices, "slices")
    rows_of = rest.select("f", "size").join(few, "f").select("f", "slices", "size")
    sliced_left = attach_groups(alone, rows_of, "f", "size", total).select("*", F.col("block").alias("i"), F.explode(F.sequence(F.lit(1), "slices")).alias("s"), F.lit(0).alias("side")).withColumn("j", -F.col("s")).select(cols)
    sliced = attach_groups(rows.filter("joined"), rows_of, "f", "size", total)
    sliced = sliced.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), (-1 - F.pmod(F.xxhash64("rid"), "slices").cast("int")).alias("j"), F.lit(1).alias("side")).select(cols)
    dealt = left.unionByName(right).unionByName(sliced_left).unionByName(sliced)
    links.append(dealt.groupBy("f", "i", "j").applyInArrow(_block_links(percent, matches, False), "a long, b long"))
    return union_all(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept. Texts link when
    100 * intersection >= percent * union of their sets of `size`-word shingles."""
    marks = settled(docs.sparkSession, "marks", lambda: _marks(docs, id_col, text_col, size, percent))
    return marks.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(a, b): links between representatives, enough for their components."""
    matches = matches_for(percent)
    postings = stored(_postings(classes, matches), "prefixes")
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    merged = stored(attach_groups(postings, stored(lists, "lists"), "key", "size", postings.count()), "merged")
    wanted = classes.join(merged.select("rid").distinct(), "rid").select("rid", "k1", "k2", "sig")
    sets = stored(_sets(docs, stored(wanted, "wanted"), id_col, text_col, size), "sets")
    short = merged.filter(F.col("size") <= SHORT).select("key", "rid")
    pairs = short.select("key", F.col("rid").alias("a")).join(short.select("key", F.col("rid").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    held = stored(pairs, "pairs").join(sets.select(F.col("rid").alias("a"), F.col("set").alias("sa")), "a")
    held = held.join(sets.select(F.col("rid").alias("b"), F.col("set").alias("sb")), "b")
    links = _compared(held).filter(100 * F.col("inter") >= percent * F.col("total")).select("a", "b")
    long_lists = merged.filter(F.col("size") > SHORT)
    return links if long_lists.isEmpty() else links.unionByName(_family_links(long_lists.select("key", "rid", "df"), sets, percent, matches))


def _marks(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    signed = stored(_signatures(docs, id_col, text_col, size), "signatures")
    total = signed.count()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    filled = signed.filter("n > 0")
    classes = stored(filled.groupBy("digest").agg(F.min(F.struct(order.alias("o"), "k1", "k2", "n", "sig")).alias("r"), F.count(F.lit(1)).alias("size")).select("digest", "size", F.col("r.o").alias("o"), F.col("r.o.rid").alias("rid"), "r.k1", "r.k2", "r.sig"), "classes")
    links = settled(spark, "links", lambda: _links(docs, classes, id_col, text_col, size, percent))
    nodes = connected_components(links, "a", "b")
    joined = classes.select("digest", "size", "o", "rid").join(nodes, F.col("rid") == F.col("node"), "left").select("digest", "size", "o", F.coalesce("component", "rid").alias("component"))
    joined = stored(joined, "nodes")
    least = joined.groupBy("component").agg(F.min("o").alias("least"), F.count(F.lit(1)).alias("members"))
    best = stored(attach_groups(joined, stored(least, "least"), "component", "members", total).select("digest", "size", "least"), "best")
    grouped = attach_groups(filled.select("id", "rid", "n", "k1", "k2", "digest"), best, "digest", "size", total)
    best_row = ["id", "rid", "n", "k1", "k2"]
    out = grouped.select(*best_row, F.col("least.id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("kept"))
    alone = signed.filter("n = 0").select(*best_row, F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component, that with the smallest id; all its columns. Rows that a filter
    over the dropped ones rules out pass straight through; only the others shuffle."""
    k1, k2 = fresh(docs, "k1", "k2")
    marks = settled(docs.sparkSession, "marks", lambda: _marks(docs, id_col, text_col, size, percent))
    # A row equal to a kept one in id and text has its keys too: of such rows one stays.
    gone = stored(marks.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.max(F.when(F.col("kept"), 1).otherwise(0)).alias("n_kept"), F.count(F.lit(1)).alias("n_rows")).filter("n_kept < n_rows and (n_kept = 0 or n_rows > 1)"), "gone")
    bits = filter_bits(gone.count())
    i, t = F.col(id_col).cast("long"), F.col(text_col)
    keyed = docs.withColumn(k1, F.xxhash64(i, t)).withColumn(k2, F.xxhash64(t, i, F.lit(42)))
    maybe, hit = _hits(keyed, stored(slot_bitmaps(gone, k1, 1, bits), "bloom"), k1, 1, bits)
    touched = maybe.filter(hit).drop(hit)
    untouched = maybe.filter(~F.col(hit)).select(*docs.columns)
    spared = touched.join(gone.select(k1, k2), [k1, k2], "left_anti").select(*docs.columns)
    one = touched.join(gone.filter("n_kept = 1").select(k1, k2), [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*docs.columns)
    return untouched.unionByName(spared).unionByName(one)
