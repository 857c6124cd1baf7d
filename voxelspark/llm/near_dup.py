"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets are one class, collapsed before anything else, and named by its least id. A class's signature
has ``VALUES`` SuperMinHash components, cut in ``BANDS`` bands; classes that share a band's bucket are candidates.

1. Every class is compared with the least one of each of its buckets, on full sets. The larger side of such a star is salted: copies of a hub's set serve ``STAR`` neighbours each.
2. A distributed union-find joins the verified links. A bucket whose classes are now all in one component has nothing more to tell; groups of near copies end here.
3. The classes of the other buckets form rough components. In each of these, the largest verified component needs no comparison within itself; all others are compared with
   everything, in blocks of bounded number and bytes, through posting lists. Tasks give spanning forests of the verified links, never pairs, and the union-find joins these.

At a similarity of 0.75 a pair shares no band with a probability below 6e-6; no candidate is left unverified.

Defined results: null, empty or blank texts have an empty set and are linked with nothing; shorter texts than a shingle have their whole sequence as one; repeated rows
are copies; ids are taken as unique: of rows that share an id each is grouped by its own text, and classes with the same least id count as one; a row without an id is linked with nothing
and has no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

VALUES, BANDS = 128, 32
#: Neighbours that one copy of a hub's set serves.
STAR = 256
#: Classes and bytes of sets of a block; two blocks meet in a task.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Posting entries that are counted at once.
PIECE = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the texts' offsets among them."""
    low = C.lower_ascii(data)
    s, e, rows = C.words(low, offsets)
    sh, row = C.shingles(C.word_hashes(low, s, e), rows, size)
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    first = np.ones(len(sh), bool)
    first[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    return sh[first], np.searchsorted(row[first], np.arange(len(offsets)))


def super_min_hash(elements: np.ndarray, offsets: np.ndarray, values: int = VALUES) -> np.ndarray:
    """(rows, values) SuperMinHash signatures; a row of no element has infinite components.

    Step j gives each element of a row a place that it had in no step before (a prefix of its own random permutation) and the value j + uniform.
    A row stops as soon as all its components are below the least value that a further step could give.
    """
    rows = len(offsets) - 1
    out = np.full((rows, values), np.inf)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    order = None
    for j in range(values):
        if j:
            open_ = (out.max(1) >= j)[row]
            if not open_.any():
                break
            if not open_.all():
                row, elements = row[open_], elements[open_]
                order = order[open_] if order is not None else None
                place0 = place0[open_] if j == 1 else None
            if j == 1:
                order = np.tile(np.arange(values, dtype=np.uint8), (len(row), 1))
                at = np.arange(len(row))
                order[at, place0] = 0
        draw = C.mix(elements + np.uint64((j * 0x9E3779B97F4A7C15 + 0x51ED270B) & (2**64 - 1)))
        k = j + ((draw & np.uint64(0xFFFFF)) % np.uint64(values - j)).astype(np.int64)
        if j == 0:
            place = place0 = k
        else:
            at = np.arange(len(row))
            place = order[at, k].astype(np.int64)
            order[at, k] = order[at, j]
        np.minimum.at(out.reshape(-1), row * values + place, j + (draw >> np.uint64(20)) * 2.0**-44)
    return out


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(rows, bands) hashes of the bands of signatures."""
    v = C.mix(signatures.view(np.uint64)).reshape(len(signatures), bands, -1)
    return C.mix((v * np.array(C.MIX[: v.shape[2]])).sum(2) + np.arange(bands, dtype=np.uint64)[None, :] * C.MIX[40])


def _keys(sets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 16-byte key of each set."""
    parts = []
    for i in (1, 2):
        total = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(C.mix(sets ^ C.MIX[50 + i]), out=total[1:])
        parts.append(C.mix((total[offsets[1:]] - total[offsets[:-1]]) + np.diff(offsets).astype(np.uint64)))
    return [x.tobytes() for x in np.stack(parts, 1)]


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key and band hashes of every document; key and bands are null for empty sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(1)):
                sets, at = shingle_sets(data, offsets)
                n = np.diff(at)
                bands = band_hashes(super_min_hash(sets, at)).view(np.int64)
                keys = [k if c else None for k, c in zip(_keys(sets, at), n, strict=True)]
                full = n > 0
                lists = pa.ListArray.from_arrays(pa.array(C.from_offsets(np.where(full, BANDS, 0)).astype(np.int32)), pa.array(bands[full].ravel()))
                yield C.batches(schema, [b.column(0).slice(i, j - i), n, keys, lists])

    return C.map_arrow(docs, run, "doc_id long, n_shingles long, key binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """id, key and sorted set of documents (doc_id, text)."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(1)):
                sets, at = shingle_sets(data, offsets)
                yield C.batches(schema, [b.column(0).slice(i, j - i), _keys(sets, at), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))])

    return C.map_arrow(docs.select("doc_id", "text"), run, "id long, key binary, hashes array<long>").dropDuplicates(["id", "key"])


def forest(sets: list[np.ndarray], percent: int, asked: np.ndarray) -> list[tuple[int, int]]:
    """For each set that links reach a smaller number from: (the set's number, the least number reached). Only links with a set that is ``asked`` about are looked for.

    A posting list of every element that several sets have gives an asked set's intersections with all others at once, so no pair is ever stored; long lists are counted in pieces.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    _, inverse, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    inverse = inverse.astype(np.int32)
    posting = np.repeat(np.arange(n, dtype=np.int32), size)[np.argsort(inverse, kind="stable")]
    start, at = C.from_offsets(many), C.from_offsets(size)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in np.flatnonzero(asked).tolist():
        own = inverse[at[i] : at[i + 1]]
        own = own[many[own] > 1]
        total, both = np.cumsum(many[own]), np.zeros(n, np.int64)
        cuts = np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, PIECE)), len(own))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            length = many[own[x:y]]
            places = np.repeat(start[own[x:y]] - C.from_offsets(length)[:-1], length) + np.arange(int(length.sum()))
            both += np.bincount(posting[places], minlength=n)
        both[i] = 0
        for j in np.flatnonzero((both > 0) & (100 * both >= percent * (size[i] + size - both))):
            x, y = find(i), find(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
    return [(i, r) for i in range(n) if (r := find(i)) != i]


def _star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The verified links (a, b) of each class with the least one of its buckets."""
    pairs = C.materialize(members.where("center != id").select("center", "id").distinct(), members.count())
    copies = C.checked_broadcast(pairs.groupBy("center").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies")))
    dealt = pairs.join(copies, "center").select("center", "id", F.pmod(F.xxhash64("id"), "copies").cast("int").alias("salt"))
    hubs = sets.join(copies, sets["id"] == copies["center"]).select("center", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("hashes").alias("own"))
    both = dealt.join(sets.select("id", "hashes"), "id").join(hubs, ["center", "salt"])
    common = F.size(F.array_intersect("hashes", "own"))
    return both.where(common * 100 >= (F.size("hashes") + F.size("own") - common) * percent).select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()


def _block_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span what each group of ``placed`` (root, i, j; id, minor) has in common."""

    def run(table):
        table = table.sort_by("id")
        ids, hashes = table.column("id").to_pylist(), table.column("hashes").combine_chunks()
        at, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
        found = forest([values[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], percent, table.column("minor").to_numpy(zero_copy_only=False)) if len(ids) > 1 else []
        return pa.table({"a": pa.array([ids[r] for _, r in found], pa.int64()), "b": pa.array([ids[i] for i, _ in found], pa.int64())})

    C.ship(placed.sparkSession)
    return placed.join(sets.select("id", "hashes"), "id").groupBy("root", "i", "j").applyInArrow(run, "a long, b long")


def _open_pairs(members: DataFrame, found: DataFrame) -> DataFrame | None:
    """The classes of buckets that hold several components, dealt out so that every two of different components meet: root, i, j, id, minor. None if there are none.

    Within a rough component the classes of its largest verified component are dealt in blocks after those of the others (``minor``); a pair of blocks has a block of others in it.
    """
    named = members.join(found.withColumnRenamed("node", "id").withColumnRenamed("root", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rows = members.count()
    named = C.materialize(named, rows)
    mixed = named.groupBy("band", "bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("id").alias("least")).where("low < high").select("band", "bucket", "least")
    mixed = C.materialize(named.join(C.checked_broadcast(C.materialize(mixed, rows)), ["band", "bucket"]).select("id", "size", "comp", "least").distinct(), rows)
    if mixed.isEmpty():
        return None
    rows = mixed.count()
    rough = components(mixed.select(F.col("least").alias("a"), F.col("id").alias("b")), rows)
    rough = C.materialize(mixed.select("id", "size", "comp").distinct().join(rough.withColumnRenamed("node", "id"), "id"), rows)
    largest = rough.groupBy("root", "comp").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
    blocks = lambda minor: F.greatest(F.ceil(F.count(F.when(minor, 1)) / BLOCK), F.ceil(F.sum(F.when(minor, F.col("size")).otherwise(0)) * 8 / BLOCK_BYTES)).cast("int")
    rough = rough.join(C.checked_broadcast(C.materialize(largest, rows)), "root").withColumn("minor", F.col("comp") != F.col("largest"))
    dealt = C.materialize(rough.groupBy("root").agg(blocks(F.col("minor")).alias("minors"), blocks(~F.col("minor")).alias("majors")), rows)
    placed = rough.join(C.checked_broadcast(dealt), "root").withColumn("block", F.when(F.col("minor"), F.pmod(F.xxhash64("id"), "minors")).otherwise(F.col("minors") + F.pmod(F.xxhash64("id"), "majors")).cast("int"))
    others = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") - 1))
    placed = placed.select("root", "id", "minor", "block", F.explode(others).alias("other"))
    return placed.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "minor")


def group_near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id that links reach) and kept of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = C.materialize(_signed(docs))
    classes = C.materialize(signed.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("size"), F.min("bands").alias("bands")), signed.count())
    rows = classes.select(F.col("first").alias("id"), "size", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("id").alias("center")).where("n > 1").drop("n")
    members = C.materialize(rows.join(shared, ["band", "bucket"]), BANDS * signed.count())
    used = members.select(F.col("id").alias("doc_id")).distinct()
    sets = C.materialize(_sets(docs.join(C.checked_broadcast(used), "doc_id", "left_semi")), 20 * used.count())  # a set is some 20 times a narrow row
    found = components(_star_links(members, sets, percent), members.count())
    placed = _open_pairs(members, found)
    if placed is not None:
        links = found.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(_block_links(placed, sets, percent))
        found = components(links, signed.count())
    C.drop(members, sets)
    named = classes.join(found, F.col("first") == F.col("node"), "left").select("key", F.coalesce("root", "first").alias("component_id"))
    own = F.when(F.col("key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = signed.drop("bands").join(named, "key", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return C.few(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), signed.count(), C.FILE_ROWS // 10)
