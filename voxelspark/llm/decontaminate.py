"""Benchmark passages inside documents: size-partitioned MinHash containment search in DataFrame operations only.

An item is found in a document if at least ``percent`` % of the item's distinct word shingles are among the document's. Items are short and documents long, so the similarity of
whole signatures says nothing; both sides get MinHash sketches whose thresholds are set by the size of the item instead.

1. Items are partitioned by size (powers of two of their number n of shingles). A partition asks for ``needed`` common hashes, more for larger items.
2. An item's sketch holds its n - ceil(n * percent / 100) + needed least shingle hashes. A document that contains the item lacks at most n - ceil(n * percent / 100) of its
   shingles, so it has at least ``needed`` hashes of the sketch, whichever they are.
3. A partition's threshold is the greatest hash in its items' sketches; a document's sketch for the partition holds its hashes up to that threshold. Documents' sketches
   nest, so one table, up to the greatest threshold, serves all partitions.
4. Sketches meet in one join; pairs with ``needed`` common hashes are candidates, so none is missed (recall 1), and are verified by counting equal shingles, word for word.

Defined results: null, empty or blank texts and items have no shingle and are never found; a text or item of fewer words than a shingle has its whole sequence as one;
repeated rows give one row, and rows that share an id count with all their shingles together; a null doc_id or item_id is never found; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for blank or null texts."""
    clean = F.trim(F.lower(text), F.lit(_SPACES))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(clean, "[\\x20\\x09-\\x0D]+"))


def _shingled(w: Column, size: int, join) -> Column:
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))
    short = F.when(F.size(w) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(w) >= size, F.transform(starts, lambda i: join([F.element_at(w, i + k) for k in range(size)]))).otherwise(F.transform(short, lambda i: join([F.try_element_at(w, F.lit(k + 1)) for k in range(size)])))


def shingle_hashes(text: Column, size: int = 5) -> Column:
    return C.bound(words(text), lambda w: _shingled(w, size, lambda parts: F.xxhash64(*parts)))


def shingle_texts(text: Column, size: int = 5) -> Column:
    return F.array_distinct(C.bound(words(text), lambda w: _shingled(w, size, lambda parts: F.concat_ws(" ", *parts))))


def needed(n: Column) -> Column:
    """Common sketch hashes that a candidate must have, by the item's partition: 1 below 8 shingles, then one more for each doubling, 4 at most."""
    return F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.log2(n.cast("double"))).cast("int") - 1))


def item_sketches(items: DataFrame, percent: int) -> DataFrame:
    """item_id, needed and one sketch hash a row, of items with distinct ``hashes``."""
    n = F.size("hashes")
    length = n - F.ceil(n * percent / F.lit(100)).cast("int") + needed(n)
    return items.select("item_id", needed(n).alias("needed"), F.explode(F.slice(F.array_sort("hashes"), F.lit(1), length)).alias("hash"))


def find_items(docs: DataFrame, items: DataFrame, percent: int = 75, size: int = 5, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles of every item found in a document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    items = items.select(F.col(item_id).alias("item_id"), F.col(text_col).alias("text")).where("item_id IS NOT NULL")
    pieces = items.select("item_id", F.explode(shingle_texts(F.col("text"), size)).alias("shingle")).distinct()
    hashed_items = items.select("item_id", F.explode(shingle_hashes(F.col("text"), size)).alias("hash")).groupBy("item_id").agg(F.collect_set("hash").alias("hashes"))
    sketch = C.materialize(item_sketches(hashed_items, percent), 100 * items.count())
    threshold = sketch.agg(F.max("hash")).first()[0]
    own = F.filter(F.array_distinct(shingle_hashes(F.col("text"), size)), lambda h: h <= F.lit(threshold)) if threshold is not None else F.array().cast("array<long>")
    met = docs.select("doc_id", F.explode(own).alias("hash")).join(C.checked_broadcast(sketch), "hash")
    candidates = C.materialize(met.groupBy("doc_id", "item_id").agg(F.countDistinct("hash").alias("n"), F.first("needed").alias("needed")).where("n >= needed").select("doc_id", "item_id"), docs.count())
    # verification: a suspected document's shingles meet those of all items, and count where the pair is a candidate
    counted = C.materialize(pieces.withColumn("n", F.count("*").over(Window.partitionBy("item_id"))), 100 * items.count())
    texts = docs.join(C.checked_broadcast(candidates.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.explode(shingle_texts(F.col("text"), size)).alias("shingle"))
    both = texts.join(C.checked_broadcast(counted), "shingle").join(C.checked_broadcast(candidates), ["doc_id", "item_id"], "left_semi")
    found = both.groupBy("doc_id", "item_id").agg(F.max("n").alias("item_shingles"), F.countDistinct("shingle").alias("shared_shingles"))
    return found.where(F.col("shared_shingles") * 100 >= F.col("item_shingles") * percent)


def remove_contaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; rows without an id stay."""
    gone = C.materialize(find_items(docs, items, percent).select("doc_id").distinct(), docs.count())
    return docs.join(C.checked_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
