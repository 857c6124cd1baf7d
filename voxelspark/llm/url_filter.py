"""URL rules answered by Bloom filter cascades.

A cascade is a list of Bloom filters over 64-bit key hashes. Level 0 holds the listed keys; level 1 the keys of the corpus's complete
universe that pass level 0 without being listed; level 2 the listed keys that pass level 1; and so on until no false positive is left.
Over that universe its answers are exact, and no join is needed to get them. Level 0 is sized by the size of the universe so that about as many keys
pass it wrongly as are listed, hence all levels together grow with the rules (times the logarithm of the universe), not with the corpus.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; repeated rows are judged alike;
an empty table gives no rows; of a block and an allow rule that are the same, block holds; a rule given twice counts once; a null page_id is judged like any other; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Bloom:
    bits: np.ndarray  # bytes
    size: int
    hashes: int
    seed: int

    @classmethod
    def of(cls, keys: np.ndarray, rate: float, seed: int) -> Bloom:
        n = max(1, len(keys))
        size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        out = cls(np.zeros(size // 8 + 1, np.uint8), size, max(1, round(size / n * math.log(2))) if rate < 0.5 else 1, seed)
        for at in out._places(keys):
            np.bitwise_or.at(out.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return out

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        a = C.mix(keys ^ C.MIX[self.seed % 60])
        b = C.mix(a) | np.uint64(1)
        for _ in range(min(self.hashes, 30)):
            yield (a % np.uint64(self.size)).astype(np.int64)
            a = a + b

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that the cascade was built over."""
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        open_ = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            passed = level.has(keys[open_])
            out[open_[~passed]] = i % 2 == 1
            open_ = open_[passed]
        return out


def build_cascade(universe: DataFrame, size: int, listed: np.ndarray, spare: int = 64) -> Cascade:
    """``universe``: one long column of distinct key hashes. ``size``: about their number. ``listed``: uint64 hashes.

    The wrongly passing keys come to the driver; their number is checked against 4 * len(listed) + ``spare`` first, and level 0 is made
    larger until they fit.
    """
    listed = np.unique(listed)
    if not len(listed):
        return Cascade(())
    rate = min(0.5, math.sqrt(0.5) * len(listed) / max(1, size))
    most = 4 * len(listed) + spare
    while True:
        first = Bloom.of(listed, rate, 0)

        def wrong(batches, first=first):
            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                keys = keys[first.has(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[~np.isin(keys, listed)].view(np.int64))], ["key"])

        found = C.map_arrow(universe, wrong, "key long").limit(most + 1).toPandas()["key"].to_numpy(np.int64).view(np.uint64)
        if len(found) <= most:
            break
        rate /= 16
    levels, inside, outside = [first], np.unique(found), listed
    while len(inside):
        levels.append(Bloom.of(inside, 0.5 if len(inside) > 64 else 0.01, len(levels)))
        inside, outside = outside[levels[-1].has(outside)], inside
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def filter_urls(pages: DataFrame, block: list[str], allow: list[str], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each row's host, path, the longest rule that fits (host + path; null if none) and verdict."""
    spark = pages.sparkSession
    lengths = sorted({len(_split_rule(r)[1]) for r in [*block, *allow]})
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # a suffix of more labels than the longest rule's host fits no rule, so hosts of any length have a bounded number of keys
    most = max((_split_rule(r)[0].count(".") + 1 for r in [*block, *allow]), default=1)
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, most + 1)]))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    keyed = rows.withColumn("keys", F.when(F.col("host") == "", F.array().cast("array<struct<h:string,p:string>>")).otherwise(keys)).withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k["h"], k["p"])))
    universe = C.materialize(keyed.select(F.explode("hashes").alias("key")).distinct())
    size = universe.count()
    rules = [(i, *_split_rule(r)) for i, group in enumerate((block, allow)) for r in group]
    hashed = spark.createDataFrame(rules, "kind int, h string, p string").select("kind", F.xxhash64("h", "p").alias("k")).collect() if rules else []
    cascades = [build_cascade(universe, size, np.array([r.k for r in hashed if r.kind == i], np.int64).view(np.uint64)) for i in (0, 1)]
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def judge(batches):
        for b in batches:
            at, hashes = b.column(4).offsets.to_numpy().astype(np.int64), b.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = at - at[0]
            kinds = [c.has(hashes) if c.levels else np.zeros(len(hashes), bool) for c in cascades]
            rule, verdict = [None] * b.num_rows, [default] * b.num_rows
            row = np.searchsorted(at, np.flatnonzero(kinds[0] | kinds[1]), "right") - 1
            parts = b.column(3)
            for r in np.unique(row):
                best = None
                for i, k in enumerate(parts[int(r)].as_py()):
                    j = at[r] + i
                    if (kinds[0][j] or kinds[1][j]) and (best is None or len(k["h"]) + len(k["p"]) > len(best[0])):
                        best = (k["h"] + k["p"], "block" if kinds[0][j] else "allow")
                rule[r], verdict[r] = best
            yield C.batches(schema, [b.column(0), b.column(1), b.column(2), rule, verdict])

    return C.map_arrow(keyed.select("page_id", "host", "path", "keys", "hashes"), judge, "page_id long, host string, path string, rule string, verdict string")
