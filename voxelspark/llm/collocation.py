"""Phrase collocations: counts of all phrases that can matter, by minimal perfect hashes over candidates, and the score of their weakest cut.

Texts are lower-cased (A-Z), parted at punctuation and line ends, and the parts into words; a phrase is a run of words within a part, and all counts are by language.

1. Tasks count the hashes of words and pairs and send one row for each segment of the hash range; a segment's task adds them up and keeps a bit for each hash that occurs ``least`` times. These bits are a filter of fixed size
   (``FILTER_BITS``); hashes that share a bit only add candidates. Then phrases of three words, and so on, are counted alike, if both their parts of one word less pass: a phrase is never more frequent than its parts, so
   none that matters is lost (Apriori).
2. What passes all filters is a candidate: a language and the 64-bit hashes of its words. Tasks add up candidates and send them to segments of a hash, as arrays; the texts of words go beside them.
3. A segment gets a minimal perfect hash: levels of bits in which a key stands where no other key of the level fell, and a slot is the rank of its bit. Its keys are stored by slot, and every use compares
   language and words with the stored ones.
4. A segment's rows, from all tasks, are turned into slots chunk by chunk and ``bincount`` into arrays, which are summed as a tree. Candidates cross the network once, so building the hashes and counting by them share a task.
5. The counts of both parts of every cut are read by slot, by tasks that hold one segment each; requests are dealt out to several tasks, so a word that is part of very many phrases is asked for in many.
6. What can be among a language's best, ties included, gets its words' texts, and is ranked.

No task holds a language, and nothing but the filters goes through the driver.

Defined results: a null text is empty; a null language is ``und``; repeated rows count; a language without candidates gives no rows, as does an empty table; other columns are ignored. Words are told apart
by 64 bits, phrases by the hashes of all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Words of the longest phrase, occurrences of a candidate, phrases that are returned for each language, and the share in % of its occurrences that a longer phrase must have to displace it.
WORDS, LEAST, TOP, WITHIN = 3, 10, 2000, 50
#: In decimals of 38 digits, which hold the products of counts up to 10**15.
SCORE = "CAST((CAST(1000000 AS DECIMAL(38,0)) * a * a) DIV (CAST(l AS DECIMAL(38,0)) * r) AS LONG)"
FILTER_BITS = 26
SLICE = 1 << 20
#: Candidates whose counts a task of step 2 holds; beyond that it stores them and starts anew.
TASK_KEYS = 1 << 18
#: Bytes of text whose hashes meet in a task of step 1, and for which there is a segment; candidates that a mapper of step 4 or a reader of step 5 takes; arrays that are summed at once.
RANGE_BYTES, SEGMENT_BYTES, ENTRIES, FAN = 8 << 20, 8 << 20, 1 << 18, 8

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x09, 0x20]] = True


# ---------------------------------------------------------------- phrases of a slice of texts


def phrase_hash(lang: np.ndarray, words: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """A hash of phrases, given the codes of their languages and the hashes of their first, second, ... words."""
    h = lang * C.MIX[60] + C.U64(len(words))
    for i, w in enumerate(words):
        h += w * C.MIX[salt + i]
    return C.mix(h)


class Slice:
    """The words of a slice of texts: hashes, starts in ``flat`` (all words, each with a blank after it), lengths, rows, and how many words follow in the same part."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        data = C.lower_ascii(data)
        word = ~_GAP[data]
        row_start = np.zeros(len(data) + 1, bool)
        row_start[offsets] = True
        begins = word & (np.append(False, ~word[:-1]) | row_start[:-1]) if len(data) else word
        ends = word & (np.append(~word[1:], True) | row_start[1:]) if len(data) else word
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        broken = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_BREAK[data] | row_start[:-1], out=broken[1:])
        self.row = np.searchsorted(offsets, s, "right") - 1
        self.hash = C.word_hashes(data, s, e) if len(s) else np.zeros(0, np.uint64)
        self.length = e - s
        self.at = C.from_offsets(self.length + 1)[:-1]
        self.flat = np.full(int((self.length + 1).sum()), 0x20, np.uint8)
        inside = np.flatnonzero(word)
        self.flat[np.arange(len(inside)) + np.repeat(np.arange(len(s)), self.length)] = data[inside]
        part = broken[s + 1] if len(s) else s  # a word has no break, so its part's number is that behind its first byte
        self.lang = langs[self.row]
        last = np.flatnonzero(np.append(part[1:] != part[:-1], True)) if len(s) else s
        self.left = last[np.searchsorted(last, np.arange(len(s)))] - np.arange(len(s))

    def phrases(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first words of all phrases of ``words`` words, and the phrases' hashes."""
        at = np.flatnonzero(self.left >= words - 1)
        return at, phrase_hash(self.lang[at], [self.hash[at + i] for i in range(words)])

    def texts(self, at: np.ndarray, words: int) -> pa.Array:
        end = self.at[at + words - 1] + self.length[at + words - 1]
        size = end - self.at[at]
        offsets = C.from_offsets(size)
        index = np.arange(offsets[-1]) + np.repeat(self.at[at] - offsets[:-1], size)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.flat[index]))


def _code(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang if lang is not None else "und").encode(), digest_size=8).digest(), "little")


def _sliced(batches):
    """(slice, languages by row) of batches of text and lang."""
    for b in batches:
        langs = b.column(1).to_pylist()
        codes = {x: _code(x) for x in set(langs)}
        codes = np.array([codes[x] for x in langs], np.uint64)
        for i, j, data, offsets in C.slices(b.column(0), SLICE):
            yield Slice(data, offsets, codes[i:j]), langs[i:j]


# ---------------------------------------------------------------- step 1: the filters


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit."""
    cell = h >> C.U64(62 - len(bits).bit_length())  # len(bits) is a power of two, of bytes
    return (bits[(cell >> C.U64(3)).astype(np.int64)] >> (C.U64(7) - (cell & C.U64(7))).astype(np.uint8)) & 1 == 1


def candidates(piece: Slice, filters: list[np.ndarray], words: int):
    """For each number of words: it, and first words and hashes of the phrases that pass the filters and whose parts, one word shorter, do. The first filter is that of words and pairs."""
    shorter = None
    for k in range(1, words + 1):
        at, h = piece.phrases(k)
        if k > 2:
            ok = shorter[at] & shorter[at + 1]
            at, h = at[ok], h[ok]
        if max(0, k - 2) < len(filters):
            ok = _passes(filters[max(0, k - 2)], h)
            at, h = at[ok], h[ok]
        yield k, at, h
        shorter = np.zeros(len(piece.hash) + 1, bool)
        shorter[at] = True


def frequent_bits(texts: DataFrame, least: int, filters: list[np.ndarray], bits: int = FILTER_BITS) -> np.ndarray:
    """The filter after ``filters``: 2**bits bits, packed: those of the highest bits of each hash that occurs ``least`` times among the next longer candidates."""
    wanted = -(-C.text_bytes(texts) // RANGE_BYTES)
    log = min(bits - 10, max(0, int(wanted - 1).bit_length()))  # so many segments, as a power of two
    schema = pa.schema([("seg", pa.int32()), ("h", pa.binary()), ("n", pa.binary())])
    sizes = [len(filters) + 2] if filters else [1, 2]
    sent = texts.sparkSession.sparkContext.broadcast([x.tobytes() for x in filters])

    def rows(parts: list[np.ndarray]):
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.searchsorted(h >> C.U64(64 - log), np.arange((1 << log) + 1, dtype=np.uint64)) if log else np.array([0, len(h)])
        full = np.flatnonzero(cut[1:] > cut[:-1])
        n = n.astype("<u4")
        for k in range(0, len(full), 256):
            some = full[k : k + 256]
            yield C.batches(schema, [some.astype(np.int32), [h[cut[i] : cut[i + 1]].tobytes() for i in some], [n[cut[i] : cut[i + 1]].tobytes() for i in some]])

    def count(batches):
        known = [np.frombuffer(x, np.uint8) for x in sent.value]
        held, size = [], 0
        for piece, _ in _sliced(batches):
            for k, _, h in candidates(piece, known, sizes[-1]):
                if k in sizes:
                    held.append(h)
                    size += len(h)
            if size > 1 << 21:
                yield from rows(held)
                held, size = [], 0
        if size:
            yield from rows(held)

    def add(table):
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("h")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("n")]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        found = h[first][np.add.reduceat(n, first) >= least]
        own = np.zeros(1 << (bits - log), bool)
        own[((found >> C.U64(64 - bits)) & C.U64((1 << (bits - log)) - 1)).astype(np.int64)] = True
        return pa.table({"seg": table.column("seg")[:1], "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    C.ship(texts.sparkSession)
    stored = C.materialize(C.map_arrow(texts, count, "seg int, h binary, n binary").groupBy("seg").applyInArrow(add, "seg int, bits binary"))
    out = np.zeros((1 << log, 1 << (bits - log - 3)), np.uint8)
    for r in stored.collect():  # 2**bits bits, whatever the corpus
        out[r.seg] = np.frombuffer(r.bits, np.uint8)
    C.drop(stored)
    sent.unpersist()
    return out.ravel()


# ---------------------------------------------------------------- step 2: candidates


#: The segment that has the number of words of each language.
TOTALS = -1
ROW = "seg int, lang string, words int, keys binary, n binary, texts array<string>"


def _segments_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (h % C.U64(segments)).astype(np.int64)


def added(lang: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of the different (language, words), the sums of their counts, and their hashes."""
    h = phrase_hash(lang, list(keys.T))
    order = np.argsort(h, kind="stable")
    sorted_lang, sorted_keys = lang[order], keys[order]
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (sorted_lang[1:] != sorted_lang[:-1]) | (sorted_keys[1:] != sorted_keys[:-1]).any(1)) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat(n[order], first) if len(first) else n[:0], h[order[first]]


def occurrences(texts: DataFrame, least: int, words: int, segments: int) -> DataFrame:
    """Partial counts of all candidates: seg, lang, words, keys (the words' hashes, one candidate after the other), n (their counts) and, for single words, texts; and for each language the number of all words (words 0)."""
    filters: list[np.ndarray] = []
    for _ in range(1, max(2, words)):
        filters.append(frequent_bits(texts, least, filters))
    sent = texts.sparkSession.sparkContext.broadcast([x.tobytes() for x in filters])
    schema = pa.schema([("seg", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("texts", pa.list_(pa.string()))])

    def rows(k: int, lang, keys, n, text, names: dict[int, str]):
        seg = _segments_of(phrase_hash(lang, list(keys.T)), segments)
        order = np.lexsort((seg, lang))
        seg, lang, keys, n = seg[order], lang[order], keys[order], n[order].astype("<u4")
        text = text.take(pa.array(order)) if text is not None else None
        cut = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (lang[1:] != lang[:-1])))
        ends = np.append(cut[1:], len(seg))
        for i in range(0, len(cut), 64):
            own = list(zip(cut[i : i + 64].tolist(), ends[i : i + 64].tolist(), strict=True))
            held = pa.array([text.slice(a, b - a).to_pylist() for a, b in own] if text is not None else [None] * len(own), pa.list_(pa.string()))
            yield C.batches(schema, [seg[[a for a, _ in own]].astype(np.int32), [names[int(lang[a])] for a, _ in own], np.full(len(own), k, np.int32), [keys[a:b].tobytes() for a, b in own], [n[a:b].tobytes() for a, b in own], held])

    def run(batches):
        known = [np.frombuffer(x, np.uint8) for x in sent.value]
        names: dict[int, str] = {}
        total: dict[int, int] = {}
        held: dict[int, list] = {k: [] for k in range(1, words + 1)}
        size = 0

        def merge(k: int) -> int:
            if held[k]:
                lang, keys, n = (np.concatenate([x[i] for x in held[k]]) for i in range(3))
                first, n, _ = added(lang, keys, n)
                text = pa.concat_arrays([x[3] for x in held[k]]).take(pa.array(first)) if k == 1 else None
                held[k] = [(lang[first], keys[first], n, text)]
            return sum(len(x[0]) for x in held[k])

        def release():
            for k in held:
                if merge(k):
                    yield from rows(k, *held[k][0], names)
                held[k] = []

        for piece, langs in _sliced(batches):
            names |= {_code(x): x if x is not None else "und" for x in set(langs)}
            codes, many = np.unique(piece.lang, return_counts=True)
            for c, x in zip(codes.tolist(), many.tolist(), strict=True):
                total[c] = total.get(c, 0) + x
            for k, at, _ in candidates(piece, known, words):
                keys = np.stack([piece.hash[at + i] for i in range(k)], 1)
                first, n, _ = added(piece.lang[at], keys, np.ones(len(at), np.int64))
                held[k].append((piece.lang[at[first]], keys[first], n, piece.texts(at[first], 1) if k == 1 else None))
                size += len(first)
            del piece, at, keys, first, n
            if size > 2 * TASK_KEYS:
                size = sum(merge(k) for k in held)
                if size > TASK_KEYS:
                    yield from release()
                    size = 0
        yield from release()
        if total:
            none = [None] * len(total)
            yield C.batches(schema, [np.full(len(total), TOTALS, np.int32), [names[c] for c in total], np.zeros(len(total), np.int32), none, [np.array([x], "<u8").tobytes() for x in total.values()], pa.array(none, pa.list_(pa.string()))])

    return C.map_arrow(texts, run, ROW)


def _entries(table: pa.Table, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language codes, numbers of words and hashes of words (``wide`` columns, 0 beyond a phrase's words) of the candidates of rows (lang, words, keys)."""
    lang, words, keys = [], [], []
    for name, k, key in zip(table.column("lang").to_pylist(), table.column("words").to_pylist(), table.column("keys"), strict=True):
        own = np.frombuffer(key.as_buffer(), np.uint64).reshape(-1, k)
        keys.append(np.pad(own, ((0, 0), (0, wide - k))))
        lang.append(np.full(len(own), _code(name), np.uint64))
        words.append(np.full(len(own), k, np.uint8))
    return tuple(np.concatenate(x) for x in (lang, words, keys))


def _hashes(lang: np.ndarray, words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Two hashes of each candidate."""
    out = np.zeros((len(lang), 2), np.uint64)
    for k in np.unique(words).tolist():
        at = words == k
        for j in (0, 1):
            out[at, j] = phrase_hash(lang[at], list(keys[at, :k].T), 20 * j)
    return out


# ---------------------------------------------------------------- steps 3 and 4: minimal perfect hashes and counts by slot


class PerfectHash:
    """Slots 0 .. n - 1 of n different keys (two 64-bit hashes each); keys that were not given get any slot or -1, so a use compares stored keys."""

    LEVELS = 32

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.rank = [C.from_offsets(np.bitwise_count(x).astype(np.int64)) for x in levels]
        self.before = C.from_offsets(np.array([r[-1] for r in self.rank], np.int64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (C.mix(keys[:, 0] + C.U64(level) * (keys[:, 1] | C.U64(1))) % C.U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            if len(levels) == cls.LEVELS:
                raise ValueError("two keys share 128 bits")
            size = -(-2 * len(keys) // 64) * 64
            place = cls._place(keys, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            place = self._place(keys[open_], k, 64 * len(bits))
            block, bit = bits[place >> 6], (place & 63).astype(np.uint64)
            hit = (block >> bit) & C.U64(1) == 1
            under = np.bitwise_count(block & ((C.U64(1) << bit) - C.U64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[k] + self.rank[k][place >> 6] + under)[hit]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return b"".join(np.uint64(len(x)).tobytes() + x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        words, levels, at = np.frombuffer(data, np.uint64), [], 0
        while at < len(words):
            n = int(words[at])
            levels.append(words[at + 1 : at + 1 + n])
            at += 1 + n
        return cls(levels)


INDEX = "seg int, mph binary, names array<string>, lang binary, words binary, keys binary, counts binary, texts array<string>"


def tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    """The sum of arrays, ``FAN`` at a time."""
    while len(arrays) > 1:
        arrays = [np.sum(arrays[i : i + FAN], axis=0) for i in range(0, len(arrays), FAN)]
    return arrays[0]


def counted(found: DataFrame, wide: int) -> DataFrame:
    """For each segment of ``occurrences``: its minimal perfect hash and, by slot, the candidates' languages (codes; names: those of all of them), numbers of words, hashes of words and counts; the texts of its single words, by slot.

    A segment's rows come from all tasks that met its candidates, and are counted in chunks of ``ENTRIES``. The table is stored.
    """
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 4, pa.list_(pa.string())]
    schema = pa.schema([(x.split()[0], t) for x, t in zip(INDEX.split(", "), kinds, strict=True)])

    def run(table):
        seg = table.column("seg")[0].as_py()
        if seg == TOTALS:
            total: dict[str, int] = {}
            for name, n in zip(table.column("lang").to_pylist(), table.column("n").to_pylist(), strict=True):
                total[name] = total.get(name, 0) + int.from_bytes(n, "little")
            return pa.Table.from_arrays([pa.array([x], t) for x, t in zip([seg, b"", [*total], b"", b"", b"", np.array([*total.values()], np.int64).tobytes(), []], kinds, strict=True)], schema=schema)
        lang, words, keys = _entries(table, wide)
        n = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("n")]).astype(np.int64)
        h = _hashes(lang, words, keys)
        order = np.lexsort((h[:, 1], h[:, 0]))
        keep = order[np.append(True, (h[order][1:] != h[order][:-1]).any(1))]
        mph = PerfectHash.build(h[keep])
        keep = keep[np.argsort(mph.slots(h[keep]))]
        own = lang[keep], words[keep], keys[keep]
        parts = []
        for i in range(0, len(h), ENTRIES):
            j = slice(i, i + ENTRIES)
            slot, same = _verified(mph, h[j], (lang[j], words[j], keys[j]), own)
            if not same.all():
                raise ValueError("two candidates share 128 bits")
            parts.append(np.bincount(slot, n[j], len(keep)).astype(np.int64))  # exact: a chunk's counts are far below 2**53
        text = dict(zip(keys[words == 1, 0].tolist(), (x for row in table.column("texts").to_pylist() if row is not None for x in row), strict=True))
        values = [seg, mph.dump(), sorted(set(table.column("lang").to_pylist())), *(x.tobytes() for x in own), tree_sum(parts).tobytes(), [text[w] for w in own[2][own[1] == 1, 0].tolist()]]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], schema=schema)

    C.ship(found.sparkSession)
    return C.materialize(found.groupBy("seg").applyInArrow(run, INDEX))


def _verified(mph: PerfectHash, h: np.ndarray, given: tuple, stored: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Slots of candidates (language, number and hashes of words; ``h``), and whether the stored key is theirs."""
    slot = mph.slots(h)
    at = np.maximum(slot, 0)
    return at, (slot >= 0) & (stored[0][at] == given[0]) & (stored[1][at] == given[1]) & (stored[2][at] == given[2]).all(1)


def _stored(segment: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lang, words, keys = (np.frombuffer(segment.column(c)[0].as_buffer(), t) for c, t in (("lang", np.uint64), ("words", np.uint8), ("keys", np.uint64)))
    return lang, words, keys.reshape(len(lang), -1)


def at_segments(rows: DataFrame, segments: DataFrame, parts: int, run, schema: pa.Schema, names: str) -> DataFrame:
    """run(rows of a part of a segment, the segment) for ``rows`` (seg, deal) dealt out to ``parts`` tasks for each segment."""
    dealt = rows.withColumn("part", F.pmod("deal", F.lit(parts)).cast("int")).drop("deal")
    copies = segments.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    C.ship(rows.sparkSession)

    def both(left, right):
        return run(left, right) if left.num_rows and right.num_rows else schema.empty_table()

    return dealt.groupBy("seg", "part").cogroup(copies.groupBy("seg", "part")).applyInArrow(both, names)


def phrases_of(segments: DataFrame, least: int) -> DataFrame:
    """lang, w (the hashes of the words) and a (occurrences) of the phrases of several words that occur ``least`` times."""
    schema = pa.schema([("lang", pa.string()), ("w", pa.list_(pa.int64())), ("a", pa.int64())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = pa.Table.from_batches([b.slice(i, 1)])
                lang, words, keys = _stored(row)
                n = np.frombuffer(row.column("counts")[0].as_buffer(), np.int64)
                names = {_code(x): x for x in row.column("names")[0].as_py()}
                for k in range(2, keys.shape[1] + 1):
                    at = np.flatnonzero((words == k) & (n >= least))
                    for j in range(0, len(at), 20_000):
                        own = at[j : j + 20_000]
                        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(own) + 1) * k).astype(np.int32)), pa.array(keys[own, :k].ravel().view(np.int64)))
                        yield C.batches(schema, [[names[x] for x in lang[own].tolist()], lists, n[own]])

    return C.map_arrow(segments.select("names", "lang", "words", "keys", "counts"), run, "lang string, w array<long>, a long")


# ---------------------------------------------------------------- step 5: cuts


def cut_counts(phrases: DataFrame, segments: DataFrame, how_many: int, wide: int) -> DataFrame:
    """id, k, l and r of every cut of ``phrases`` (id, lang, w; a stored table), read by slot. A request is tagged with the phrase's id, the cut and the side."""
    schema = pa.schema([("seg", pa.int32()), ("deal", pa.int64()), ("lang", pa.string()), ("words", pa.int32()), ("keys", pa.binary()), ("tags", pa.binary())])
    answer = pa.schema([("id", pa.int64()), ("k", pa.int32()), ("side", pa.int32()), ("n", pa.int64())])

    def ask(batches):
        for b in batches:
            sizes = pc.list_value_length(b.column(2)).to_numpy()
            langs = np.array(b.column(1).to_pylist(), object)
            ids, flat, at = b.column(0).to_numpy(), b.column(2).flatten().to_numpy().view(np.uint64), C.from_offsets(sizes)
            for name in sorted(set(langs)):
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero((langs == name) & (sizes == size))
                    if not len(rows):
                        continue
                    keys = flat[at[rows][:, None] + np.arange(size)]
                    for k in range(1, size):
                        for side, part in enumerate((keys[:, :k], keys[:, k:])):
                            seg = _segments_of(phrase_hash(np.full(len(part), _code(name), np.uint64), list(part.T)), how_many)
                            tags = ids[rows] * 64 + k * 2 + side
                            order = np.argsort(seg, kind="stable")
                            cut = np.searchsorted(seg[order], np.arange(how_many + 1))
                            for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                                own = order[cut[s] : cut[s + 1]]
                                yield C.batches(schema, [[s], [int(ids[0]) >> 3], [name], [part.shape[1]], [np.ascontiguousarray(part[own]).tobytes()], [tags[own].tobytes()]])

    def run(rows, segment):
        lang, words, keys = _entries(rows, wide)
        tags = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("tags")])
        slot, same = _verified(PerfectHash.load(segment.column("mph")[0].as_py()), _hashes(lang, words, keys), (lang, words, keys), _stored(segment))
        n = np.frombuffer(segment.column("counts")[0].as_buffer(), np.int64)[slot]
        return pa.Table.from_arrays([pa.array(tags >> 6), pa.array((tags >> 1 & 31).astype(np.int32)), pa.array((tags & 1).astype(np.int32)), pa.array(np.where(same, n, 0))], schema=answer)

    asked = C.map_arrow(phrases.select("id", "lang", "w"), ask, "seg int, deal long, lang string, words int, keys binary, tags binary")
    parts = max(1, -(-phrases.count() * 2 * (wide - 1) // (how_many * ENTRIES)))
    read = at_segments(asked, segments, parts, run, answer, "id long, k int, side int, n long")
    return read.groupBy("id", "k").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))


def _displaced(phrases: DataFrame, within: int) -> DataFrame:
    """lang and w of those that a longer one of ``phrases`` (lang, w, a) holds with at least ``within`` % of their occurrences."""
    inner = phrases.where(F.size("w") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("begin", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    held = inner.select("lang", F.slice("w", F.col("begin"), F.col("size")).alias("w"), "a").groupBy("lang", "w").agg(F.max("a").alias("longer"))
    return phrases.join(held, ["lang", "w"]).where(F.col("longer") * 100 >= F.col("a") * within).select("lang", "w")


def _texts(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``rows`` (id, w) with the phrase."""
    words = C.materialize(rows.select("id", F.posexplode("w").alias("at", "h")))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, size, keys = _stored(pa.Table.from_batches([b.slice(i, 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[size == 1, 0].view(np.int64)), b.column(3)[i].values], ["h", "text"])

    given = C.map_arrow(segments.where(F.col("seg") != TOTALS).select("lang", "words", "keys", "texts"), run, "h long, text string")
    known = given.join(C.checked_broadcast(words.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    phrase = words.join(known, "h").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("phrase"))
    return rows.join(phrase, "id")


def _totals(segments: DataFrame) -> DataFrame:
    """lang and n of the words of each language."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(np.frombuffer(b.column(1)[i].as_buffer(), np.int64))], ["lang", "n"])

    return C.materialize(C.map_arrow(segments.where(F.col("seg") == TOTALS).select("names", "counts"), run, "lang string, n long"))


def mine(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, within: int = WITHIN, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to ``words`` words."""
    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    how_many = max(1, -(-C.text_bytes(texts) // SEGMENT_BYTES))
    segments = counted(occurrences(texts, least, words, how_many), words)
    own = segments.where(F.col("seg") != TOTALS)
    phrases = C.materialize(phrases_of(own, least).withColumn("id", F.monotonically_increasing_id()))
    cuts = C.materialize(cut_counts(phrases, own.drop("texts"), how_many, words))
    scored = cuts.join(phrases, "id").withColumn("score", F.expr(SCORE))
    best = scored.groupBy("id", "lang", "w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("id", "lang", "w", "a", "x.score", "x.l", "x.r")
    kept = C.materialize(best.join(_displaced(phrases, within), ["lang", "w"], "left_anti"))
    C.drop(cuts, phrases)
    order = [F.desc("score"), F.desc("a")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    tied = C.materialize(salted.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank"))
    ranked = _texts(tied, segments).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(C.checked_broadcast(_totals(segments)), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
