"""Packing of tokenized documents into fixed windows.

Bounded-space online packing: every task keeps ``open_windows`` windows; an item goes to the window that it fits best; when
none has room, the fullest window is emitted and a new one is opened. A fullest window with more than ``max_gap`` free places is first topped up
with the head of the item, so padding stays small. At its end a task lays what its leftover windows hold into full windows, and the last,
partly filled windows of many tasks are merged in a second step, grouped so that no group grows with the input.

Defined results: a null text is empty and has just the end token; repeated rows, equal ids and null ids are packed like any others;
an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_STAGED = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tail")] + [("ids", pa.binary())])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts from a cache of their white-space separated words.

    The tokenizer's own rules never join characters across ASCII white space, so a text's ids are those of its words in order.
    The cache is bounded by ``keep`` words.
    """

    def __init__(self, path: str, keep: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and their lengths.

        The tokenizer's model encodes a word of Latin letters in its byte alphabet as it is; any other word takes the whole tokenizer.
        """
        model, out = self.tokenizer.model, [None] * len(words)
        other = []
        for i, w in enumerate(words):
            w = w.lower()
            if _LATIN(w):
                out[i] = [t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_ALPHABET))]
            else:
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return np.array([x for ids in out for x in ids], np.uint16), np.array([len(x) for x in out], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, each text with the end id, and the texts' offsets among them."""
        s, e, rows = C.words(data, offsets)
        if cuts := _cuts(data):
            inner = cuts[0]
            s, e = np.sort(np.concatenate([s, inner])), np.sort(np.concatenate([e, inner]))
            keep = s < e
            s, e = s[keep], e[keep]
            rows = np.searchsorted(s, offsets)
        keys, first, inverse = np.unique(C.word_hashes(data, s, e), return_index=True, return_inverse=True)
        if len(self.keys) > self.keep:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] == keys[place < len(self.keys)]
        if not known.all():
            raw, new = data.tobytes(), np.flatnonzero(~known)
            words = [raw[a:b].decode() for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)]
            ids, lengths = self._encode(words)
            slots = len(self.at) - 1 + np.arange(len(new))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, ids])
            self.keys, self.slots = np.insert(self.keys, place[new], keys[new]), np.insert(self.slots, place[new], slots)
            place = np.searchsorted(self.keys, keys)
        slot = self.slots[place][inverse] if len(keys) else np.zeros(0, np.int64)
        lengths = self.at[slot + 1] - self.at[slot]
        # a word's place among the output ids: the ids before it and one end id for each earlier text
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        begin = C.from_offsets(lengths)
        ends = begin[rows[1:]] + np.arange(len(rows) - 1)
        out = np.full(int(begin[-1]) + len(rows) - 1, END_ID, np.uint32)
        source = np.repeat(self.at[slot] - begin[:-1], lengths) + np.arange(int(begin[-1]))
        target = np.arange(int(begin[-1])) + np.repeat(row, lengths)
        out[target] = self.ids[source]
        return out, np.concatenate([[0], ends + 1])


_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "'<|>"]] = True


def _cuts(data: np.ndarray) -> list[np.ndarray]:
    """Places between a Latin letter and an ASCII mark (but for those of contractions and special tokens), where the tokenizer always parts words."""
    if len(data) < 2:
        return []
    letter = _LETTER[data]
    # U+00C0 to U+017F without signs, and without U+0130, whose lower case ends in a combining mark
    lead = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC5) & (data[1:] != 0x97) & (data[1:] != 0xB7) & ((data[:-1] != 0xC4) | (data[1:] != 0xB0))
    first, last = letter.copy(), letter
    first[:-1] |= lead
    last[1:] |= lead
    mark = _MARK[data]
    return [np.flatnonzero((last[:-1] & mark[1:]) | (mark[:-1] & first[1:])) + 1]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Open windows of one task. ``emit`` gets (pieces, tokens) of each closed window; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, open_windows: int, max_gap: int):
        self.size, self.most, self.max_gap = size, open_windows, max_gap
        self.rooms: list[tuple[int, int]] = []  # (free places, window), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def _put(self, window: int, room: int, piece: tuple) -> list | None:
        self.held.setdefault(window, []).append(piece)
        room -= len(piece[2])
        if room:
            bisect.insort(self.rooms, (room, window))
            return None
        return self.held.pop(window)

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list]:
        total, start = len(ids), 0
        while total - start >= self.size:  # whole windows of a long document
            yield [(doc, start, ids[start : start + self.size], total)]
            start += self.size
        while start < total:
            need = total - start
            k = bisect.bisect_left(self.rooms, (need, -1))
            if k < len(self.rooms):
                room, window = self.rooms.pop(k)
            elif len(self.rooms) < self.most:
                room, window = self.size, self.next
                self.next += 1
            else:
                room, window = self.rooms.pop(0)  # the fullest
                if room <= self.max_gap:
                    yield self.held.pop(window)
                    continue
                need = room
            if full := self._put(window, room, (doc, start, ids[start : start + need], total)):
                yield full
            start += need

    def rest(self) -> Iterator[list]:
        """Lays the pieces of the leftover windows end to end; all but the last window are full."""
        out, room = [], self.size
        for window in sorted(self.held):
            for doc, start, ids, total in self.held[window]:
                while len(ids):
                    out.append((doc, start, ids[:room], total))
                    start, ids, room = start + len(out[-1][2]), ids[room:], room - len(out[-1][2])
                    if not room:
                        yield out
                        out, room = [], self.size
        self.held, self.rooms = {}, []
        if out:
            yield out


def _rows(windows: Iterator[list], ids_of: Iterator[int]) -> Iterator[tuple]:
    for window, sequence in zip(windows, ids_of, strict=False):
        offset = 0
        for doc, start, ids, total in window:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset
            offset += len(ids)


def pack_documents(docs: DataFrame, path: str, size: int = 2048, open_windows: int = 64, max_gap: int = 8, tails_together: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in windows of at most ``size`` tokens (schema ``PIECE``)."""
    import itertools

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, sequence = Packer(size, open_windows, max_gap), itertools.count(part << 32)
        enc = encoder(path)

        def batch(rows: list[tuple], tail: int = -1, ids: list | None = None) -> pa.RecordBatch:
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 7
            return C.batches(_STAGED, [*columns, np.full(len(rows), tail), pa.array(ids or [None] * len(rows), pa.binary())])

        for b in batches:
            names = b.column(0).to_pylist()
            for i, j, data, offsets in C.slices(b.column(1)):
                ids, at = enc.encode(data, offsets)
                made = (w for k in range(i, j) for w in packer.add(names[k], ids[at[k - i] : at[k - i + 1]].copy()))
                yield batch(list(_rows(made, sequence)))
        last = list(packer.rest())
        yield batch(list(_rows((w for w in last if sum(len(p[2]) for p in w) == size), sequence)))
        for w in last:
            if sum(len(p[2]) for p in w) < size:
                yield batch(list(_rows([w], sequence)), part // tails_together, [p[2].tobytes() for p in w])

    def merge(key, table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer, sequence = Packer(size, 1, 0), itertools.count((1 << 62) + (key[0].as_py() << 20))
        d = table.to_pydict()
        packer.held = {0: [(a, s, np.frombuffer(x, np.uint32), n) for a, s, x, n in zip(d["doc_id"], d["start"], d["ids"], d["doc_tokens"], strict=True)]}
        rows = list(_rows(packer.rest(), sequence))
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(_STAGED.names[:7], zip(*rows, strict=True), strict=True)})

    staged = C.materialize(C.map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), first, PIECE + ", tail long, ids binary"))
    whole = staged.where("tail < 0").select(*_STAGED.names[:7])
    return whole.unionByName(staged.where("tail >= 0").groupBy("tail").applyInArrow(merge, PIECE))
