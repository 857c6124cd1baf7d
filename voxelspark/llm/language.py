"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, runs of anything else count as one blank, and n-grams of one to three characters are hashed into ``DIMENSIONS`` features. Document frequencies
are counted over all learnable documents. The weights are learned by follow-the-regularised-leader with elastic-net penalties on a bounded sample: about ``TRAIN_ROWS`` rows
by the hashes of their ids, and of every language about ``LANGUAGE_ROWS`` at least (or all, if it has fewer), with all features of each.
The sample and the weights are held by the driver and grow with the number of languages, which is taken as a few hundred at most.
A fifth of that sample is kept aside and sets the temperature of the scores, over pieces of its texts of a few letters up to the whole: short pieces are hard enough to be mistaken.

Defined results: a null text or one without letters is ``und`` with score 0; rows without a language teach nothing; without any learnable row, all are
``und``; repeated rows and extra columns change nothing but document frequencies; a null id is held out and its row is predicted; an empty table gives no rows. Long texts are
read in pieces that add up to the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DIMENSIONS = 1 << 18
TRAIN_ROWS, LANGUAGE_ROWS = 3000, 100
#: Letters of the pieces on which the temperature is fitted; 0: whole texts.
PIECES = (4, 8, 16, 32, 0)
_SLICE = 256 << 10


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _symbols(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, and one 0 for each run of other characters that follows a letter or begins at one of ``starts``, with the places of their characters, and whether each character is a letter."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    keep = letter > 0
    keep[starts[starts < len(keep)]] = True
    keep[1:] |= letter[:-1] > 0  # the first of a run of other characters stands for all
    return letter[keep], np.flatnonzero(keep), letter > 0


def _grams(x: np.ndarray, row: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and rows of the n-grams of symbols, but for those that end within the first ``skip``."""
    grams, at = [], []
    h = np.zeros(len(x), np.uint32)
    for n in range(3):
        m = max(0, len(x) - n)
        h = (h[:m] * np.uint32(0x01000193)) ^ (x[n:] * np.uint32(0x9E3779B1))
        same = row[:m] == row[n:]
        same[: max(0, skip - n)] = False
        g = h ^ np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)
        g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        g ^= g >> np.uint32(13)
        grams.append((g & np.uint32(DIMENSIONS - 1))[same])
        at.append(row[:m][same])
    return np.concatenate(grams), np.concatenate(at)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and row numbers of all n-grams of a slice of texts, and whether each row has a letter."""
    rows = len(offsets) - 1
    begin = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=begin[1:])
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(begin[offsets]))
    x, at, letter = _symbols(data, begin[offsets[:-1]])
    has = np.zeros(rows, bool)
    has[row[letter]] = True
    return *_grams(x, row[at]), has


@dataclass(frozen=True)
class Counts:
    """Sparse counts of successive rows: entries (row, feature, n), sorted by row and feature."""

    first: int
    rows: int
    row: np.ndarray
    feature: np.ndarray
    n: np.ndarray
    has: np.ndarray  # whether a row has a letter

    def each(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.searchsorted(self.row, np.arange(self.rows + 1))
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield self.feature[i:j], self.n[i:j]


def _long_row(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Features, their counts and whether there is a letter, of one long text read in pieces. The last two symbols of what came before are carried over a cut, so the pieces add up to the whole."""
    total, has, at = np.zeros(DIMENSIONS, np.int64), False, 0
    carried, after_letter = np.zeros(0, np.uint32), True
    while at < len(data):
        end = at + _SLICE
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        new, _, letter = _symbols(data[at:end], np.zeros(int(after_letter), np.int64))
        x = np.concatenate([carried, new])
        total += np.bincount(_grams(x, np.zeros(len(x), np.int32), len(carried))[0], minlength=DIMENSIONS)
        has |= bool(letter.any())
        carried, after_letter, at = x[-2:], bool(letter[-1]), end
    feature = np.flatnonzero(total)
    return feature, total[feature], has


def counts(column: pa.Array) -> Iterator[Counts]:
    """Counts of successive row ranges; a long text makes a range of its own."""
    for i, j, data, offsets in C.slices(column, _SLICE):
        if j - i == 1 and len(data) > 2 * _SLICE:
            feature, n, has = _long_row(data)
            yield Counts(i, 1, np.zeros(len(feature), np.int64), feature, n, np.array([has]))
            continue
        grams, row, has = ngrams(data, offsets)
        key, n = np.unique(row.astype(np.int64) * DIMENSIONS + grams, return_counts=True)
        yield Counts(i, j - i, key // DIMENSIONS, key % DIMENSIONS, n, has)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # (DIMENSIONS, languages)
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # whether a feature is in some learnable document

    def logits(self, c: Counts) -> np.ndarray:
        """(rows, languages), from the weights of the features that a row has."""
        v = c.n * self.idf[c.feature]
        norm = np.sqrt(np.bincount(c.row, v * v, c.rows))
        z = np.stack([np.bincount(c.row, v * self.weights[c.feature, k], c.rows) for k in range(len(self.languages))], 1)
        return z / np.maximum(norm, 1e-9)[:, None] + self.bias

    def scores(self, c: Counts) -> np.ndarray:
        z = self.logits(c) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def known(self, c: Counts) -> np.ndarray:
        """The share of each row's n-grams that some learnable document has."""
        return np.bincount(c.row, c.n * self.seen[c.feature], c.rows) / np.maximum(np.bincount(c.row, c.n, c.rows), 1)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal; a row is (feature numbers, values)."""
    z, n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, v = np.append(rows[k][0], DIMENSIONS), np.append(rows[k][1], 0.3)
            w = weights(i)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = v[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(DIMENSIONS + 1))
    return w[:-1], w[-1] * 0.3


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss among powers of two between 2**-8 and 2**8, in steps of a sixteenth."""
    best = (np.inf, 1.0)
    for t in np.exp2(np.linspace(-8, 8, 257)):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        loss = (np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean()
        best = min(best, (float(loss), float(t)))
    return best[1]


def _pieces(text: str) -> list[str]:
    """Pieces of a text from places that its own bytes draw, one for each of ``PIECES``."""
    draw = np.random.default_rng(len(text))
    return [text[(at := int(draw.integers(0, max(1, len(text) - n)))) : at + n] if n else text for n in PIECES]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """``docs``: doc_id, text, lang of learnable rows."""
    learnable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches):
        df = np.zeros(DIMENSIONS + 1, np.int64)
        for b in batches:
            for c in counts(b.column(0)):
                np.add.at(df, c.feature, 1)
                df[-1] += c.rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "df"])

    found = C.map_arrow(learnable.select("text"), frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(DIMENSIONS + 1)
    df[found["feature"].to_numpy(int)] = found["df"]
    if not df[-1]:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def sparse(batches):
        """The features of a sampled row and of its pieces, and the piece's number."""
        for b in batches:
            for lang, text, aside in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows = []
                for k, piece in enumerate(_pieces(text) if aside else [text]):
                    for c in counts(pa.array([piece])):
                        feature, n = next(c.each())
                        if c.has[0]:
                            rows.append((lang, k, aside, feature.astype("<u4").tobytes(), n.astype("<u4").tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["lang", "piece", "aside", "at", "n"])

    # a row is taken by the hash of its id; every language has a rate of its own, so none is missing
    sizes = learnable.groupBy("lang").agg(F.count("*").alias("rows"))
    total = float(df[-1])
    rate = F.greatest(F.lit(train_rows / total), F.lit(float(LANGUAGE_ROWS)) / F.col("rows"))
    share = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = learnable.join(C.checked_broadcast(sizes.select("lang", rate.alias("rate"))), "lang").where(share(F.lit("train"), F.col("doc_id")) < F.col("rate"))
    sample = C.map_arrow(chosen.select("lang", "text", (share(F.lit("aside"), F.col("doc_id")) < 0.2).alias("aside")), sparse, "lang string, piece int, aside boolean, at binary, n binary").toPandas()
    sample = sample.sort_values(["lang", "piece", "at", "n"], kind="stable").reset_index(drop=True)  # the same order whatever the partitions
    if not len(sample):
        return None
    languages = tuple(sorted(sample["lang"].unique()))
    y = np.array([languages.index(x) for x in sample["lang"]])
    rows = []
    for at, n in zip(sample["at"], sample["n"], strict=True):
        i = np.frombuffer(at, "<u4").astype(np.int64)
        v = np.frombuffer(n, "<u4") * idf[i]
        rows.append((i, v / max(1e-9, float(np.sqrt((v * v).sum())))))
    aside = sample["aside"].to_numpy(bool)
    fitted = [k for k in range(len(rows)) if not aside[k]]
    if len({int(y[k]) for k in fitted}) < len(languages):  # too few rows to keep some aside
        fitted = [k for k in range(len(rows)) if not aside[k] or sample["piece"][k] == len(PIECES) - 1]
    weights, bias = ftrl([rows[k] for k in fitted], y[fitted], len(languages))
    tested = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
    logits = np.array([rows[k][1] @ weights[rows[k][0]] + bias for k in tested])
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), fit_temperature(logits, y[tested]), df[:-1] > 0)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for c in counts(b.column(1)):
                if model is None:
                    lang, score = ["und"] * c.rows, np.zeros(c.rows)
                else:
                    p = model.scores(c)
                    lang = [model.languages[k] if h else "und" for k, h in zip(p.argmax(1), c.has, strict=True)]
                    score = np.where(c.has, np.clip(p.max(1), 0, 1), 0.0)
                yield C.batches(schema, [b.column(0).slice(c.first, c.rows), lang, score])

    return C.map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learns from the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), train_rows)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None, least: float, least_known: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with a score of ``least`` or more.

    A row is also rejected if less than ``least_known`` of its n-grams are in any learnable document, as in a script that was not learned; this does not depend on how many languages were.
    Null texts, texts without letters and, without a model, all rows are rejected.
    """

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            keep = np.zeros(b.num_rows, bool)
            if model is not None:
                for c in counts(b.column(at)):
                    keep[c.first : c.first + c.rows] = c.has & (model.scores(c).max(1) >= least) & (model.known(c) >= least_known)
            yield b.filter(pa.array(keep))

    return C.map_arrow(docs, run, docs.schema)
