"""Language identification: letters, long texts, the learner against a plain one, calibration and rejection."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelspark.llm import common, language


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs.where(~language.held_out(F.col("doc_id"))))


def test_letters_of_the_whole_code_space(docs, model):
    rare = [chr(0x30000), chr(0x323AF), "ß", "İ", "Ω"]
    assert all(language._letters()[ord(c)] for c in rare) and not language._letters()[ord("1")]
    got = language.predict(docs.sparkSession.createDataFrame([(i, c) for i, c in enumerate([*rare, "12 !", "", None])], "doc_id long, text string"), model).collect()
    assert [r.lang_pred != "und" for r in sorted(got)] == [True] * 5 + [False] * 3
    assert all(0 <= r.score <= 1 for r in got)


def test_long_texts_are_counted_whole():
    r = random.Random(2)
    text = "".join(r.choice("abc dé ñ\U00030000 1,") for _ in range(900_000))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = np.bincount(language.ngrams(data, np.array([0, len(data)]))[0], minlength=language.DIMENSIONS)
    (c,) = language.counts(pa.array([text]))
    assert c.has[0] and np.array_equal(np.bincount(c.feature, c.n, language.DIMENSIONS), whole)


def test_ftrl_equals_a_plain_one():
    """Coordinate by coordinate, in Python's own floats."""
    r = np.random.default_rng(4)
    rows, y = [], []
    for k in range(40):
        i = np.sort(r.choice(12, 4, replace=False))
        rows.append((i, r.random(4)))
        y.append(k % 3)
    w, b = language.ftrl(rows, np.array(y), 3, epochs=2)
    alpha, beta, l1, l2, bias = 1.0, 1.0, 0.02, 0.02, language.DIMENSIONS
    z, n = {}, {}

    def weight(i, c):
        zi, ni = z.get((i, c), 0.0), n.get((i, c), 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    order = np.random.default_rng(1)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            x = [*zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True), (bias, 0.3)]
            old = {(i, c): weight(i, c) for i, _ in x for c in range(3)}
            s = [sum(old[i, c] * v for i, v in x) for c in range(3)]
            total = sum(math.exp(a) for a in s)
            for i, v in x:
                for c in range(3):
                    g = v * (math.exp(s[c]) / total - (y[k] == c))
                    before = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * old[i, c]
                    n[i, c] = before + g * g
    assert np.allclose(w[:12], [[weight(i, c) for c in range(3)] for i in range(12)]) and np.allclose(b, [0.3 * weight(bias, c) for c in range(3)])
    assert not w[12:].any()  # the l1 penalty leaves what was never seen at 0


def test_held_out_accuracy_and_calibration(docs, model):
    assert 2**-8 < model.temperature < 2**8
    rows = docs.where(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    got = language.predict(rows, model).join(rows, "doc_id").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    # over short pieces, which are often mistaken, the mean score is about the share that is right
    short = rows.withColumn("text", F.substring("text", 30, 9)).where(F.col("text").rlike("[a-z]{3}"))
    got = language.predict(short, model).join(rows.select("doc_id", "lang"), "doc_id").collect()
    right, score = np.mean([r.lang == r.lang_pred for r in got]), np.mean([r.score for r in got])
    assert abs(right - score) < 0.12


def test_rejection(docs, model):
    rows = docs.limit(50).unionByName(docs.sparkSession.createDataFrame([(-1, "Съешь же ещё этих мягких французских булок", None), (-2, "人人生而自由在尊严和权利上一律平等", None), (-3, None, None), (None, "12", "en")], docs.schema))
    kept = {r.doc_id for r in language.keep_identified(rows, model, 0.35, 0.5).collect()}
    assert not kept & {-1, -2, -3, None} and len(kept) == 50


def test_odd_tables(spark):
    many = spark.createDataFrame([(i, "der die das und nicht" if i % 3 else "the of and that is", "de" if i % 3 else "en", 1.0, 2) for i in range(60)] + [(60, "que el la los una", "es", 1.0, 2), (60, "que el la los una", "es", 1.0, 2), (None, "und die das", "de", 1.0, 2)], "doc_id long, text string, lang string, score double, rate int")
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in language.identify(many).collect()}
    assert (None, "de", True) in got and all(p == ("de" if i % 3 else "en") for i, p, _ in got if i is not None and i < 60)
    assert language.identify(many.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred = 'und' AND score = 0").count() == many.count()
    assert language.identify(many.limit(0)).count() == 0


def test_long_texts_add_up(monkeypatch):
    """Cuts within runs of blanks of any length, between and inside characters of several bytes."""
    r = random.Random(4)
    for size in (7, 16, 64):
        monkeypatch.setattr(language, "_SLICE", size)
        for _ in range(60):
            text = "".join(r.choice(["a", "é", "日", "B", " ", " " * r.randrange(1, 3 * size), "1", "\n"]) for _ in range(r.randrange(1, 80)))
            data = np.frombuffer(text.encode(), np.uint8)
            grams, _, has = language.ngrams(data, np.array([0, len(data)]))
            feature, n, some = language._long_row(data)
            want, many = np.unique(grams, return_counts=True)
            assert (feature == want).all() and (n == many).all() and some == has[0]


def test_texts_do_not_depend_on_their_neighbours():
    texts = ["a b", " a", "", "1 c", "d ", "  e"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    grams, row, _ = language.ngrams(np.frombuffer(data, np.uint8), offsets)
    for i, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        assert sorted(grams[row == i]) == sorted(language.ngrams(own, np.array([0, len(own)]))[0])
