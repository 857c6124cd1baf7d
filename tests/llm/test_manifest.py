"""Merkle manifests, Hilbert shards and collocations against plain versions, and odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelspark.llm import collocation, hilbert, merkle, ordering

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, at string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


# ---------------------------------------------------------------- op11


def climb(nodes, at, arity=2):
    """(root, path of place ``at``) of a plain tree."""
    path = []
    while len(nodes) > 1:
        run = at // arity
        own = nodes[run * arity : (run + 1) * arity]
        path.append((own[: at % arity], own[at % arity + 1 :]))
        nodes = [H(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = run
    return nodes[0], path


def plain_audit(rows, arity=2):
    leaves = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        parts = [field(doc_id), field(source), field(lang), field(n_chars), field(text)]
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        other = H(*parts[:3], field(n_chars + 1), parts[4]) if tampered else H(*parts)
        leaves[lang].append((doc_id is not None, doc_id or 0, H(*parts), other, doc_id))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        leaves[lang].sort()
    subroots = [climb([x[2] for x in leaves[lang]], 0, arity)[0] for lang in langs]
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, leaf, other, doc_id) in enumerate(leaves[lang]):
            subroot, path = climb([x[2] for x in leaves[lang]], i, arity)
            root, more = climb(subroots, k, arity)
            path = path + more
            h = other
            for left, right in path:
                h = H(*left, h, *right)
            out.append((doc_id, leaf, subroot, root, H(*[x for left, right in path for x in (*left, *right)]), h, h == root))
    return out


def documents(n, seed=1):
    r = random.Random(seed)
    langs = ["en"] * 6 + ["de", "fr", None, "", "é", "only"]
    rows = [(i, r.choice([None, "", "text é " + str(r.random()), "copy"]), r.choice(langs[:-1]), r.choice([None, "src0", "src1"]), r.choice([None, 3, 2**63 - 1])) for i in range(n)]
    return [*rows, (n, "alone", "only", "s", 1), (3, "again", "en", "s", 1), (None, "no id", "en", "s", 1), (None, None, None, None, None), *rows[5:6] * 2]


def made(spark, rows):
    return spark.createDataFrame([(*x, 7, "odd") for x in rows], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("n", [1, 300])
def test_audit(spark, n):
    rows = documents(n) if n > 1 else [(5, "a", "en", None, 2)]
    got = sorted(map(tuple, merkle.audit(made(spark, rows)).collect()), key=key)
    assert got == sorted(plain_audit(rows), key=key)
    assert n == 1 or {x[6] for x in got} == {True, False}


def test_audit_of_nothing(spark):
    assert merkle.audit(made(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("arity,size,fan", [(2, 7, 3), (3, 5, 2), (2, 8, 2)])
def test_proofs_of_any_cut(spark, arity, size, fan):
    """Ranges that are no whole subtrees leave many nodes for the merges; the rounds go several levels deep."""
    digests = [H(str(i)) for i in range(130)]
    rows = spark.createDataFrame([(i, "b" if i < 100 else "a", h) for i, h in enumerate(digests)], "i int, g string, h string")
    groups = {"b": digests[:100], "a": digests[100:]}
    subroots = {g: climb(x, 0, arity)[0] for g, x in groups.items()}
    root = H(subroots["a"], subroots["b"])
    for r in merkle.proofs(rows, "g", "i", "h", arity, size, fan).collect():
        _, path = climb(groups[r.g], r.i if r.g == "b" else r.i - 100, arity)
        path += climb([subroots["a"], subroots["b"]], "ab".index(r.g), arity)[1]
        assert (r.subroot, r.root) == (subroots[r.g], root)
        assert r.path == ";".join("".join(left) + "*" + "".join(right) for left, right in path)


@given(st.integers(1, 40), st.integers(2, 4), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_forests_merge_in_any_order(n, arity, r):
    digests = [H(str(i)) for i in range(n)]
    forests = [{(0, i): h} for i, h in enumerate(digests)] + [{}]
    r.shuffle(forests)
    while len(forests) > 1:
        a, b = forests.pop(), forests.pop()
        forests.insert(r.randrange(len(forests) + 1), merkle.settle(a | b, n, arity)[0])
    assert [*forests[0].values()] == [climb(digests, 0, arity)[0]]


def test_a_range_leaves_few_nodes():
    nodes, _ = merkle.settle({(0, i): "x" for i in range(1001, 5000)}, 10_000, 2)
    assert len(nodes) <= 2 * 13
    nodes, _ = merkle.settle({(0, i): "x" for i in range(4096, 8192)}, 10_000, 2)
    assert [*nodes] == [(12, 1)]


# ---------------------------------------------------------------- ordering


def test_places(spark):
    r = random.Random(2)
    rows = [(r.choice("abc"), r.choice([None, *range(20)]), i) for i in range(500)] + [("d", 1, 1)] * 100
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(5)
    got = ordering.numbered(df, ["g"], ["o", "i"]).collect()
    want = {}
    for g in "abcd":
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want[g] = own
        assert [tuple(x)[:3] for x in sorted((x for x in got if x.g == g), key=lambda x: x["at"])] == own
    assert all(x.n == len(want[x.g]) for x in got)
    weighed = ordering.numbered(spark.createDataFrame([(k, k + 1) for k in range(50)], "k int, w int"), [], ["k"], "w").collect()
    assert all(x["at"] == x.k * (x.k + 1) // 2 and x.n == 50 * 51 // 2 for x in weighed)


# ---------------------------------------------------------------- op12


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve(dims, bits):
    """Every cell has a place of its own, and successive places are neighbours."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = hilbert.curve_index(cells, bits)
    assert sorted(place) == [*range(len(cells))]
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_shards(spark):
    rows = documents(500, 3)
    got = hilbert.shard_digest(made(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((x.doc_id, x["size"], x.text_crc32) for x in got), key=key) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=key)
    by = collections.defaultdict(list)
    for x in got:
        by[x.shard].append(x)
    assert sorted(by) == [*range(24)] and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [x.curve for s in range(24) for x in sorted(by[s], key=lambda x: x.slot)]
    assert order == sorted(order) and all(sorted(x.slot for x in own) == [*range(len(own))] for own in by.values())
    assert {(x.law, x.grown_shard) for x in got} == {("rows", None)}


def test_cells_follow_counts(spark):
    rows = [(i, "t", "en", f"s{i % 4}" if i % 2 else "s0", i) for i in range(400)]
    got = hilbert.ordered(made(spark, rows).select("doc_id", "lang", "source", "n_chars"), bits=3).collect()
    assert {x.cell_lang for x in got} == {4}  # one value is in the middle
    by = collections.defaultdict(set)
    for x in got:
        by[x.source].add(x.cell_source)
    assert all(len(v) == 1 for v in by.values()) and max(by["s0"]) < min(by["s1"]) <= min(by["s3"])
    many = collections.Counter(x.cell_n_chars for x in got)
    assert len(many) == 8 and max(many.values()) < 110


def test_few_and_no_documents(spark):
    got = hilbert.shard_digest(made(spark, documents(1)[:2])).collect()
    assert sorted((x.slot, x["size"]) for x in got)[0][0] == 0 and len({x.shard for x in got}) == 2
    assert hilbert.shard_digest(made(spark, []).where("false")).collect() == []


def test_written_shards_and_pruning(spark, tmp_path):
    rows = documents(400, 4)
    docs = made(spark, rows)
    hilbert.write_shards(docs, f"{tmp_path}/out", shards=32)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((tuple(x) for x in back.select(*docs.columns).collect()), key=key) == sorted(((*x, 7, "odd") for x in rows), key=key)
    stats = hilbert.statistics(back)
    assert sum(x["rows"] for x in stats.collect()) == len(rows)
    for ranges in ({"lang": ("fr", "fr")}, {"lang": ("en", "en"), "source": ("src1", "src1")}):
        shards = {x.shard for x in hilbert.relevant(stats, ranges).collect()}
        held = back.where(" AND ".join(f"{c} BETWEEN '{a}' AND '{b}'" for c, (a, b) in ranges.items())).select("shard").distinct().collect()
        assert {x.shard for x in held} <= shards and len(shards) <= 20


# ---------------------------------------------------------------- op13


def plain_phrases(rows, words=3, least=10, top=2000, within=50):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = {(lang, p[i : i + k]) for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if (lang, p[i : i + k]) in found and 100 * a >= within * found[lang, p[i : i + k]]}
    out = []
    for lang in n:
        own = []
        for (g, p), a in found.items():
            if g == lang and (g, p) not in gone:
                score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(own)[:top])]
    return sorted(out)


def phrase_rows(seed=5):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(30)] + ["é", "日本", " x", "z\x00z"]
    rows = []
    for _ in range(250):
        text = "".join(r.choice(common) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " \x1f "]) for _ in range(r.randrange(60)))
        rows.append((text.replace("w1 ", "New York city ") if r.random() < 0.5 else text, r.choice(["en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), ("x", "rare"), ("a a a a " * 40, "loop"), ("Ab aB\rAB ab " * 30, "en")]


@pytest.fixture(scope="module")
def phrase_docs(spark):
    return spark.createDataFrame([(t, x, 1, "odd") for t, x in phrase_rows()], "text string, lang string, n int, phrase string").repartition(4)


def test_collocations(phrase_docs):
    got = sorted(map(tuple, collocation.mine(phrase_docs).collect()))
    assert got == plain_phrases(phrase_rows()) and len({x[0] for x in got}) >= 3


def test_collocations_dealt_out(phrase_docs, monkeypatch):
    """Many segments, several mappers and readers for each, several rounds of the tree, and another length and limits."""
    for name, value in (("SEGMENT_BYTES", 2000), ("ENTRIES", 40), ("FAN", 2), ("RANGE_BYTES", 2000), ("SLICE", 3000), ("TASK_KEYS", 150)):
        monkeypatch.setattr(collocation, name, value)
    assert sorted(map(tuple, collocation.mine(phrase_docs).collect())) == plain_phrases(phrase_rows())
    assert sorted(map(tuple, collocation.mine(phrase_docs, words=4, least=6, top=9, within=80).collect())) == plain_phrases(phrase_rows(), 4, 6, 9, 80)


def test_a_full_filter_only_adds_candidates(phrase_docs, monkeypatch):
    monkeypatch.setattr(collocation, "frequent_bits", lambda *a: np.full(1 << (collocation.FILTER_BITS - 3), 255, np.uint8))
    assert sorted(map(tuple, collocation.mine(phrase_docs).collect())) == plain_phrases(phrase_rows())


def test_collocations_of_nothing(spark, phrase_docs):
    assert collocation.mine(phrase_docs.where("false")).collect() == []
    assert collocation.mine(spark.createDataFrame([("x y", "en"), (None, None)], "text string, lang string")).collect() == []


def test_large_counts_are_exact(spark):
    a, x, y = 10**14 + 7, 3 * 10**14 + 1, 2 * 10**14 + 9
    row = spark.createDataFrame([(a, x, y)], "a long, l long, r long").select(F.expr(collocation.SCORE).alias("s")).first()
    assert row.s == 10**6 * a * a // (x * y)


def test_a_long_text(spark):
    text = ("one two three. " * 60_000) + "x " * 100_000
    got = sorted(map(tuple, collocation.mine(spark.createDataFrame([(text, "en")], "text string, lang string")).collect()))
    assert got == plain_phrases([(text, "en")])
    assert merkle.audit(made(spark, [(1, text, "en", None, None), (2, text, "en", None, None)])).select("verified").distinct().collect()[0].verified


@given(st.integers(0, 3000), st.integers(0, 10**6))
@settings(max_examples=25, deadline=None)
def test_perfect_hash(n, seed):
    keys = np.random.default_rng(seed).integers(0, 2**64, (n, 2), dtype=np.uint64)
    mph = collocation.PerfectHash.load(collocation.PerfectHash.build(keys).dump())
    assert sorted(mph.slots(keys)) == [*range(n)]
    other = mph.slots(keys ^ np.uint64(1))
    assert ((other >= -1) & (other < max(n, 1))).all()
