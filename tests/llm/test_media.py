"""Telephony files against a plain decoder, packing of odd rows and letters, and rules of long hosts."""

import hashlib
import itertools
import random
import struct
import time
import zlib

import numpy as np

from voxelspark.llm import packing, telephony, url_filter


def plain_g711(code, law):
    """A sample by the G.711 rules, one value at a time."""
    if law == "mulaw":
        code = ~code & 0xFF
        size = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
        return -size if code & 128 else size
    code ^= 0x55
    segment, size = code >> 4 & 7, (code & 15) * 16 + 8
    size = (size + 256) << (segment - 1) if segment else size
    return size if code & 128 else -size


def plain_adpcm(block):
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = step * (2 * (code & 7) + 1) >> 3
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(telephony.INDEX_MOVES[code & 7])))
            out.append(value)
    return out


def doubled(x):
    return [v for a, b in itertools.pairwise([*x, x[-1]]) for v in (a, (a + b) >> 1)] if x else []


def test_tables_and_blocks_against_a_plain_decoder():
    for law in ("mulaw", "alaw"):
        assert telephony.g711_table(law).tolist() == [plain_g711(c, law) for c in range(256)]
    blocks = np.random.default_rng(1).integers(0, 256, (30, 64), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


def test_expand(spark):
    raw = np.random.default_rng(2).integers(0, 256, 303, dtype=np.uint8).tobytes()
    stereo = telephony.wav(raw[:302], 7, 8000, 8, 2, 2)
    files = [telephony.wav(raw, 7, 8000, 8, 1), telephony.wav(raw, 6, 8000, 8, 1), telephony.wav(raw, 17, 11025, 4, 36), stereo, telephony.wav(b"", 7, 8000, 8, 1), None, telephony.wav(raw[:7], 1, 8000, 16, 2)]
    rows = sorted(telephony.expand(spark.createDataFrame([(i, x, 5) for i, x in enumerate(files)], "doc long, media binary, rate int"), "doc", "media").collect())
    linear = [plain_g711(c, "mulaw") for c in raw]
    padded = raw + bytes(-len(raw) % 36)
    adpcm = [v for k in range(0, len(padded), 36) for v in plain_adpcm(padded[k : k + 36])]
    left, right = doubled(linear[0:302:2]), doubled(linear[1:302:2])
    want = [doubled(linear), doubled([plain_g711(c, "alaw") for c in raw]), doubled(adpcm), [v for x in zip(left, right, strict=True) for v in x], [], None, doubled([*struct.unpack("<3h", raw[:6])])]
    for r, w in zip(rows, want, strict=True):
        if w is None:
            assert (r.rate, r.samples, r.pcm) == (None, 0, None)
        else:
            tag, channels, rate, _, data = telephony.wav_data(bytes(r.pcm))
            assert (tag, channels, rate, [*struct.unpack(f"<{len(w)}h", data)]) == (1, 2 if r.id == 3 else 1, r.rate, w) and r.samples == len(w)


def test_digest_features_against_a_plain_one(spark):
    texts = ["", None, "a", "mü" * 100, "x" * 192, "y" * 193, "mü" * 100, "long " * 3000]
    rows = telephony.audio_digest(spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, feature string")).collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        x, a = [plain_g711(c, "mulaw") for c in full], [plain_g711(c, "alaw") for c in full]
        d = [v for k in range(0, len(full), 64) for v in plain_adpcm(full[k : k + 64])]
        p = doubled(x)
        square = lambda v: sum(s * s for s in v)
        turns = sum((s < 0) != (t < 0) for s, t in itertools.pairwise(x))
        want = f"mulaw:{square(x)}/{max(map(abs, x))}/{turns}|pcm16k:{len(p)}/{square(p)}/{zlib.crc32(struct.pack(f'<{len(p)}h', *p))}|alaw:{square(a)}|adpcm:{square(d)}/{max(map(abs, d))}"
        assert (r.feature, r.payload_sha256, r.tail_crc32) == (want, hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


def test_tokens_of_odd_letters_and_null_ids(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    r = random.Random(3)
    odd = ["İ!", "HAKKARİ.", "İİ,i̇.I", "ŉ-ſ.", "Ÿ(ÿ)", *("".join(r.choices("aBİıß×÷ŉſ'.-,!<|>_é̇ 9", k=12)) for _ in range(500))]
    for t in odd:
        got, _ = enc.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert got.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t
    rows = packing.pack_documents(spark.createDataFrame([(None, "a b c", 1), (None, None, 2), (4, "d" * 9, 3), (4, "d" * 9, 3)], "doc_id long, text string, length int"), path, size=16).collect()
    assert sorted(str((r.doc_id, r.doc_tokens)) for r in rows if r.start == 0) == sorted(map(str, [(None, 4), (None, 1), *[(4, len(tok.encode("d" * 9, add_special_tokens=False).ids) + 1)] * 2]))
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_rules_of_long_hosts_and_odd_tables(spark):
    long = ".".join(["a"] * 12_000)
    urls = [f"http://{long}.example.net/en/", f"http://{long}/x", "http://.net/", "http://net./", "http://a..net/x", None, "http://example.net/en/" + "y" * 300_000, "://net", "http://NET", "http://b.c.d.example.com/de/?#"]
    frame = spark.createDataFrame([(i if i else None, u, "h", "v", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, keys int")
    began = time.time()
    rows = url_filter.filter_urls(frame, ["net/", "net/", "example.com/de/", "d.example.com/de/"], ["example.net/en/", "org/fr/", "net/"]).collect()
    assert time.time() - began < 40
    got = {r.page_id: (r.rule, r.verdict) for r in rows}
    assert got == {None: ("example.net/en/", "allow"), 1: (None, "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: ("net/", "block"), 5: (None, "allow"), 6: ("example.net/en/", "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("d.example.com/de/", "block")}
    assert url_filter.filter_urls(frame.limit(0), ["net/"], []).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(frame, [], []).collect()} == {"allow"}
