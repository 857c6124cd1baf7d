"""Telephony audio: G.711 expansion by tables, IMA ADPCM decoding across blocks, and storage of resampled PCM.

Defined results: a null payload is empty; equal payloads have equal results; an empty table gives no rows; a payload of any length is decoded, and a
partial last ADPCM block is filled with zeros; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RATE = 8000
BLOCK = 64  # bytes of an ADPCM block: 4 of header, 120 samples


@lru_cache(maxsize=2)
def g711_table(law: str) -> np.ndarray:
    """The 256 linear samples of a G.711 law, by its rule of sign, segment and step."""
    code = np.arange(256)
    if law == "mulaw":
        c = ~code & 0xFF
        size = ((((c & 15) << 3) + 132) << (c >> 4 & 7)) - 132
        return np.where(c & 128, -size, size).astype(np.int16)
    c = code ^ 0x55
    segment, step = c >> 4 & 7, ((c & 15) << 4) + 8
    size = np.where(segment > 0, (step + 256) << np.maximum(segment - 1, 0), step)
    return np.where(c & 128, size, -size).astype(np.int16)


# Fixed values of the IMA ADPCM format.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 * (size - 4)) of IMA ADPCM mono blocks (n, size): one step in time for all blocks at once."""
    n, size = blocks.shape
    head = blocks[:, :2].astype(np.int32)
    value = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    nibbles = np.empty((2 * (size - 4), n), np.uint8)
    nibbles[0::2], nibbles[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    out = np.empty((len(nibbles) + 1, n), np.int16)
    out[0] = value
    for i, code in enumerate(nibbles):
        step = STEPS[index]
        size_ = code & 7
        change = (step * (2 * size_.astype(np.int32) + 1)) >> 3
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[size_], 0, 88)
        out[i + 1] = value
    return out.T


def resample_double(samples: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation along the last axis; the last sample is held."""
    a = samples.astype(np.int32)
    out = np.empty((*a.shape[:-1], 2 * a.shape[-1]), np.int16)
    out[..., 0::2] = a
    out[..., 1:-1:2] = (a[..., :-1] + a[..., 1:]) >> 1
    out[..., -1:] = a[..., -1:]
    return out


def wav(data: bytes, tag: int, rate: int, bits: int, align: int, channels: int = 1) -> bytes:
    """A WAVE file; ``tag``: 1 PCM, 6 A-law, 7 mu-law, 17 IMA ADPCM."""
    fmt = struct.pack("<HHIIHHH", tag, channels, rate, rate * align, align, bits, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(data))
    return struct.pack("<4sI4s4sI", b"RIFF", 4 + 8 + len(fmt) + len(fact) + 8 + len(data), b"WAVE", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(data)) + data


def wav_data(stored: bytes) -> tuple[int, int, int, int, bytes]:
    """Format tag, channels, rate, block size and data chunk of a WAVE file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, head = 12, (0, 1, 0, 0, 1)
    while at + 8 <= len(stored):
        name, n = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIH", stored, at + 8)
        if name == b"data":
            tag, channels, rate, _, align = head
            return tag, channels, rate, align, stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def decode(tag: int, data: bytes, block: int = BLOCK) -> np.ndarray:
    """Linear samples of a data chunk, those of several channels in turn."""
    raw = np.frombuffer(data, np.uint8)
    if tag == 1:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    if tag in (6, 7):
        return g711_table("mulaw" if tag == 7 else "alaw")[raw]
    if tag == 17:
        return decode_adpcm(np.pad(raw, (0, -len(raw) % block)).reshape(-1, block)).ravel()
    raise ValueError(f"format {tag} is not a telephony format")


def stored_pcm(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAVE file of 16-bit PCM at twice the rate of ``samples``, each channel resampled by itself; a last incomplete set of channels is dropped."""
    lanes = samples[: len(samples) // channels * channels].reshape(-1, channels).T
    pcm = resample_double(lanes) if lanes.size else lanes
    return wav(np.ascontiguousarray(pcm.T).astype("<i2").tobytes(), 1, 2 * rate, 16, 2 * channels, channels)


def expand(docs: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Stored telephony WAVE files (binary) decoded and stored again as 16-bit PCM of twice the rate: id, rate, samples (of all channels), pcm (a WAVE file).

    Mu-law, A-law and PCM may have several channels; ADPCM is mono, with the file's own block size. A null file gives null rate and pcm; a file of another kind is an error.
    """
    schema = pa.schema([("id", pa.int64()), ("rate", pa.int32()), ("samples", pa.int64()), ("pcm", pa.binary())])

    def run(batches):
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if (x := x.as_py()) is None:
                    rows = [[i], [None], [0], [None]]
                else:
                    tag, channels, rate, align, data = wav_data(x)
                    pcm = stored_pcm(decode(tag, data, align or BLOCK), rate, channels)
                    rows = [[i], [2 * rate], [len(wav_data(pcm)[4]) // 2], [pcm]]
                yield C.batches(schema, rows)

    return C.map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")), run, "id long, rate int, samples long, pcm binary")


_SUMMARY = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the non-empty ranges between offsets."""
    return np.add.reduceat(values, offsets[:-1])


def audio_digest(docs: DataFrame, unit: int = 192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as 8-bit mu-law WAVE files, read back, decoded and summed up.

    The text's bytes, filled with spaces to a positive multiple of ``unit``, are the samples. The stored bytes are parsed again, and the feature comes
    from these: energy, peak and sign changes of the mu-law samples; number, energy and checksum of the PCM samples of twice the rate, stored as a WAVE file by ``stored_pcm`` and read
    back too; energy of the A-law reading; and energy and peak of the samples that the same bytes give as ADPCM blocks of ``BLOCK`` bytes.
    """

    def run(batches):
        mu, al = g711_table("mulaw"), g711_table("alaw").astype(np.int64)
        squares = al * al
        for b in batches:
            ids = b.column(0)
            for i, j, data, offsets in C.slices(b.column(1)):
                n = np.diff(offsets)
                padded = np.maximum(unit, -(-n // unit) * unit)
                raw, at = data.tobytes(), offsets.tolist()
                stored = [wav(raw[at[k] : at[k + 1]].ljust(p, b" "), 7, RATE, 8, 1) for k, p in enumerate(padded.tolist())]
                back = [wav_data(x)[4] for x in stored]
                o = C.from_offsets(padded)
                flat = np.frombuffer(b"".join(back), np.uint8)
                linear = mu[flat]
                turn = np.zeros(len(flat), np.int64)
                turn[1:] = (linear[1:] < 0) != (linear[:-1] < 0)
                turn[o[:-1]] = 0
                loud = np.abs(linear.astype(np.int32)).astype(np.int64)
                energy, peak = _sums(loud * loud, o), np.maximum.reduceat(loud, o[:-1])
                pcm = [wav_data(stored_pcm(linear[x:y], RATE))[4] for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                fine = np.frombuffer(b"".join(pcm), "<i2").astype(np.int64)
                pcm_energy = _sums(fine * fine, 2 * o)
                a_energy = _sums(squares[flat], o)
                coded = decode_adpcm(flat.reshape(-1, BLOCK)).astype(np.int64)
                blocks = o // BLOCK
                d_energy, d_peak = _sums((coded * coded).sum(1), blocks), np.maximum.reduceat(np.abs(coded).max(1), blocks[:-1])
                parts = zip(*(x.tolist() for x in (energy, peak, _sums(turn, o), pcm_energy, a_energy, d_energy, d_peak)), pcm, strict=True)
                feature = [f"mulaw:{a}/{c}/{d}|pcm16k:{len(x) // 2}/{e}/{zlib.crc32(x)}|alaw:{f}|adpcm:{g}/{h}" for a, c, d, e, f, g, h, x in parts]
                yield C.batches(_SUMMARY, [ids.slice(i, j - i), n, padded, [hashlib.sha256(x).hexdigest() for x in back], np.array([zlib.crc32(x[-16:]) for x in back], np.int64), np.array([len(x) for x in stored], np.int64), [hashlib.sha256(x).hexdigest() for x in stored], feature])

    spec = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return C.map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, spec)
