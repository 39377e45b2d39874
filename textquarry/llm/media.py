"""Media columns: telephony audio in and out of DataFrames.

``encode_media`` stores bytes losslessly in a WAVE container, in one of three codecs: as 8-bit mu-law or A-law samples, a
sample being a byte, or as the 4-bit codes of IMA ADPCM blocks, two to a byte behind each block's header. Where no codec
is named, a digest of the bytes picks one, so that all three occur and equal bytes get equal media.
``decode_media`` reads such containers back: mu-law and A-law expand by 256-entry tables, ADPCM blocks are decoded side by
side with numpy, and the linear PCM is resampled (linear interpolation between samples) and stored as 16-bit samples.
Long media are expanded, resampled and measured in pieces, so that a text byte costs few bytes beside what is stored.

Cases: null and empty bytes are stored as one padding block; equal bytes give equal media; a container that cannot be
read gives null columns and its reason in ``media_error``; repeated rows, empty tables and further columns pass through,
a further column named like a result is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import per_value, table

#: WAVE format tags (fixed values).
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}
CODECS = ("mulaw", "alaw", "ima_adpcm")
#: Bytes of an ADPCM block before its codes: first sample, step index, and one unused.
HEADER = 4
#: Samples that are worked on at once.
PIECE = 1 << 18
#: ADPCM blocks that are decoded side by side.
MANY = 4096


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, size + 8, (size + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


EXPAND = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}
#: IMA ADPCM (fixed values): how the step index moves, and the quantiser's steps.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]
)


def adpcm_blocks(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: samples of all whole blocks. The loop runs along a block, each step over all blocks at once."""
    if len(data) > block * MANY:
        return np.concatenate([adpcm_blocks(data[i : i + block * MANY], block) for i in range(0, len(data), block * MANY)])
    blocks = np.frombuffer(data[: len(data) // block * block], np.uint8).reshape(-1, block)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.clip(blocks[:, 2].astype(np.int64), 0, 88)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for i in range(codes.shape[1]):
        c, step = codes[:, i], STEPS[index]
        move = (step >> 3) + np.where(c & 4, step, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 1, step >> 2, 0)
        value = np.clip(value + np.where(c & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_STEP[c], 0, 88)
        out[:, i + 1] = value
    return out.reshape(-1)


def wave(data: bytes, codec: str, rate: int = 8000, block: int = 1) -> bytes:
    """data in a mono WAVE container."""
    bits = {"pcm": 16, "ima_adpcm": 4}.get(codec, 8)
    head = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate * block, block, bits, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and sample bytes of a mono WAVE container."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE container")
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and head:
            codec = {v: k for k, v in TAGS.items()}.get(head[0])
            if codec is None or head[1] != 1:
                raise ValueError(f"format {head[0]} with {head[1]} channels")
            return codec, head[2], head[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def expand(codec: str, data: bytes, block: int) -> np.ndarray:
    """Linear 16-bit samples."""
    if codec in EXPAND:
        return EXPAND[codec][np.frombuffer(data, np.uint8)]
    return adpcm_blocks(data, block) if codec == "ima_adpcm" else np.frombuffer(data[: len(data) & ~1], "<i2")


def resample(pcm: np.ndarray, rate: int, to: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Output samples first to last (all, if None) of pcm at another rate: between the two samples around each one's time."""
    n = len(pcm) * to // rate
    last = n if last is None else min(last, n)
    times = to // rate
    if times * rate == to and first % times == 0 and first < last:  # a whole number of samples for each one
        i, j = first // times, -(-last // times)
        x = pcm[i:j].astype(np.float64)
        rise = np.append(pcm[i + 1 : j], pcm[min(j, len(pcm) - 1)]) - x
        out = np.empty((j - i, times), np.int16)
        for k in range(times):
            out[:, k] = np.round(x + rise * (k / times)) if k else x
        return out.reshape(-1)[: last - first]
    at = np.arange(first, last, dtype=np.int64) * rate
    i, part = at // to, at % to
    a = pcm[i].astype(np.float64)
    b = pcm[np.minimum(i + 1, len(pcm) - 1)] if len(pcm) else a
    return np.round(a + (b - a) * (part / to)).astype(np.int16)


def resample_in_pieces(pcm: np.ndarray, rate: int, to: int) -> Iterator[np.ndarray]:
    if rate == to:
        yield pcm.astype(np.int16)
        return
    n = len(pcm) * to // rate
    for s in range(0, n, PIECE):
        yield resample(pcm, rate, to, s, s + PIECE)


class Features:
    """Sums over samples that come in pieces."""

    def __init__(self):
        self.n = self.energy = self.sum = self.peak = self.crossings = 0
        self.last: bool | None = None

    def add(self, pcm: np.ndarray) -> None:
        if not len(pcm):
            return
        x, below = pcm.astype(np.int64), pcm < 0
        self.n += len(x)
        self.energy += int(x @ x)
        self.sum += int(x.sum())
        self.peak = max(self.peak, int(np.abs(x).max()))
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + int(self.last is not None and bool(below[0]) != self.last)
        self.last = bool(below[-1])


def encode_media(df: DataFrame, text: str = "text", codec: str | None = None, rate: int = 8000, pad: int = 64) -> DataFrame:
    """df without its text, with n_bytes and the UTF-8 bytes as media, padded with bytes 0 to a positive multiple of pad."""

    def one(t: str | None) -> tuple:
        b = (t or "").encode("utf-8", "surrogatepass")
        n = len(b)
        b += b"\0" * (-n % pad if b else pad)
        own = codec or CODECS[zlib.crc32(b) % len(CODECS)]
        if own == "ima_adpcm":  # each block starts anew from sample 0 and step 0
            return n, wave(np.pad(np.frombuffer(b, np.uint8).reshape(-1, pad), ((0, 0), (HEADER, 0))).tobytes(), own, rate, pad + HEADER)
        return n, wave(b, own, rate)

    return per_value(df, text, {"n_bytes": "long", "media": "binary"}, lambda: one)


def payload(codec: str, data: bytes, block: int) -> bytes:
    """What the sample bytes hold: all of them, or the codes of ADPCM blocks without their headers."""
    if codec != "ima_adpcm":
        return data
    return np.frombuffer(data[: len(data) // block * block], np.uint8).reshape(-1, block)[:, HEADER:].tobytes()


def decode_media(df: DataFrame, media: str = "media", to: int = 16000, keep_pcm: bool = True) -> DataFrame:
    """df with what its containers hold: the stored payload's size and digests, the container's, and the resampled PCM with features."""
    made = {
        "payload_bytes": "long",
        "payload_sha256": "string",
        "tail_crc32": "long",
        "media_bytes": "long",
        "media_sha256": "string",
        "feature": "string",
        "media_error": "string",
    } | ({"pcm": "binary"} if keep_pcm else {})

    def measured(m: bytes, codec: str, rate: int, block: int, data: bytes, pcm: np.ndarray) -> tuple:
        held, seen, out = payload(codec, data, block), Features(), []
        for piece in resample_in_pieces(pcm, rate, to):
            seen.add(piece)
            if keep_pcm:
                out.append(piece.astype("<i2").tobytes())
        feature = f"{codec}/{rate}>{to} n={seen.n} energy={seen.energy} sum={seen.sum} peak={seen.peak} crossings={seen.crossings}"
        return (len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, None, *([b"".join(out)] if keep_pcm else []))

    def some(media: list[bytes]) -> list[tuple]:
        read: list[tuple | str] = []
        for m in media:
            try:
                read.append(read_wave(m))
            except (ValueError, struct.error, TypeError) as e:
                read.append(str(e))
        linear: dict[int, np.ndarray] = {}
        for block in {r[2] for r in read if r[0] == "ima_adpcm" and r[2] > HEADER}:  # blocks of all media at once
            own = [i for i, r in enumerate(read) if r[0] == "ima_adpcm" and r[2] == block]
            n = [len(read[i][3]) // block for i in own]
            samples = adpcm_blocks(b"".join(read[i][3][: k * block] for i, k in zip(own, n, strict=True)), block)
            linear.update(zip(own, np.split(samples, np.cumsum(n)[:-1] * (2 * (block - HEADER) + 1)), strict=True))
        out = []
        for i, (m, r) in enumerate(zip(media, read, strict=True)):
            if isinstance(r, str) or (r[0] == "ima_adpcm" and i not in linear):
                out.append((None,) * 6 + (r if isinstance(r, str) else "blocks without samples",) + (None,) * keep_pcm)
            else:
                out.append(measured(m, *r, linear[i] if i in linear else expand(r[0], r[3], r[2])))
        return out

    return per_value(df, media, made, lambda: some, together=True)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = encode_media(table(spark, sf_dir, "documents", "doc_id", "text"))
    return decode_media(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")
