"""Telephony audio in a column: mu-law, A-law and IMA ADPCM in WAV containers.

Companded bytes are expanded by 256-entry tables, which are built from the
coding rules.  ADPCM blocks are decoded side by side: one numpy step advances
every block of a batch by one sample, so that the number of steps is a block's
length and not the audio's.  Decoded audio is 16-bit PCM, which can be
resampled by a windowed-sinc filter and stored as WAV in a binary column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import slices, stored, text_bytes

PAD = 192
RATE = 8000
#: Stored PCM has UP / DOWN times the media's rate: 2 kHz, which holds the 1 kHz below which most of a voice's power lies.
UP, DOWN = 1, 4
#: Bits of its samples: no more than a companded code has, or the stored PCM would outweigh the media. 8 or 16.
BITS = 8
# WAV format tags.
PCM, ALAW, MULAW, IMA = 0x0001, 0x0006, 0x0007, 0x0011
#: Payload bytes of an ADPCM block; its header of four bytes holds the first sample and the step index.
IMA_DATA = PAD
# How a code's magnitude moves the IMA step index.
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
# The 89 IMA step sizes.
IMA_STEPS = np.array(
    """
    7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279
    307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026
    4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767
    """.split(),
    np.int64,
)
_SLICE = 2 << 20


def _mulaw_table() -> np.ndarray:
    """Code -> 16-bit sample: bits inverted, then sign, three of exponent and four of mantissa with a bias of 33."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 1) + 33) << ((code >> 4) & 7)) - 33
    return (np.where(code & 0x80, -size, size) * 4).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """Code -> 16-bit sample: even bits inverted, then sign, three of exponent and four of mantissa; the first two segments are linear."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent > 0, (mantissa + 0x100) << np.maximum(exponent - 1, 0), mantissa)
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, a row for each: the header's sample, then two for each data byte, low nibble first."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), len(IMA_STEPS) - 1)
    data = blocks[:, 4:]
    out = np.empty((len(blocks), 2 * data.shape[1] + 1), np.int16)
    out[:, 0] = sample = head
    for k in range(2 * data.shape[1]):
        code = (data[:, k // 2] >> np.uint8(4 * (k % 2))).astype(np.int64) & 15
        step = IMA_STEPS[index]
        size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        sample = np.clip(np.where(code & 8, sample - size, sample + size), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code & 7], 0, len(IMA_STEPS) - 1)
        out[:, k + 1] = sample
    return out


def wav(kind: int, data: bytes, rate: int = RATE, bits: int = 16) -> bytes:
    """A mono WAV file: PCM has bits a sample, the companded kinds 8, ADPCM 4 in blocks of IMA_DATA + 4 bytes."""
    align, bits, extra = {PCM: (bits // 8, bits, b""), ALAW: (1, 8, b"\0\0"), MULAW: (1, 8, b"\0\0"), IMA: (IMA_DATA + 4, 4, struct.pack("<HH", 2, 2 * IMA_DATA + 1))}[kind]
    per_second = rate * align if kind != IMA else rate * align // (2 * IMA_DATA + 1)
    chunk = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(chunk)) + chunk + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass(frozen=True)
class Audio:
    kind: int
    rate: int
    data: np.ndarray
    align: int = IMA_DATA + 4  # bytes of an ADPCM block, or of a PCM sample


def read_wav(media: bytes) -> Audio:
    """Format, rate and data bytes of a mono WAV file; ValueError if it is not one of the kinds above."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or form[0] not in (PCM, ALAW, MULAW, IMA) or form[1] != 1 or at + 8 + size > len(media):
                raise ValueError("no mono telephony audio")
            if form[0] == IMA and form[4] <= 4:
                raise ValueError("no ADPCM block size")
            return Audio(form[0], form[2], np.frombuffer(media, np.uint8, size, at + 8), form[4])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def to_bytes(samples: np.ndarray, bits: int) -> bytes:
    """16-bit samples as PCM: of 8 bits, the nearest unsigned ones."""
    return samples.astype("<i2").tobytes() if bits == 16 else np.clip(np.rint(samples / 256) + 128, 0, 255).astype(np.uint8).tobytes()


def from_bytes(data: np.ndarray, bits: int) -> np.ndarray:
    return data[: len(data) // 2 * 2].view("<i2").astype(np.int16) if bits == 16 else (data.astype(np.int16) - 128) * np.int16(256)


def ima_blocks(audio: Audio) -> list[np.ndarray]:
    """Rows of whole ADPCM blocks and, if the data ends within a block, one shorter row; less than a block's header is no block."""
    whole = len(audio.data) // audio.align * audio.align
    rest = audio.data[whole:]
    return [audio.data[:whole].reshape(-1, audio.align)] + ([rest[None, :]] if len(rest) >= 4 else [])


def decode_all(found: list[Audio]) -> list[np.ndarray]:
    """16-bit samples of each audio; the ADPCM blocks of one length are decoded together, whosesoever they are."""
    parts = [(k, n, rows) for k, a in enumerate(found) if a.kind == IMA for n, rows in enumerate(ima_blocks(a))]
    samples: dict[tuple[int, int], np.ndarray] = {}
    for width in {rows.shape[1] for *_, rows in parts}:
        own = [x for x in parts if x[2].shape[1] == width]
        decoded = decode_ima(np.concatenate([rows for *_, rows in own]))
        cuts = np.cumsum([0, *(len(rows) for *_, rows in own)])
        samples |= {(k, n): decoded[cuts[j] : cuts[j + 1]].ravel() for j, (k, n, _) in enumerate(own)}
    out = []
    for k, a in enumerate(found):
        if a.kind == IMA:
            out.append(np.concatenate([np.zeros(0, np.int16), *(samples[k, n] for n in range(2) if (k, n) in samples)]))
        elif a.kind == PCM:
            out.append(from_bytes(a.data, 8 * a.align))
        else:
            out.append((MULAW_TABLE if a.kind == MULAW else ALAW_TABLE)[a.data])
    return out


def resample(samples: np.ndarray, up: int, down: int, half: int = 8) -> np.ndarray:
    """Samples at up/down times the rate: a Hann-windowed sinc of half zero crossings on each side, a set of taps for each of the up phases."""
    n = -(-len(samples) * up // down)
    half *= max(1, -(-down // up))  # a lower rate needs longer taps
    t = np.arange(2 * half)[None, :] - (half - 1) - np.arange(up)[:, None] / up
    taps = np.sinc(t * min(1.0, up / down)) * (0.5 + 0.5 * np.cos(np.pi * t / half)) * (np.abs(t) < half)
    taps /= taps.sum(axis=1, keepdims=True)
    padded = np.concatenate([np.zeros(half - 1, np.float32), samples.astype(np.float32), np.zeros(half + 1, np.float32)])
    out = np.zeros(n, np.float32)
    for k in range(min(up, n)):  # outputs k, k + up, ... share their taps and lie down inputs apart
        part, first = out[k::up], k * down // up
        for j, tap in enumerate(taps[k * down % up].astype(np.float32)):
            if abs(tap) > 1e-7:
                part += padded[first + j :: down][: len(part)] * tap
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def payload_of(text: bytes) -> bytes:
    """The text's bytes and spaces up to a positive multiple of PAD."""
    return text + b" " * (max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def encode_payload(payload: bytes) -> bytes:
    """The payload's bytes as audio codes, every one kept as it is; which of the three codecs holds them follows from their CRC-32."""
    kind = (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]
    if kind != IMA:
        return wav(kind, payload)
    data = np.frombuffer(payload, np.uint8).reshape(-1, IMA_DATA)
    return wav(IMA, np.concatenate([np.zeros((len(data), 4), np.uint8), data], axis=1).tobytes())


def payload_from(audio: Audio) -> bytes:
    return b"".join(rows[:, 4:].tobytes() for rows in ima_blocks(audio)) if audio.kind == IMA else audio.data.tobytes()


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a WAV file) of every row; a null text is an empty one, whose payload is spaces."""

    def store(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                data, off = text_bytes(part.column("text"))
                texts = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([encode_payload(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """doc_id, n_bytes, payload digests, the media's digest, a feature and pcm, the audio at up/down times its rate as a WAV file with BITS a sample.

    media: doc_id, n_bytes, media, as store_texts() or a media table has them.
    feature tells codec, number of samples, peak, root mean square and zero
    crossings of the decoded audio, and the CRC-32 of the resampled samples.
    A null media gives nulls; a file that is not mono telephony audio fails.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["pcm"]
    label = {MULAW: "mulaw", ALAW: "alaw", IMA: "ima_adpcm", PCM: "pcm"}

    def one(media: bytes, audio: Audio, samples: np.ndarray) -> list:
        payload = payload_from(audio)
        level = samples.astype(np.float64)
        turned = resample(samples, up, down)
        crossings = int(np.count_nonzero((samples[1:] >= 0) != (samples[:-1] >= 0)))
        rms = float(np.sqrt(np.mean(level * level))) if len(level) else 0.0
        peak = int(np.abs(level).max()) if len(level) else 0
        text = f"{label[audio.kind]} n={len(samples)} peak={peak} rms={rms:.3f} crossings={crossings} resampled={len(turned)}:{zlib.crc32(turned.tobytes()):08x}"
        found = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), text]
        return [*found, wav(PCM, to_bytes(turned, BITS), audio.rate * up // down, BITS)]

    def decode(batches):
        for batch in batches:
            for part in slices(batch, "media", _SLICE):
                files = part.column("media").to_pylist()
                audio = [read_wav(m) for m in files if m is not None]
                ready = iter([one(m, a, s) for m, a, s in zip((m for m in files if m is not None), audio, decode_all(audio), strict=True)])
                rows = [[None] * 7 if m is None else next(ready) for m in files]
                columns = [[r[k] for r in rows] for k in range(7)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, schema)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """decode_media() of store_texts(), with the media and the decoded PCM as tables in the checkpoint folder, from which the bytes are read back."""
    return stored(decode_media(stored(store_texts(docs))))
