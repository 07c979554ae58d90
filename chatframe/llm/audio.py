"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV files.

Companded samples expand through 256-entry lookup tables. ADPCM blocks of a whole Arrow batch are
decoded together: step k of every block at once, so the loop is over a block's samples and numpy
works across blocks. Decoded audio is resampled by linear interpolation and kept as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import scratch, store

#: WAV format tags (fixed values).
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
CODECS = {tag: name for name, tag in TAGS.items()}
#: Data bytes of an ADPCM block after its 4-byte header.
BLOCK_DATA = 192
#: Payloads are padded with spaces to a multiple of this.
UNIT = 192
RATE, TARGET_RATE = 8000, 16000
#: Bytes of media decoded together.
SLICE_BYTES = 4 << 20
#: Level of zstd for PCM.
PCM_LEVEL = 9
#: PCM takes more than twice the disk of the media. Beyond so many bytes of text it is stored, read back
#: and removed in portions, up to PORTIONS of them.
PORTION_BYTES = 32 << 20
PORTIONS = 4

#: IMA ADPCM step sizes and index moves (fixed values of the format).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits are sign, 3 bits of exponent, 4 of mantissa, with bias 132."""
    u = ~np.arange(256) & 0xFF
    value = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: every other bit is inverted; segment 0 is linear."""
    a = np.arange(256) ^ 0x55
    segment, value = a >> 4 & 7, ((a & 15) << 4) + 8
    value = np.where(segment > 0, value + 256 << np.maximum(segment - 1, 0), value)
    return np.where(a & 128, value, -value).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """(difference, next index) for each step index and 4-bit code, at index * 16 + code."""
    index, code = np.divmod(np.arange(len(STEPS) * 16), 16)
    step, size = STEPS[index], code & 7
    diff = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
    return np.where(code & 8, -diff, diff).astype(np.int32), np.clip(index + MOVES[size], 0, len(STEPS) - 1).astype(np.int32)


EXPAND = {"mulaw": mulaw_table(), "alaw": alaw_table()}
DIFFERENCE, NEXT = adpcm_tables()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(n, 4 + d) bytes of mono blocks -> (n, 1 + 2d) samples; the low half of a byte comes first.
    Step indexes beyond the table count as its last."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half, code in enumerate((data[k] & 15, data[k] >> 4)):
            at = index * 16 + code
            value = np.clip(value + DIFFERENCE[at], -32768, 32767)
            index = NEXT[at]
            out[1 + 2 * k + half] = value
    return out.T


def wav(codec: str, payload: bytes) -> bytes:
    """A mono WAV file that holds ``payload`` unchanged: companded samples byte for byte, or 4-bit
    codes after the zero header of each ADPCM block. The payload is a multiple of BLOCK_DATA."""
    data, align, bits, extra = payload, 1, 8, b"\0\0"
    samples = len(payload)
    if codec == "ima_adpcm":
        blocks = np.zeros((len(payload) // BLOCK_DATA, 4 + BLOCK_DATA), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_DATA)
        data, align, bits = blocks.tobytes(), 4 + BLOCK_DATA, 4
        extra = struct.pack("<HH", 2, 1 + 2 * BLOCK_DATA)
        samples = len(blocks) * (1 + 2 * BLOCK_DATA)
    rate = RATE if bits == 8 else RATE * align // (1 + 2 * BLOCK_DATA)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, rate, align, bits) + extra
    chunks = [(b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", data)]
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, sample rate, block align, data) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data = 12, b"", None
    while at + 8 <= len(media) and data is None:
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            fmt = media[at + 8 : at + 8 + n]
        elif kind == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    tag, channels, rate, _, align = struct.unpack_from("<HHIIH", fmt)
    if tag not in CODECS or channels != 1 or data is None:
        raise ValueError(f"WAV format {tag} with {channels} channels isn't telephony audio")
    return CODECS[tag], rate, align, data


def payload_of(codec: str, align: int, data: bytes) -> bytes:
    """What ``wav`` was given."""
    if codec != "ima_adpcm":
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation to ``target`` samples a second, rounded to 16 bits."""
    if rate == target or not len(x):
        return x
    if target == 2 * rate:
        out = np.empty(2 * len(x), np.int16)
        out[::2] = x
        out[1:-1:2] = (x[:-1].astype(np.int32) + x[1:]) >> 1
        out[-1] = x[-1]
        return out
    at = np.arange(len(x) * target // rate) * (rate / target)
    return np.rint(np.interp(at, np.arange(len(x)), x)).astype(np.int16)


def decode(files: list[bytes | None], target: int = TARGET_RATE) -> list[np.ndarray | None]:
    """16-bit PCM at ``target`` samples a second for each file; None for null. ADPCM blocks of
    equal size are decoded together, whichever files they are from."""
    out: list[np.ndarray | None] = [None] * len(files)
    adpcm: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        if media is None:
            continue
        codec, rate, align, data = parse_wav(media)
        if codec == "ima_adpcm":
            adpcm.setdefault(align, []).append((i, rate, np.frombuffer(data, np.uint8)[: len(data) // align * align].reshape(-1, align)))
        else:
            out[i] = resample(EXPAND[codec][np.frombuffer(data, np.uint8)], rate, target)
    for group in adpcm.values():
        samples, at = adpcm_blocks(np.concatenate([b for _, _, b in group])), 0
        for i, rate, blocks in group:
            out[i] = resample(samples[at : at + len(blocks)].reshape(-1), rate, target)
            at += len(blocks)
    return out


def by_bytes(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about SLICE_BYTES of media, and a row at least: PCM takes some eight
    times as much while it is decoded."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with spaces to a positive multiple
    of UNIT, stored losslessly as the samples of a WAV file. Null counts as empty. The codec is
    picked by the bytes' crc32, so equal texts get equal files and all codecs are in use."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(TAGS)
        for batch in batches:
            sizes, files = [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                files.append(wav(names[zlib.crc32(raw) % len(names)], raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(encode, f"doc_id {base.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(media: DataFrame, media_col: str = "media", target: int = TARGET_RATE) -> DataFrame:
    """``media`` with ``pcm`` (little-endian 16-bit samples) in place of any such column."""
    kept = media.drop("pcm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in by_bytes(batch, media_col)):
            pcm = [None if x is None else x.astype("<i2").tobytes() for x in decode(part.column(media_col).to_pylist(), target)]
            yield part.append_column("pcm", pa.array(pcm, pa.binary()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, pcm binary")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def feature_of(source: str, pcm: np.ndarray) -> str:
    """The audio's feature: ``source`` (codec and rate) and figures of its resampled PCM."""
    x = pcm.astype(np.float32)
    rms = float(np.sqrt(np.mean(x * x, dtype=np.float64)))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    peak = int(max(-int(pcm.min()), int(pcm.max())))
    return f"{source}>{TARGET_RATE}:n={len(pcm)}:rms={rms:.3f}:peak={peak}:zc={crossings}:crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def digests(media: DataFrame, keep_pcm: bool = False) -> DataFrame:
    """Digests of stored media and of the payload read back, and the audio's feature. With ``keep_pcm``
    the feature's ``source`` and ``pcm`` (little-endian 16-bit samples) are in its place, for ``features``."""
    fields = DIGESTS + (", source string, pcm binary" if keep_pcm else ", feature string")

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        files = batch.column("media").to_pylist()
        for n, media, pcm in zip(batch.column("n_bytes").to_pylist(), files, decode(files), strict=True):
            codec, rate, align, data = parse_wav(media)
            payload, source = payload_of(codec, align, data), f"{codec}:{rate}"
            audio = (source, pcm.astype("<i2").tobytes()) if keep_pcm else (feature_of(source, pcm),)
            yield n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), *audio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
        for part in (x for batch in batches for x in by_bytes(batch, "media")):
            columns = list(zip(*rows_of(part), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {fields}")


def features(sounds: DataFrame) -> DataFrame:
    """``feature`` in place of the ``source`` and the ``pcm`` that ``digests`` kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in by_bytes(batch, "pcm")):
            found = [feature_of(s, np.frombuffer(x, "<i2")) for s, x in zip(part.column("source").to_pylist(), part.column("pcm").to_pylist(), strict=True)]
            yield part.drop_columns(["source", "pcm"]).append_column("feature", pa.array(found, pa.string()))

    return sounds.mapInArrow(run, f"doc_id {sounds.schema['doc_id'].dataType.simpleString()}, {DIGESTS}, feature string")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_pcm: bool = False) -> DataFrame:
    """Store every text as media, read the stored files back and compute their features: one row
    for each input row. Null and empty texts are 192 spaces; repeated rows give equal values; other
    columns are not carried; an empty table gives no rows. With ``keep_pcm`` the resampled PCM is
    stored beside the media and the features are of the PCM read back; they are the same. All media stay;
    of more than one portion of PCM each is removed as soon as its features are stored."""
    media = store(store_payloads(docs, id_col, text_col), "media")
    if not keep_pcm:
        return digests(media)
    size = media.agg(F.sum("n_bytes")).first()[0] or 0
    portions = max(1, min(PORTIONS, -(-size // PORTION_BYTES)))
    if portions == 1:
        return features(store(digests(media, keep_pcm=True), "pcm", level=PCM_LEVEL))
    found = []
    for k in range(portions):
        with scratch(docs.sparkSession):
            pcm = store(digests(media.where(F.pmod(F.xxhash64("doc_id"), F.lit(portions)) == k), keep_pcm=True), "pcm", level=PCM_LEVEL)
            found.append(store(features(pcm), "features", keep=True))
    return reduce(DataFrame.unionByName, found)
