"""Operator 10, media columns: AVI motion-JPEG in a binary column.

Writing: a payload of bytes becomes grey frames of ``SIDE`` x ``SIDE`` blocks.
A byte is the level of one 8 x 8 block: with a quantiser of 8 the block's DC
term is the byte less 128 and all other terms are zero, which a baseline JPEG
stores without loss.  The DC table gives category c a code of 9 - c bits, so a
DC term takes 9 bits with its extra bits and a block 10 with the end-of-block
bit: frames are valid baseline JPEGs that numpy packs and unpacks in bulk.

Reading: RIFF chunks and the ``idx1`` index are parsed, frames are taken by the
index (or by walking ``movi`` if there is none) and decoded.  Frames with the
writer's tables go the bulk way; any other baseline frame, grey or colour, with
its own Huffman tables or the standard ones, goes through a general decoder with
inverse cosine transform, which keeps the luma.  A frame without bytes repeats
the one before.  Progressive and arithmetic frames are not decoded.

Shots: the difference of neighbouring frames' level histograms is held against
the mean and deviation of the differences of the shot, and at its start against
the mean of the shot before; a frame far above starts a new shot, and each shot
gives one timed clip.  Any frame but the first can start one.

Defined cases: null and empty texts give one frame of padding; very long texts
give many; null media give no clip, and media that cannot be read one row with
the error; ties need no order, as rows stay one to one, with repeated and null
doc_ids; equal texts give equal values; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, text_rows, texts, tidied

#: Blocks along a frame's side; a frame holds SIDE * SIDE bytes.
SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
RATE = 25
#: Levels that fall into one histogram bin, as a shift; 16 bins.
BIN_SHIFT = 4
#: A cut needs a difference above mean + CUT_DEVIATIONS * deviation and above CUT_LEAST of the frame's blocks.
CUT_DEVIATIONS = 3.0
CUT_LEAST = 0.25


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache
def jpeg_head(side: int = SIDE) -> bytes:
    """All of a frame before its scan data."""
    dc = bytes([0x00, 1, 1, 1, 1, 1, 1, 1, 1, 1, *[0] * 7, *range(8, -1, -1)])  # code of category c: 9 - c bits
    ac = bytes([0x10, 1, *[0] * 15, 0x00])  # end of block: one bit
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xDB, bytes([0]) + bytes([8] * 64)),
            segment(0xC0, struct.pack(">BHHBBBB", 8, side * 8, side * 8, 1, 1, 0x11, 0)),
            segment(0xC4, dc),
            segment(0xC4, ac),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


@lru_cache
def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """The 10 bits of each DC difference -255 .. 255 (at + 255), and the difference of each 10 bits."""
    code, bits, by_category = 0, 1, {}
    for category in range(8, -1, -1):  # canonical codes: lengths 1 .. 9
        by_category[category] = (code, bits)
        code, bits = (code + 1) << 1, bits + 1
    to = np.zeros(511, np.uint16)
    back = np.zeros(1024, np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << c) - 1
        word = (by_category[c][0] << c | extra) << 1
        to[d + 255] = word
        back[word] = d
    return to, back


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of a payload whose length is a multiple of FRAME."""
    levels = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16) - 128
    diffs = np.diff(levels, axis=1, prepend=np.zeros((len(levels), 1), np.int16))
    w = block_codes()[0][diffs + 255].reshape(len(levels), -1, 4)
    out = np.empty((*w.shape[:2], 5), np.uint8)  # four blocks of 10 bits are five bytes
    out[..., 0] = w[..., 0] >> 2
    out[..., 1] = (w[..., 0] & 3) << 6 | w[..., 1] >> 4
    out[..., 2] = (w[..., 1] & 15) << 4 | w[..., 2] >> 6
    out[..., 3] = (w[..., 2] & 63) << 2 | w[..., 3] >> 8
    out[..., 4] = w[..., 3] & 255
    rows, n, head = out.tobytes(), FRAME * 10 // 8, jpeg_head()
    return [head + rows[i : i + n].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(rows), n)]


def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], side: int = SIDE, rate: int = RATE) -> bytes:
    """An AVI file of motion-JPEG frames with an idx1 index."""
    pixels, n, most = side * 8, len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, n, 0, 1, most, pixels, pixels, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, n, most, 0xFFFFFFFF, 0, 0, 0, pixels, pixels)
    strf = struct.pack("<IiiHH4sIiiII", 40, pixels, pixels, 1, 24, b"MJPG", pixels * pixels * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body, index, at = [], [], 4
    for f in frames:
        body.append(c := chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(body)) + chunk(b"idx1", b"".join(index)))


def riff_chunks(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the chunks in data[lo:hi]; a list's kind is LIST and its type."""
    while lo + 8 <= hi:
        kind, n = data[lo : lo + 4], struct.unpack_from("<I", data, lo + 4)[0]
        end = min(lo + 8 + n, hi)
        if kind in (b"RIFF", b"LIST"):
            yield kind + data[lo + 8 : lo + 12], lo + 12, end
        else:
            yield kind, lo + 8, end
        lo += 8 + n + (n & 1)


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the video frames in order, by the index where there is one."""
    rate, movi, index = float(RATE), None, None
    if data[:4] != b"RIFF":
        raise ValueError("not an AVI file")
    for kind, lo, hi in riff_chunks(data, 0, len(data)):
        if kind != b"RIFFAVI ":
            raise ValueError("not an AVI file")
        for kind, a, b in riff_chunks(data, lo, hi):
            if kind == b"LISThdrl":
                for kind, c, _ in riff_chunks(data, a, b):
                    if kind == b"avih":
                        rate = 1e6 / max(1, struct.unpack_from("<I", data, c)[0])
            elif kind == b"LISTmovi":
                movi = (a, b)
            elif kind == b"idx1":
                index = np.frombuffer(data[a : b - (b - a) % 16], [("kind", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    if movi is None:
        return rate, []
    if index is None:
        return rate, [data[a:b] for kind, a, b in riff_chunks(data, *movi) if kind[2:] in (b"dc", b"db")]
    base = movi[0] - 4
    if len(index) and data[base + int(index["at"][0]) :][:4] != index["kind"][0]:
        base = 0  # offsets from the start of the file
    return rate, [data[base + at + 8 : base + at + 8 + size] for kind, at, size in zip(index["kind"].tolist(), index["at"].tolist(), index["size"].tolist()) if kind[2:] in (b"dc", b"db")]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Block levels, one byte for each 8 x 8 block, of each frame in order."""
    head, n = jpeg_head(), FRAME * 10 // 8
    scans = [f[len(head) : -2].replace(b"\xff\x00", b"\xff") if f.startswith(head) and f.endswith(b"\xff\xd9") else b"" for f in frames]
    own = [i for i, s in enumerate(scans) if len(s) == n]
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(frames)
    if own:
        b = np.frombuffer(b"".join(scans[i] for i in own), np.uint8).reshape(len(own), -1, 5).astype(np.uint16)
        w = np.empty((*b.shape[:2], 4), np.uint16)
        w[..., 0] = b[..., 0] << 2 | b[..., 1] >> 6
        w[..., 1] = (b[..., 1] & 63) << 4 | b[..., 2] >> 4
        w[..., 2] = (b[..., 2] & 15) << 6 | b[..., 3] >> 2
        w[..., 3] = (b[..., 3] & 3) << 8 | b[..., 4]
        levels = (np.cumsum(block_codes()[1][w.reshape(len(own), -1)], axis=1, dtype=np.int16) + 128).astype(np.uint8)
        for i, x in zip(own, levels):
            out[i] = x
    for i in sorted(set(range(len(frames))) - set(own)):
        if not frames[i] and i:
            out[i] = out[i - 1]
            continue
        pixels = decode_jpeg(frames[i])
        h, w = pixels.shape[0] // 8 * 8, pixels.shape[1] // 8 * 8
        out[i] = np.rint(pixels[:h, :w].reshape(h // 8, 8, w // 8, 8).mean((1, 3))).astype(np.uint8).ravel()
    return out


@lru_cache
def cosines() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    return basis


@lru_cache
def diagonal_order() -> list[int]:
    """Natural position of each coefficient of a scan: along the anti-diagonals, turning at the edges."""
    cells = sorted(((y + x, x if (y + x) % 2 == 0 else y, y * 8 + x) for y in range(8) for x in range(8)))
    return [c for _, _, c in cells]


#: fixed values: the standard Huffman tables, for frames without their own: codes of each length from 1, and the
#: symbols in order of their codes; those of AC tables that are not listed follow in ascending order.
STANDARD = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1), bytes(range(12))),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1), bytes(range(12))),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")),
}


def codes_of(counts: Iterable[int], symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbols by (length, code) of a canonical Huffman table."""
    codes, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            codes[bits, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return codes


@lru_cache
def standard_codes() -> dict[int, dict[tuple[int, int], int]]:
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    whole = lambda kind, listed: listed + bytes(sorted(set(every) - set(listed))) if kind & 0x10 else listed
    return {kind: codes_of(counts, whole(kind, symbols)) for kind, (counts, symbols) in STANDARD.items()}


def decode_jpeg(data: bytes) -> np.ndarray:
    """Luma pixels of a baseline JPEG of one component or more."""
    quant: dict[int, np.ndarray] = {}
    huff = dict(standard_codes())
    at, height, width, restart = 2, 0, 0, 0
    parts: dict[int, tuple[int, int, int]] = {}  # component: across, down, quantiser
    scan: list[tuple[int, int, int]] = []
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while at + 4 <= len(data) and not scan:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            height, width, n = struct.unpack_from(">HHB", body, 1)
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                huff[body[0]] = codes_of(counts, body[17:])
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames are decoded")
    if not parts or not scan or any(c not in parts for c, _, _ in scan):
        raise ValueError("a frame without a scan")
    luma = next(iter(parts))
    if all(c != luma for c, _, _ in scan):
        raise ValueError("the first scan has no luma")
    most_across, most_down = max(a for a, _, _ in parts.values()), max(d for _, d, _ in parts.values())
    alone = len(scan) == 1  # a scan of one component has no padding blocks
    across, down, table = parts[luma]
    wide, high = -(-width * across // most_across), -(-height * down // most_down)
    if alone:
        cols, rows = -(-wide // 8), -(-high // 8)
        units, row_units, shape = cols * rows, cols, {luma: (1, 1)}
    else:
        row_units, col_units = -(-width // (8 * most_across)), -(-height // (8 * most_down))
        cols, rows, units = row_units * across, col_units * down, row_units * col_units
        shape = {c: parts[c][:2] for c, _, _ in scan}
    bits = b"".join(split_scan(data[at:]))
    stream = np.unpackbits(np.frombuffer(bits, np.uint8)).tolist()
    pos, before, order = 0, {c: 0 for c, _, _ in scan}, diagonal_order()
    coefficients = np.zeros((rows * cols, 64))

    def symbol(codes: dict[tuple[int, int], int]) -> int:
        nonlocal pos
        code = 0
        for n in range(1, 17):
            code = code << 1 | stream[pos]
            pos += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def extra(n: int) -> int:
        nonlocal pos
        v = 0
        for _ in range(n):
            v = v << 1 | stream[pos]
            pos += 1
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    try:
        for unit in range(units):
            if restart and unit and unit % restart == 0:
                pos, before = -(-pos // 8) * 8, dict.fromkeys(before, 0)
            for c, dc, ac in scan:
                h, v = shape[c]
                for j in range(h * v):
                    block = np.zeros(64)
                    before[c] += extra(symbol(huff[dc]))
                    block[0] = before[c]
                    k = 1
                    while k < 64:
                        s = symbol(huff[ac])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = extra(s & 15)
                        k += 1
                    if c == luma:
                        place = (unit // row_units * v + j // h) * cols + unit % row_units * h + j % h
                        coefficients[place, order] = block * quant[table]
    except (IndexError, KeyError):
        raise ValueError("the scan ends early or names a table that is not there") from None
    c = cosines()
    blocks = c @ coefficients.reshape(-1, 8, 8) @ c.T + 128
    pixels = blocks.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
    return np.clip(np.rint(pixels[:high, :wide]), 0, 255).astype(np.uint8)


def split_scan(scan: bytes) -> list[bytes]:
    """Scan data without stuffing, restart marks and what follows the scan."""
    out, lo, i = [], 0, 0
    while (i := scan.find(b"\xff", i)) >= 0 and i + 1 < len(scan):
        if scan[i + 1] == 0:
            i += 2
        elif 0xD0 <= scan[i + 1] <= 0xD7:
            out.append(scan[lo:i])
            lo = i = i + 2
        else:
            scan = scan[:i]
            break
    return [p.replace(b"\xff\x00", b"\xff") for p in [*out, scan[lo:]]]


def histograms(levels: np.ndarray) -> np.ndarray:
    """A histogram of 16 bins for each row."""
    bins = 256 >> BIN_SHIFT
    at = (levels >> BIN_SHIFT).astype(np.int64) + np.arange(len(levels))[:, None] * bins
    return np.bincount(at.ravel(), minlength=len(levels) * bins).reshape(len(levels), bins)


def shots(diffs: list[float], blocks: int) -> list[int]:
    """First frames of shots; diffs[i] is the histogram distance of frames i and i + 1."""
    starts, n, mean, m2 = [0], 0, 0.0, 0.0
    for i, d in enumerate(diffs):
        deviation = (m2 / n) ** 0.5 if n else 0.0
        if d > CUT_LEAST * blocks and d > mean + CUT_DEVIATIONS * deviation:
            starts.append(i + 1)
            n, m2 = 0, 0.0  # the mean stays until the new shot has one of its own
            continue
        n += 1
        mean = mean if n > 1 else d
        step = d - mean
        mean += step / n
        m2 += step * (d - mean)
    return starts


def clips(data: bytes) -> list[tuple[float, float, int]]:
    """(start, end, frames) of each shot of an AVI file, in seconds."""
    rate, frames = read_avi(data)
    return timed(decode_frames(frames), rate)


def timed(levels: list[np.ndarray], rate: float) -> list[tuple[float, float, int]]:
    if not levels:
        return []
    h = np.concatenate([histograms(x[None]) for x in levels]) if len({len(x) for x in levels}) > 1 else histograms(np.stack(levels))
    starts = shots((np.abs(np.diff(h, axis=0)).sum(1) / 2).tolist(), len(levels[0]))
    return [(a / rate, b / rate, b - a) for a, b in zip(starts, [*starts[1:], len(levels)])]


def padded(data: bytes) -> bytes:
    """The bytes with PAD up to a positive multiple of FRAME."""
    return data + bytes([PAD]) * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def feature(levels: list[np.ndarray], rate: float) -> str:
    """Frames, mean level, and each clip's start, end and frames."""
    total = sum(int(x.sum(dtype=np.int64)) for x in levels)
    mean = total / max(1, sum(map(len, levels)))
    return f"frames={len(levels)};mean={mean:.3f};clips=" + ",".join(f"{a:.2f}-{b:.2f}:{n}" for a, b, n in timed(levels, rate))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and the AVI file of each text in the binary column ``media``."""

    def run(batches):
        for b in chunks(batches):
            media = [write_avi(encode_frames(padded(t))) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    return text_rows(docs, "doc_id").mapInArrow(tidied(run), "doc_id long, media binary")


def clips_or_error(data: bytes) -> tuple[list[tuple[float, float, int]], str | None]:
    """The clips of a file, or none and why it cannot be read."""
    try:
        return clips(data), None
    except (ValueError, IndexError, KeyError, struct.error) as e:
        return [], f"{type(e).__name__}: {e}"


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, frames and error: a row for each shot of the AVI files in ``media``; for a file that cannot be read one row with the error."""
    kinds = {"doc_id": pa.int64(), "clip": pa.int64(), "start_s": pa.float64(), "end_s": pa.float64(), "frames": pa.int64(), "error": pa.string()}

    def run(batches):
        for b in chunks(batches, column="media"):
            rows = []
            for d, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                found, error = clips_or_error(m) if m is not None else ([], None)
                rows += [(d, i, *c, None) for i, c in enumerate(found)] + [(d, None, None, None, None, error)] * (error is not None)
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(tidied(run), "doc_id long, clip long, start_s double, end_s double, frames long, error string")


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each text as an AVI file, reads the file back and gives digests and features of what was read."""

    def run(batches):
        for b in chunks(batches, 1 << 20):
            out = []
            for text in texts(b):
                stored = write_avi(encode_frames(padded(text)))
                rate, frames = read_avi(stored)
                levels = decode_frames(frames)
                payload = b"".join(x.tobytes() for x in levels)
                out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(levels, rate)))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", *names])

    return text_rows(docs, "doc_id").mapInArrow(tidied(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
