"""Media columns: AVI motion-JPEG files made, parsed, decoded and cut into shots.

Writing: the payload's bytes become quantised coefficients of baseline JPEG frames, three 8 x 8 blocks (192 bytes) to a unit. Every
coefficient has size class 8, so its eight extra bits are the payload's byte, and the one Huffman code is a zero bit; nothing is lost. Each
unit is a restart interval. Reading: RIFF chunks and the idx1 index give the frames, the frames' own tables decode them.
The sample that is stored is thus the format's unit, the quantised coefficient; pixels come by the inverse transform.

Shots: luma histograms of successive frames are compared; a cut is where the difference exceeds the mean plus `k` deviations of the
differences in a window before it. Rows of clips carry times.

Frames without Huffman tables, as motion-JPEG files often have them, are decoded by the standard's. Frames in `rec ` lists are found; of an OpenDML file the
first RIFF chunk is read. Files are written and read frame by frame: beside the payload and the file, only a few frames are held.

Rules for odd input: a null text is empty; an empty text has one unit of spaces; equal texts give equal files; repeated rows are
stored each; an empty table gives an empty result; long texts become many frames.
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

from .common import as_bytes

UNIT = 192
UNITS = 16  # in a frame at most: 64 x 16 pixels, 3,072 bytes
FPS = 10
TOGETHER = 64  # frames written at once
#: Fixed values of the JPEG standard: the zigzag order of an 8 x 8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Fixed values of the JPEG standard, annex K: Huffman tables by class and number (0 and 1 for luma, chroma; 16 more for the AC ones), as the numbers of codes of each length and the symbols.
_TAIL = "43-4a 53-5a 63-6a 73-7a"
_STANDARD = {
    0: ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "00-0b"),
    1: ("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "00-0b"),
    16: (
        "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125",
        "01-03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16-1a 25-2a 34-3a "
        + _TAIL + " 83-8a 92-9a a2-aa b2-ba c2-ca d2-da e1-ea f1-fa",
    ),
    17: (
        "0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119",
        "00-03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17-1a 26-2a 35-3a "
        + _TAIL + " 82-8a 92-9a a2-aa b2-ba c2-ca d2-da e2-ea f2-fa",
    ),
}


def _table(counts: str, symbols: str) -> tuple[bytes, bytes]:
    spans = [[int(x, 16) for x in part.split("-")] for part in symbols.split()]
    return bytes(map(int, counts.split())), bytes(x for span in spans for x in range(span[0], span[-1] + 1))


STANDARD = {key: _table(*text) for key, text in _STANDARD.items()}


def _idct() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)  # rows in zigzag order


IDCT = _idct()


# --- writing ---------------------------------------------------------------------------------------------------------------


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    quant = _segment(0xDB, b"\x00" + b"\x01" * 64)
    frame = _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
    codes = b"\x01" + b"\x00" * 15 + b"\x08"  # one code, a zero bit: no run, size class 8
    huffman = _segment(0xC4, b"\x00" + codes) + _segment(0xC4, b"\x10" + codes)
    return b"\xff\xd8" + quant + frame + huffman + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, b"\x03" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + b"\x00\x3f\x00")


def _scans(units: np.ndarray) -> list[bytes]:
    """Entropy-coded data of frames; units: frames x units x 192 bytes."""
    frames, n, _ = units.shape
    bits = np.zeros((frames * n, UNIT, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(units.reshape(-1, UNIT, 1), axis=2)
    data = np.packbits(bits.reshape(frames * n, -1), axis=1).reshape(frames, n, 216)
    marks = np.empty((frames, n, 2), np.uint8)
    marks[:, :, 0] = 0xFF
    marks[:, :, 1] = 0xD0 + np.arange(n) % 8
    stuffed = np.zeros((frames, n, 217 * 2), np.uint8)
    keep = np.zeros(stuffed.shape, bool)
    stuffed[:, :, 0:432:2] = data
    keep[:, :, 0:432:2] = True
    keep[:, :, 1:432:2] = data == 0xFF  # a zero byte follows
    stuffed[:, :, 432:] = marks
    keep[:, :-1, 432:] = True  # no restart mark after the last unit
    return [stuffed[i][keep[i]].tobytes() for i in range(frames)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(payload: bytes) -> bytes:
    """A motion-JPEG AVI file of a payload, whose length is a positive multiple of 192."""
    total = len(payload) // UNIT
    side = min(total, UNITS)
    across = min(side, 8)
    down = -(-side // across)
    n = across * down
    frames = -(-total // n)
    head = _frame_head(8 * across, 8 * down)
    movi, index, largest = bytearray(b"movi"), bytearray(), 0
    for first in range(0, frames, TOGETHER):
        some = min(TOGETHER, frames - first)
        data = np.full(some * n * UNIT, 32, np.uint8)
        part = np.frombuffer(payload, np.uint8, min(len(data), len(payload) - first * n * UNIT), first * n * UNIT)
        data[: len(part)] = part
        for scan in _scans(data.reshape(some, n, UNIT)):
            size = len(head) + len(scan) + 2
            index += struct.pack("<4sIII", b"00dc", 0x10, len(movi), size)
            movi += b"00dc" + struct.pack("<I", size) + head + scan + b"\xff\xd9" + b"\x00" * (size & 1)
            largest = max(largest, size)
    width, height = 8 * across, 8 * down
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload=%d" % len(payload)))
    size = 4 + len(hdrl) + len(info) + 8 + len(movi) + 8 + len(index)
    out = bytearray(b"RIFF" + struct.pack("<I", size) + b"AVI " + hdrl + info + b"LIST" + struct.pack("<I", len(movi)))
    out += movi
    out += b"idx1" + struct.pack("<I", len(index)) + index
    return out


# --- reading ---------------------------------------------------------------------------------------------------------------


@dataclass
class Video:
    rate: float
    width: int
    height: int
    frames: list[memoryview]
    payload_bytes: int | None


def _chunks(data: memoryview, at: int, end: int):
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield bytes(data[at : at + 4]), at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def _in_movi(data: memoryview, at: int, end: int):
    """The chunks of a movi list, those of its `rec ` lists included."""
    for name, a, b in _chunks(data, at, end):
        if name == b"LIST" and bytes(data[a : a + 4]) == b"rec ":
            yield from _in_movi(data, a + 4, b)
        else:
            yield name, a, b


def read_avi(raw: bytes) -> Video:
    """Frames by the file's index, or by its movi list if there is none."""
    data = memoryview(raw)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    rate, width, height, payload, movi, index = float(FPS), 0, 0, None, None, None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        for name, a, b in _chunks(data, *todo.pop()):
            if name == b"LIST":
                if bytes(data[a : a + 4]) == b"movi":
                    movi = (a, b)
                elif bytes(data[a : a + 4]) != b"rec ":
                    todo.append((a + 4, b))
            elif name == b"avih":
                rate, (width, height) = 1e6 / struct.unpack_from("<I", data, a)[0], struct.unpack_from("<II", data, a + 32)
            elif name == b"ICMT" and bytes(data[a : a + 8]) == b"payload=":
                payload = int(bytes(data[a + 8 : b]).rstrip(b"\0"))
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, i) for i in range(a, b - 15, 16)]
    if movi is None:
        raise ValueError("no movi list")
    if index:
        base = movi[0] if bytes(data[movi[0] + index[0][2] : movi[0] + index[0][2] + 4]) == index[0][0] else 0  # some files count from the file's start
        frames = [data[base + at + 8 : base + at + 8 + size] for name, _, at, size in index if name[2:] in (b"dc", b"db")]
    else:
        frames = [data[a:b] for name, a, b in _in_movi(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return Video(rate, width, height, frames, payload)


@dataclass
class Frame:
    width: int
    height: int
    quant: dict[int, np.ndarray]
    parts: list[tuple[int, int, int]]  # id, quantisation table, sampling
    huffman: dict[int, tuple[bytes, bytes]]
    restart: int
    scan: np.ndarray
    tables: list[tuple[int, int]]


def parse_jpeg(raw) -> Frame:
    data = memoryview(raw)
    if bytes(data[:2]) != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, huffman, restart, parts, width, height = 2, {}, {}, 0, [], 0, 0
    while True:
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.float32)
                i += 1 + 64 * (1 + wide)
        elif mark == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[8 + 3 * i], body[7 + 3 * i]) for i in range(n)]
        elif mark in (0xC1, 0xC2, 0xC3):
            raise ValueError("only baseline frames are decoded")
        elif mark == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                huffman[body[i]] = bytes(body[i + 1 : i + 17]), bytes(body[i + 17 : i + 17 + n])
                i += 17 + n
        elif mark == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif mark == 0xDA:
            n = body[0]
            tables = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            scan = np.frombuffer(data[at:], np.uint8)
            end = len(scan) - 2 if bytes(scan[-2:]) == b"\xff\xd9" else len(scan)
            return Frame(width, height, quant, parts, huffman, restart, scan[:end], tables)


ONE_CODE = (b"\x01" + b"\x00" * 15, b"\x08")


def coefficients(frame: Frame) -> np.ndarray:
    """Quantised coefficients, blocks x 64 in zigzag order, blocks in the order of the scan."""
    scan = frame.scan
    follows = np.zeros(len(scan), bool)
    follows[1:] = scan[:-1] == 0xFF
    mark = follows & (scan >= 0xD0) & (scan <= 0xD7)
    fixed = frame.restart == 1 and all(s == 0x11 for _, _, s in frame.parts) and len(frame.parts) == 3 and all(frame.huffman.get(k) == ONE_CODE for k in (0, 16))
    if fixed:  # every code has nine bits
        drop = (follows & (scan == 0)) | mark
        drop[:-1] |= mark[1:]
        bits = np.unpackbits(scan[~drop].reshape(-1, 216), axis=1).reshape(-1, UNIT, 9)
        value = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int32).reshape(-1, 64)
        return np.where(value < 128, value - 255, value)
    return _general(frame, scan, np.flatnonzero(mark))


def _general(frame: Frame, scan: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Any baseline Huffman scan, bit by bit."""
    lookup = {}
    for key, (counts, symbols) in {**STANDARD, **frame.huffman}.items():
        code, k, table = 0, 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        lookup[key] = table
    per_unit = [i for i, (_, _, s) in enumerate(frame.parts) for _ in range((s >> 4) * (s & 15))]
    across = -(-frame.width // (8 * max(s >> 4 for _, _, s in frame.parts)))
    down = -(-frame.height // (8 * max(s & 15 for _, _, s in frame.parts)))
    units, out = across * down, []
    edges = [0, *(int(m) + 1 for m in marks)]
    pieces = [bytes(scan[a : (edges[i + 1] - 2 if i + 1 < len(edges) else len(scan))]).replace(b"\xff\x00", b"\xff") for i, a in enumerate(edges)]
    for i, piece in enumerate(pieces):
        bits, at = np.unpackbits(np.frombuffer(piece, np.uint8)).tolist(), 0
        dc = [0] * len(frame.parts)

        def symbol(table):
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code << 1 | bits[at]
                at += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("bad code")

        def extra(n):
            nonlocal at
            v = 0
            for _ in range(n):
                v = v << 1 | bits[at]
                at += 1
            return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v

        for _ in range(min(frame.restart or units, units - i * frame.restart)):
            for c in per_unit:
                block = [0] * 64
                dc[c] += extra(symbol(lookup[frame.tables[c][0]]))
                block[0], k = dc[c], 1
                while k < 64:
                    rs = symbol(lookup[16 + frame.tables[c][1]])
                    if rs == 0:
                        break
                    k += rs >> 4
                    if rs & 15:
                        block[k] = extra(rs & 15)
                    k += 1
                out.append(block)
    return np.array(out, np.int32)


def payload(blocks: np.ndarray) -> bytes:
    """The bytes that write_avi stored in a frame."""
    return np.where(blocks < 0, blocks + 255, blocks).astype(np.uint8).tobytes()


def luma_histogram(f: Frame, b: np.ndarray, bins: int = 32) -> np.ndarray:
    """Shares of the first component's pixels after the inverse transform."""
    per = [(s >> 4) * (s & 15) for _, _, s in f.parts]
    y = b.reshape(-1, sum(per), 64)[:, : per[0]].reshape(-1, 64).astype(np.float32)
    pixels = np.clip((y * f.quant[f.parts[0][1]]) @ IDCT + 128, 0, 255).astype(np.uint8)
    return np.bincount((pixels >> (8 - int(np.log2(bins)))).reshape(-1), minlength=bins) / pixels.size


def luma_histograms(frames: list[Frame], blocks: list[np.ndarray], bins: int = 32) -> np.ndarray:
    return np.array([luma_histogram(f, b, bins) for f, b in zip(frames, blocks, strict=True)]).reshape(-1, bins)


def shots(histograms: np.ndarray, window: int = 8, k: float = 3.0, least: float = 0.05, early: float = 0.3) -> list[tuple[int, int]]:
    """(first, one past last) frame of each shot. A cut's difference exceeds mean + k deviations of up to `window` differences before it in its shot, or `early`
    where there are fewer than two."""
    n = len(histograms)
    cuts, past = [0], []
    for i in range(1, n):
        d = float(np.abs(histograms[i] - histograms[i - 1]).sum()) / 2
        if d > (max(least, np.mean(past) + k * np.std(past)) if len(past) >= 2 else early):
            cuts.append(i)
            past = []
        else:
            past = [*past[-window + 1 :], d]
    return list(zip(cuts, [*cuts[1:], n], strict=True)) if n else []


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


def decode(video: Video):
    """(frame, its coefficients) one after another."""
    for raw in video.frames:
        frame = parse_jpeg(raw)
        yield frame, coefficients(frame)


def features(raw: bytes) -> tuple[bytes, str]:
    """The payload read back, and the feature: size, frames, rate and the timed clips."""
    video, back, histograms = read_avi(raw), bytearray(), []
    for frame, blocks in decode(video):
        back += payload(blocks)
        histograms.append(luma_histogram(frame, blocks))
    del back[video.payload_bytes :]
    cut = shots(np.array(histograms))
    clips = ",".join(f"{a / video.rate:.2f}-{b / video.rate:.2f}" for a, b in cut)
    return back, f"{video.width}x{video.height};frames={len(video.frames)};fps={video.rate:g};shots={len(cut)};clips={clips}"


def clips(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """A row for each shot of each file: key, clip, start_frame, end_frame, start_s, end_s. Null files give none."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw is None:
                    continue
                video = read_avi(raw)
                cuts = shots(np.array([luma_histogram(frame, blocks) for frame, blocks in decode(video)]))
                rows += [(k, i, a, b, a / video.rate, b / video.rate) for i, (a, b) in enumerate(cuts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "clip", "start_frame", "end_frame", "start_s", "end_s"])

    return files.select(F.col(key).cast("long").alias("doc_id"), F.col(media).alias("media")).mapInArrow(run, "doc_id long, clip int, start_frame int, end_frame int, start_s double, end_s double")


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_media: bool = True) -> DataFrame:
    """A row for each document with its digests and, with with_media, the file itself."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                rows = []
                for raw in as_bytes(batch.column(1)).to_pylist():
                    raw = raw or b""
                    media = write_avi(pad(raw))
                    back, feature = features(media)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, bytes(media) if with_media else None))
                columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
