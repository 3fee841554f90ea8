import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tephra.llm import avi

from .helpers import empty, frame


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=700), st.integers(0, 9000).map(lambda n: b"\xff" * n), st.integers(0, 9000).map(lambda n: bytes(i * 7 % 256 for i in range(n)))))
def test_round_trip(data):
    media = avi.write_avi(avi.pad(data))
    back, _ = avi.features(media)
    assert back == avi.pad(data) and len(back) % 192 == 0 and len(back) > 0


def test_general_decoder_agrees():
    data = avi.pad(bytes(np.random.default_rng(1).integers(0, 256, 4000, dtype=np.uint8)))
    for raw in avi.read_avi(avi.write_avi(data)).frames:
        frame = avi.parse_jpeg(raw)
        marks = np.flatnonzero(np.r_[False, (frame.scan[:-1] == 255) & (frame.scan[1:] >= 0xD0) & (frame.scan[1:] <= 0xD7)])
        assert (avi._general(frame, frame.scan, marks) == avi.coefficients(frame)).all()


def still(level: int, size: int = 16) -> bytes:
    """A grey picture in ordinary baseline JPEG: one component, run-length codes, no restarts."""
    code = {0: "00", 8: "01", 7: "10", 6: "110", 5: "1110", 4: "11110", 3: "111110", 2: "1111110", 1: "11111110"}
    order = sorted(code, key=lambda k: (len(code[k]), code[k]))
    counts = [sum(len(c) == n for c in code.values()) for n in range(1, 17)]
    huff = avi._segment(0xC4, b"\x00" + bytes(counts) + bytes(order)) + avi._segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    bits, last = "", 0
    for _ in range((size // 8) ** 2):
        d = level - last
        last = level
        n = abs(d).bit_length()
        bits += code[n] + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    return b"\xff\xd8" + avi._segment(0xDB, b"\x00" + b"\x08" * 64) + avi._segment(0xC0, struct.pack(">BHHB", 8, size, size, 1) + bytes([1, 0x11, 0])) + huff + avi._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"


def test_ordinary_frames_are_decoded():
    frame = avi.parse_jpeg(still(40))
    blocks = avi.coefficients(frame)
    assert blocks.shape == (4, 64) and (blocks[:, 0] == 40).all() and not blocks[:, 1:].any()
    hist = avi.luma_histograms([frame], [blocks])
    assert hist[0].argmax() == (128 + 40) // 8 and hist[0].max() == 1.0


def test_shots_are_found():
    g = np.random.default_rng(2)
    dark = [np.eye(8)[0] + g.random(8) * 0.01 for _ in range(10)]
    light = [np.eye(8)[5] + g.random(8) * 0.01 for _ in range(7)]
    assert avi.shots(np.array(dark + light)) == [(0, 10), (10, 17)]
    assert avi.shots(np.array(dark)) == [(0, 10)] and avi.shots(np.zeros((0, 8))) == []


def test_early_cuts_and_short_scenes_are_found():
    g = np.random.default_rng(3)
    scene = lambda *bins: np.array([np.eye(8)[b] + g.random(8) * 0.01 for b in bins])
    assert avi.shots(scene(0, 5, 5, 5)) == [(0, 1), (1, 4)]
    assert avi.shots(scene(0, 5)) == [(0, 1), (1, 2)]
    assert avi.shots(scene(0, 0, 5, 5)) == [(0, 2), (2, 4)]
    assert avi.shots(scene(0, 5, 2, 2, 6, 1)) == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 6)]
    assert avi.shots(scene(0, 0, 0)) == [(0, 3)]


def test_index_is_used_and_may_be_missing():
    media = avi.write_avi(avi.pad(b"some text " * 2000))
    video = avi.read_avi(media)
    bare = media[: media.rindex(b"idx1")]
    assert len(video.frames) > 3 and [bytes(f) for f in avi.read_avi(bare).frames] == [bytes(f) for f in video.frames]
    with pytest.raises(ValueError):
        avi.read_avi(b"no file at all, but long enough")


def test_awkward_rows_and_clips(spark):
    docs = frame(spark)
    got = avi.store(docs)
    rows = got.collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        want = avi.pad(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (1, 2)}) == 1
    clips = avi.clips(got).collect()
    by = {}
    for c in clips:
        by.setdefault(c["doc_id"], []).append(c)
    assert by[7][0]["start_frame"] == 0 and by[7][-1]["end_s"] == pytest.approx(by[7][-1]["end_frame"] / 10)
    assert avi.store(empty(spark)).count() == 0


def test_the_standard_tables():
    """Each holds every symbol once, as many as its codes, and its codes fit."""
    for key, (counts, symbols) in avi.STANDARD.items():
        want = set(range(12)) if key < 16 else {0x00, 0xF0} | {run << 4 | size for run in range(16) for size in range(1, 11)}
        assert sum(counts) == len(symbols) == len(set(symbols)) and set(symbols) == want
        assert sum(n / 2**length for length, n in enumerate(counts, 1)) < 1


def test_frames_without_huffman_tables():
    """The usual motion-JPEG frame: two blocks of luma, coded with the standard's tables, that it doesn't hold itself."""
    codes = {}
    for key in (0, 16):
        code, at = 0, 0
        for length, n in enumerate(avi.STANDARD[key][0], 1):
            for _ in range(n):
                codes[key, avi.STANDARD[key][1][at]] = format(code, f"0{length}b")
                code, at = code + 1, at + 1
            code <<= 1
    bits = codes[0, 5] + format(20, "05b") + codes[16, 0x12] + "10" + codes[16, 0xF0] + codes[16, 0x01] + "0" + codes[16, 0] + codes[0, 0] + codes[16, 0]
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    raw = b"\xff\xd8" + avi._segment(0xDB, b"\x00" + b"\x08" * 64) + avi._segment(0xC0, struct.pack(">BHHB", 8, 8, 16, 1) + bytes([1, 0x11, 0])) + avi._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    blocks = avi.coefficients(avi.parse_jpeg(raw))
    want = np.zeros((2, 64), int)
    want[:, 0], want[0, 2], want[0, 19] = 20, 2, -1
    assert (blocks == want).all()


def test_frames_in_rec_lists():
    media = bytes(avi.write_avi(avi.pad(b"some text " * 900)))
    video = avi.read_avi(media)
    frames = [bytes(f) for f in video.frames]
    inner = b"".join(avi._list(b"rec ", avi._chunk(b"00dc", f)) for f in frames)
    at = media.index(b"hdrl") - 8
    head = media[at : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]
    body = b"AVI " + head + avi._list(b"movi", inner)
    assert [bytes(f) for f in avi.read_avi(b"RIFF" + struct.pack("<I", len(body)) + body).frames] == frames


def test_features_by_an_independent_decoder():
    """The feature string told from the payload alone: the coefficients, their pixels by a plain inverse transform, and the cuts."""
    data = avi.pad(b"a" * 9000 + bytes(range(256)) * 24 + b"zz z" * 3000)
    back, feature = avi.features(avi.write_avi(data))
    assert back == data
    per_frame = 16 * 192
    cos = [[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)]
    hists = []
    for at in range(0, len(data), per_frame):
        part = data[at : at + per_frame].ljust(per_frame, b" ")
        hist = np.zeros(32)
        for unit in range(16):
            values = [v if v >= 128 else v - 255 for v in part[unit * 192 : unit * 192 + 64]]  # the first component, in zigzag order
            grid = np.zeros((8, 8))
            for k, v in enumerate(values):
                grid[divmod(int(avi.ZIGZAG[k]), 8)] = v
            pixels = np.clip(np.array(cos).T @ grid @ np.array(cos) + 128, 0, 255)
            hist += np.bincount(pixels.astype(np.uint8).reshape(-1) >> 3, minlength=32)
        hists.append(hist / hist.sum())
    cut = avi.shots(np.array(hists))
    clips = ",".join(f"{a / 10:.2f}-{b / 10:.2f}" for a, b in cut)
    assert len(cut) > 1 and feature == f"64x16;frames={len(hists)};fps=10;shots={len(cut)};clips={clips}"


def test_a_long_text_needs_little_more_than_itself():
    import tracemalloc

    data = avi.pad(bytes(range(256)) * 40_000)
    tracemalloc.start()
    media = avi.write_avi(data)
    back, _ = avi.features(media)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back == data and peak < 5 * len(data)
