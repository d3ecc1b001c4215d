import hashlib
import struct
import zlib

import numpy as np
import pytest

from trawl.llm import progressive_jpeg as pj

RNG = np.random.default_rng(6)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 3000, 60_000])
def test_payloads_come_back(n):
    body = RNG.bytes(n)
    media = pj.encode(pj.pad(body), n)
    image = pj.decode(media)
    assert pj.payload(image) == (pj.pad(body), n)
    slow = pj.decode(media, fast=False)
    for c in image.components:
        assert (image.components[c].coefficients == slow.components[c].coefficients).all()
    assert pj.rgb(image).shape == (image.height, image.width, 3)


class Writer:
    """A plain bit-by-bit writer of scans with 8-bit codes for every symbol below 255."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        return np.packbits(self.bits + [1] * (-len(self.bits) % 8)).tobytes()


def scalar_jpeg(blocks, height, width):
    """A grey progressive JPEG of zigzag blocks: DC and AC in two approximations, with runs of ends and of zeros."""
    symbols = list(range(255))
    out = [b"\xff\xd8", pj._segment(0xDB, bytes([0, *range(1, 65)])), pj._segment(0xC2, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))]
    out += [pj._table(0, symbols, 8), pj._table(1, symbols, 8)]
    w, last = Writer(), 0
    for b in blocks:
        step = (int(b[0]) >> 1) - last
        last += step
        w.put(abs(step).bit_length(), 8)
        w.number(step)
    out.append(pj._scan((1,), 0, 0, 0, 1, w.data()))
    trunc = lambda v: int(np.sign(v)) * (abs(int(v)) >> 1)
    for lo, hi in ((1, 20), (21, 63)):
        w, ends = Writer(), 0

        def flush(w):
            nonlocal ends
            if ends:
                n = ends.bit_length() - 1
                w.put(n << 4, 8)
                w.put(ends - (1 << n), n)
                ends = 0

        for b in blocks:
            zeros = 0
            for k in range(lo, hi + 1):
                v = trunc(b[k])
                if not v:
                    zeros += 1
                    continue
                flush(w)
                while zeros > 15:
                    w.put(0xF0, 8)
                    zeros -= 16
                w.put(zeros << 4 | abs(v).bit_length(), 8)
                w.number(v)
                zeros = 0
            if zeros:
                ends += 1
        flush(w)
        out.append(pj._scan((1,), lo, hi, 0, 1, w.data()))
    w = Writer()
    for b in blocks:  # one band; an end of each block on its own
        values = [int(v) for v in b]
        fresh = [k for k in range(1, 64) if abs(values[k]) == 1]
        k = 1
        for at in fresh:
            zeros, correct = 0, []
            while k < at:
                if abs(values[k]) > 1:
                    correct.append(abs(values[k]) & 1)
                else:
                    zeros += 1
                    if zeros == 16:
                        w.put(0xF0, 8)
                        [w.put(c, 1) for c in correct]
                        zeros, correct = 0, []
                k += 1
            w.put(zeros << 4 | 1, 8)
            w.put(int(values[at] > 0), 1)
            [w.put(c, 1) for c in correct]
            k = at + 1
        if k < 64:
            w.put(0, 8)
            [w.put(abs(values[j]) & 1, 1) for j in range(k, 64) if abs(values[j]) > 1]
    out.append(pj._scan((1,), 1, 63, 1, 0, w.data()))
    w = Writer()
    [w.put(int(b[0]) & 1, 1) for b in blocks]
    out.append(pj._scan((1,), 0, 0, 1, 0, w.data()))
    return b"".join([*out, b"\xff\xd9"])


def test_sparse_scans_symbol_by_symbol():
    blocks = np.where(RNG.random((12, 64)) < 0.15, RNG.integers(-40, 41, (12, 64)), 0)
    blocks[3] = 0
    blocks[:, 0] = RNG.integers(-200, 200, 12)
    image = pj.decode(scalar_jpeg(blocks, 24, 32))
    assert (image.components[1].coefficients == blocks).all()
    picture = pj.rgb(image)
    want = np.zeros((24, 32))
    for n, b in enumerate(blocks):
        block = np.zeros(64)
        block[pj.ZIGZAG] = b * np.arange(1, 65)
        block = block.reshape(8, 8)
        for y in range(8):
            for x in range(8):
                scale = np.where(np.arange(8) == 0, np.sqrt(0.5), 1)
                base = np.outer(scale * np.cos((2 * y + 1) * np.arange(8) * np.pi / 16), scale * np.cos((2 * x + 1) * np.arange(8) * np.pi / 16))
                want[n // 4 * 8 + y, n % 4 * 8 + x] = (block * base).sum() / 4 + 128
    assert np.abs(picture[:, :, 0] - np.clip(want, 0, 255)).max() <= 1


def test_query_columns(spark):
    rows = [(1, "héllo " * 300, "x"), (2, None, "x"), (3, "", None), (4, "héllo " * 300, "y"), (None, "z" * 576, "y"), (4, "héllo " * 300, "y"), (6, "long " * 50_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = pj.features(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        body = pj.pad((text or "").encode())
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))
        media = pj.encode(body, r.n_bytes)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert tuple(by[1])[1:] == tuple(by[4])[1:] and tuple(by[2])[1:] == tuple(by[3])[1:]
    tensors = pj.tensors(pj.store(docs)).collect()
    assert all(len(t.pixels) == 3 * t.height * t.width for t in tensors)
    assert {t.doc_id: f"{t.height}x{t.width}:{zlib.crc32(t.pixels):08x}" for t in tensors} == {r.doc_id: r.feature.rsplit(":", 1)[0] for r in got}
    assert pj.features(docs.limit(0)).count() == 0
