"""The JPEG decoder against an encoder of unit steps and eight-bit codes."""

import numpy as np
import pytest

from rasterspark.functions import jpeg
from rasterspark.functions.codecs import DecodeError
from rasterspark.sources import container

_DC = list(range(12))
_AC = [0, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]


def _coded(table, symbol, value=0, size=0):
    bits = f"{table.index(symbol):08b}"
    return bits + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")


def _encode(planes, factors=None, interval=0, stuff=b""):
    """``planes`` of whole blocks; ``factors`` (h, v) of each."""
    factors = factors or [(1, 1)] * len(planes)
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    height, width = planes[0].shape[0] // factors[0][1] * most_v, planes[0].shape[1] // factors[0][0] * most_h
    part = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    out = b"\xff\xd8" + stuff + part(0xDB, b"\0" + b"\1" * 64)
    out += part(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors)))
    for kind, table in ((0, _DC), (16, _AC)):
        out += part(0xC4, bytes([kind, *[0] * 7, len(table), *[0] * 8]) + bytes(table))
    if interval:
        out += part(0xDD, interval.to_bytes(2, "big"))
    out += part(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + b"\0\x3f\0")
    across, down, bits, before, seen = width // 8 // most_h, height // 8 // most_v, "", [0] * len(planes), 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0")

    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            out, bits, before, seen = out + flush(bits) + bytes([0xFF, 0xD0 + seen % 8]), "", [0] * len(planes), seen + 1
        for k, (h, v) in enumerate(factors):
            for i in range(h * v):
                y, x = (unit // across * v + i // h) * 8, (unit % across * h + i % h) * 8
                block = planes[k][y : y + 8, x : x + 8].astype(float) - 128
                flat = np.rint(jpeg._LEFT.T @ block @ jpeg._LEFT).astype(int).ravel()[jpeg._ZIGZAG].tolist()
                diff, before[k], run = flat[0] - before[k], flat[0], 0
                bits += _coded(_DC, abs(diff).bit_length(), diff, abs(diff).bit_length())
                last = max([p for p in range(1, 64) if flat[p]], default=0)
                for value in flat[1 : last + 1]:
                    if not value:
                        run += 1
                        continue
                    bits += _coded(_AC, 0xF0) * (run // 16)
                    size = abs(value).bit_length()
                    bits += _coded(_AC, run % 16 << 4 | size, value, size)
                    run = 0
                if last < 63:
                    bits += _coded(_AC, 0)
    return out + flush(bits) + b"\xff\xd9"


def _plane(height, width, seed):
    y, x = np.mgrid[:height, :width]
    return np.clip(128 + 80 * np.sin(x / 5 + seed) + 40 * np.cos(y / 3) + np.random.default_rng(seed).normal(0, 6, (height, width)), 0, 255).round()


def test_order_of_the_stream():
    assert jpeg._ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg._ZIGZAG[-3:] == [55, 62, 63]


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_grey(interval):
    plane = _plane(24, 40, 1)
    got = jpeg.decode(_encode([plane], interval=interval, stuff=b"\xff\xe0\0\4ab"))
    assert got.shape == (24, 40, 1) and np.abs(got[:, :, 0] - plane).max() <= 2


def test_colour_and_subsampling():
    y, cb, cr = _plane(32, 32, 2), _plane(16, 16, 3), _plane(16, 16, 4)
    got = jpeg.decode(_encode([y, cb, cr], [(2, 2), (1, 1), (1, 1)]))
    wide = lambda p: p.repeat(2, axis=0).repeat(2, axis=1) - 128
    want = np.stack([y + 1.402 * wide(cr), y - 0.344136 * wide(cb) - 0.714136 * wide(cr), y + 1.772 * wide(cb)], axis=2)
    assert np.abs(got - np.clip(want, 0, 255)).max() <= 6


def test_flat_block_by_hand():
    got = jpeg.decode(_encode([np.full((8, 8), 200)]))
    assert (got == 200).all()


def test_broken_streams_are_errors():
    whole = _encode([_plane(16, 16, 5)])
    for cut in range(0, len(whole) - 2, 7):
        with pytest.raises(DecodeError):
            jpeg.decode(whole[:cut])
    with pytest.raises(DecodeError):
        jpeg.decode(whole.replace(b"\xff\xc0", b"\xff\xc2"))


@pytest.mark.parametrize("compression", [6, 7, 34892])
def test_in_a_container(compression):
    plane = _plane(16, 24, 6)
    data = container.write([{"tags": container.image_tags(24, 16, 8, 1, compression), "data": _encode([plane])}])
    image = container.parse(data)["images"][0]
    got = container.decode_segment(data, image, container.segments(image)[0])
    assert np.abs(got[:, :, 0] - plane).max() <= 2
