import random
import struct

import numpy as np
import pytest

from rasterspark.functions import codecs
from rasterspark.sources import container as c


def test_golden_lzw():
    assert list(codecs.lzw_decode(bytes.fromhex("8001e0408044080c068080"))) == [7, 7, 7, 8, 8, 7, 7, 6, 6]


def test_golden_ljpeg():
    v = bytes.fromhex("ffd8ffc3000b0c0002000201001100ffc400160001010100000000000000000000000000000102ffda00080100000100005cefffd9")
    assert codecs.ljpeg_decode(v)[:, :, 0].tolist() == [[2048, 2049], [2046, 2049]]


@pytest.mark.parametrize("v", [
    "49492a000c000000010203fa080000010400010000000200000001010400010000000200000002010300010000000800000003010300010000000100000011010400010000000800000015010300010000000100000016010400010000000200000017010400010000000400000000000000",
    "4d4d002a0000000c010203fa000801000004000000010000000201010004000000010000000201020003000000010008000001030003000000010001000001110004000000010000000801150003000000010001000001160004000000010000000201170004000000010000000400000000",
])
def test_golden_container(v):
    data = bytes.fromhex(v)
    p = c.parse(data)
    assert p["ok"] and len(p["images"]) == 1 and p["images"][0]["white_level"] == [255]
    image = p["images"][0]
    assert c.decode_segment(data, image, c.segments(image)[0])[:, :, 0].tolist() == [[1, 2], [3, 250]]


@pytest.mark.parametrize("bits", [10, 12, 14, 16])
def test_pack_round_trip(bits):
    v = np.random.default_rng(bits).integers(0, 1 << bits, 64)
    assert codecs.unpack_bits(codecs.pack_bits(v, bits), bits, 64).tolist() == v.tolist()
    assert codecs.unpack_bits(b"\x12\x34\x56", 12, 2).tolist() == [0x123, 0x456]


def test_lzw_round_trip():
    r = random.Random(1)
    for n in (0, 1, 5, 300, 20000):
        data = bytes(r.choice(b"abcab\0\xff") for _ in range(n))
        assert codecs.lzw_decode(codecs.lzw_encode(data)) == data


@pytest.mark.parametrize("predictor", range(1, 8))
def test_ljpeg_round_trip(predictor):
    v = np.random.default_rng(predictor).integers(0, 4096, (9, 13))
    assert (codecs.ljpeg_decode(codecs.ljpeg_encode(v, 12, predictor))[:, :, 0] == v).all()


@pytest.mark.parametrize("big", [False, True])
def test_write_and_read(big):
    order = ">" if big else "<"
    rgb = np.stack([np.arange(12).reshape(3, 4) + k * 1000 for k in range(3)], axis=2)
    fp = np.linspace(-1, 1, 6).reshape(2, 3)
    images = [
        {"tags": c.image_tags(4, 3, 16, 3, tag21264=(9, [123]), tag50728=(5, [0.5, 1.0, 0.25]), tag50936=(2, "name")), "data": rgb.astype(order + "u2").tobytes()},
        {"tags": c.image_tags(3, 2, 32, 1, sample_format=3), "data": fp.astype(order + "f4").tobytes()},
    ]
    data = c.write(images, big)
    p = c.parse(data, [(21264, 9, "my_tag")])
    assert p["ok"] and [i["width"] for i in p["images"]] == [4, 3]
    one, two = p["images"]
    assert struct.unpack(order + "i", one["custom_fields"]["my_tag"]["data"]) == (123,)
    assert one["as_shot_neutral"] == [0.5, 1.0, 0.25] and one["profile_name"] == "name"
    assert (c.decode_segment(data, one, c.segments(one)[0]) == rgb).all()
    assert np.allclose(c.decode_segment(data, two, c.segments(two)[0])[:, :, 0], fp)


def test_damaged_input_is_a_row():
    data = c.write([{"tags": c.image_tags(8, 8, 8), "data": bytes(64)}])
    r = random.Random(0)
    for _ in range(500):
        b = bytearray(data[: r.randint(0, len(data))])
        for _ in range(r.randint(0, 4)):
            if b:
                b[r.randrange(len(b))] = r.randrange(256)
        p = c.parse(bytes(b))
        for image in p["images"]:
            for s in c.segments(image)[:4]:
                try:
                    if s["rows"] * s["cols"] < 1 << 16:
                        c.decode_segment(bytes(b), image, s)
                except codecs.DecodeError:
                    pass


def test_gain_map():
    body = struct.pack(">10I4dI", 0, 0, 4, 4, 0, 1, 1, 1, 2, 2, 0.5, 0.5, 0.0, 0.0, 1) + struct.pack(">4f", 1, 2, 3, 4)
    raw = struct.pack(">I4I", 1, 9, 1, 0, len(body)) + body
    data = c.write([{"tags": c.image_tags(1, 1, 8, tag51009=(7, raw)), "data": b"\1"}])
    m = c.parse(data)["images"][0]["gain_maps"]
    assert len(m) == 1 and m[0]["pixels"] == [1, 2, 3, 4] and m[0]["list_no"] == 2


def test_sinks():
    v = np.arange(6, dtype=float).reshape(2, 3, 1)
    assert c.to_pfm(v).startswith(b"Pf\n3 2\n-1.0\n")
    assert c.to_exr(v)[:4] == struct.pack("<I", 20000630)


def test_float_sinks_take_one_or_three_channels():
    for make in (c.to_pfm, c.to_exr):
        for channels in (2, 4):
            with pytest.raises(ValueError):
                make(np.zeros((2, 2, channels)))


def _files_of_every_codec():
    from rasterspark.plans.payloads import flat_jpeg
    from rasterspark.sources.sinks import encode_samples

    v = np.random.default_rng(3).integers(0, 256, (6, 8, 1))
    for compression, name in ((1, "none"), (5, "lzw"), (8, "deflate"), (7, "ljpeg")):
        yield c.image_tags(8, 6, 8, 1, compression), encode_samples(v, 8, name)
        yield c.image_tags(8, 6, 12, 1, compression, tag317=(3, [2])) if name != "ljpeg" else c.image_tags(8, 6, 8, 1, 7, tag50752=(3, [1, 3, 5])), encode_samples(v, 12 if name != "ljpeg" else 8, name)
    yield c.image_tags(8, 8, 8, 1, 34892), flat_jpeg([9])
    yield c.image_tags(8, 8, 8, 3, 7, tag322=(4, [8]), tag323=(4, [8])), flat_jpeg([9], gray=False)
    yield c.image_tags(8, 6, 8, 1, 1, tag50940=(11, [0.5, 1.0]), tag51041=(12, [1.0, 2.0]), tag50728=(5, [0.5]), tag33421=(3, [2, 2]), tag33422=(1, [0, 1, 1, 2])), v.astype("u1").tobytes()


def test_damage_to_any_codec_is_a_row(spark):
    """Neither parsing nor decoding raises anything but DecodeError, and every image and tag fits its relation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from rasterspark.sources import reader

    images, tags = (to_arrow_schema(_parse_datatype_string(s)) for s in (reader.IMAGES, reader.TAGS))
    r = random.Random(7)
    for settings, payload in _files_of_every_codec():
        data = c.write([{"tags": settings, "data": [payload]}], r.random() < 0.5)
        for _ in range(400):
            b = bytearray(data if r.random() < 0.7 else data[: r.randint(8, len(data))])
            for _ in range(r.randint(0, 4)):
                at = r.randrange(8, len(b)) if len(b) > 8 else 0
                b[at] = r.choice((0, 255, r.randrange(256)))
            b = bytes(b)
            p = c.parse(b)
            reader._table([i | {"custom_fields": list(i["custom_fields"].items())} for i in p["images"]], images)
            reader._table(p["tags"], tags)
            for image in p["images"]:
                for s in c.segments(image)[:2]:
                    if s["rows"] * s["cols"] < 1 << 16:
                        try:
                            c.decode_segment(b, image, s)
                        except codecs.DecodeError:
                            pass


def test_a_large_stream_is_not_made_whole():
    import zlib

    assert len(codecs.inflate(zlib.compress(bytes(1 << 24)), 100)) == 100
    assert len(codecs.lzw_decode(codecs.lzw_encode(bytes(1 << 14)), 100)) < 400


def test_odd_counts_and_ranges_are_warnings():
    tags = c.image_tags(1, 1, 8, tag50940=(11, [0.5]), tag51041=(12, [1.0]), tag50941=(4, [9]), tag33421=(3, [2, 2]), tag33422=(1, [0, 1]))
    p = c.parse(c.write([{"tags": tags, "data": b"\0"}]))
    image = p["images"][0]
    assert p["ok"] and all(n in p["warn"] for n in ("profile_tone_curve", "noise_profile", "profile_embed_policy", "cfa_pattern"))
    assert "noise_profile" not in image and image["profile_embed_policy"] == -1 and image["cfa_pattern"] == [-1] * 4


def test_levels_that_are_no_numbers():
    p = c.parse(c.write([{"tags": c.image_tags(1, 1, 8, tag50717=(12, [float("nan")])), "data": b"\0"}]))
    assert not p["ok"] and p["images"] == []


def test_ljpeg_with_large_residuals_and_no_prediction():
    """Category 16 (a residual of 32768 without further bits) and predictor 0, put together by hand."""
    part = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    table = part(0xC4, bytes([0, 0, 3, *[0] * 14, 0, 1, 16]))  # codes 00, 01, 10 for categories 0, 1, 16
    frame = part(0xC3, struct.pack(">BHHB", 16, 1, 3, 1) + bytes([1, 0x11, 0]))
    for predictor, want in ((1, [0, 1, 32769]), (0, [0, 1, 32769])):
        scan = part(0xDA, bytes([1, 1, 0, predictor, 0, 0]))
        stream = int("10" + "011" + "10" + "1" * 1, 2).to_bytes(1, "big")
        got = codecs.ljpeg_decode(b"\xff\xd8" + table + frame + scan + stream + b"\xff\xd9")[0, :, 0].tolist()
        assert got == want


def test_lzw_changes_its_width():
    """A stream of growing codes, written by the format's rule alone: each new string is the last one and a byte."""
    data = bytes(i % 251 for i in range(600))
    codes, size = [256], 258
    for b in data:
        codes.append(b)
    bits, entries = "", 257  # entries: the last code that the table holds
    for k, code in enumerate([*codes, 257]):
        width = 9 if entries < 510 else 10 if entries < 1022 else 11
        bits += f"{code:0{width}b}"
        if k >= 1:
            entries += 1 if k >= 2 else 0
    bits += "0" * (-len(bits) % 8)
    assert size == 258 and codecs.lzw_decode(int(bits, 2).to_bytes(len(bits) // 8, "big")) == data
