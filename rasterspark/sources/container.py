"""TIFF and DNG containers: bytes to tags, images and segments, and back. No Spark in here.

Parsing never raises: ``parse`` gives what it could read, with ok, err and warn. Both
byte orders, nested directories (children before their parent), typed values of
every tag, declared custom fields and gain maps. Values are read by the type that
the entry names.
"""

from __future__ import annotations

import struct
from fractions import Fraction

import numpy as np

from ..functions import codecs, jpeg
from ..functions.codecs import DecodeError

#: Fixed values of the format: type code -> (size, struct letter).
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Fixed limits: images and directories of a file, nesting, samples.
MOST_IMAGES, MOST_NESTED, MOST_BYTES = 10240, 1024, 2 << 30
#: Fixed tag numbers of scalar and list fields: name -> (tag, wanted count or None).
NUMBERS = {
    "width": (256, 1), "height": (257, 1), "bits_per_sample_original": (258, 1), "compression": (259, 1), "orientation": (274, 1),
    "samples_per_pixel": (277, 1), "rows_per_strip": (278, 1), "planar_configuration": (284, 1), "predictor": (317, 1), "tile_width": (322, 1),
    "tile_length": (323, 1), "sample_format": (339, 1), "jpeg_byte_count": (514, 1), "cfa_pattern_dim": (33421, 1), "cfa_layout": (50711, 1),
    "calibration_illuminant1": (50778, 1), "calibration_illuminant2": (50779, 1), "profile_embed_policy": (50941, 1),
}
LISTS = {
    "strip_offsets": 273, "strip_byte_counts": 279, "tile_offsets": 324, "tile_byte_counts": 325, "cfa_pattern": 33422, "cfa_plane_color": 50710,
    "dng_version": 50706, "black_level": 50714, "white_level": 50717, "color_matrix1": 50721, "color_matrix2": 50722, "camera_calibration1": 50723,
    "camera_calibration2": 50724, "analog_balance": 50727, "as_shot_neutral": 50728, "cr2_slices": 50752, "active_area": 50829,
    "profile_tone_curve": 50940, "forward_matrix1": 50964, "forward_matrix2": 50965, "noise_profile": 51041,
}
TEXTS = {"profile_name": 50936, "semantic_name": 52526}
SUB_IFDS, JPEG_OFFSET, OPCODES = 330, 513, (51008, 51009, 51010)
_BEYOND = 1 << 63
_IDENTITY = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
DEFAULTS = {
    "samples_per_pixel": 1, "bits_per_sample_original": -1, "compression": 1, "orientation": 1, "planar_configuration": 1, "predictor": 1, "rows_per_strip": -1,
    "tile_width": -1, "tile_length": -1, "sample_format": 1, "cfa_pattern_dim": 2, "cfa_layout": 1, "calibration_illuminant1": 0, "calibration_illuminant2": 0,
    "profile_embed_policy": -1, "cfa_plane_color": [0, 1, 2, 0], "cfa_pattern": [-1] * 4, "cr2_slices": [0, 0, 0], "profile_name": "", "semantic_name": "",
    **{f"{m}{i}": _IDENTITY for m in ("color_matrix", "forward_matrix", "camera_calibration") for i in (1, 2)},
}


def sniff(data: bytes) -> bool:
    return len(data) >= 32 and data[:2] in (b"II", b"MM")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"

    def number(self, letter: str, at: int):
        size = struct.calcsize("<" + letter)
        if at < 0 or at + size > len(self.data):
            raise DecodeError(f"place {at} is beyond the file's {len(self.data)} bytes")
        return struct.unpack_from(self.order + letter, self.data, at)[0]

    def entry(self, at: int) -> dict:
        tag, kind, count = self.number("H", at), self.number("H", at + 2), self.number("I", at + 4)
        size, letter = TYPES.get(kind, (1, "s"))
        place = at + 8 if size * count <= 4 else self.number("I", at + 8)
        raw = self.data[place : place + size * count]
        if len(raw) < size * count:
            raise DecodeError(f"tag {tag}: its value is beyond the end")
        values = None
        if letter == "s":
            values = raw
        elif len(letter) == 2:
            flat = struct.unpack(f"{self.order}{2 * count}{letter[0]}", raw)
            values = list(zip(flat[::2], flat[1::2]))
        else:
            values = list(struct.unpack(f"{self.order}{count}{letter}", raw))
        return {"tag": tag, "type": kind, "count": count, "place": place, "values": values, "raw": raw}


def _reals(entry: dict) -> list[float]:
    if entry["type"] in (5, 10):
        return [n / d if d else float("nan") for n, d in entry["values"]]
    return [float(v) for v in entry["values"]]


def _wholes(entry: dict) -> list[int]:
    if entry["type"] in (5, 10):
        if any(d == 0 for _, d in entry["values"]):
            raise DecodeError(f"tag {entry['tag']}: zero denominator")
        return [int(n / d) for n, d in entry["values"]]
    if not all(-_BEYOND <= v < _BEYOND for v in entry["values"]):  # NaN too
        raise DecodeError(f"tag {entry['tag']}: not a whole number of 63 bits")
    return [int(v) for v in entry["values"]]


def gain_maps(raw: bytes) -> list[dict]:
    """Gain maps (opcode 9) of an opcode list, which is big-endian always; other opcodes are skipped."""
    out, at = [], 4
    if len(raw) <= 20:
        return out
    n = struct.unpack_from(">I", raw)[0]
    if n > 16:
        raise DecodeError(f"{n} opcodes")
    for k in range(n):
        kind, _, _, size = struct.unpack_from(">4I", raw, at)
        body = raw[at + 16 : at + 16 + size]
        at += 16 + size
        if kind == 9 and len(body) >= 76:
            head = struct.unpack_from(">10I4dI", body)
            names = ("top", "left", "bottom", "right", "plane", "planes", "row_pitch", "col_pitch", "map_points_v", "map_points_h", "map_spacing_v", "map_spacing_h", "map_origin_v", "map_origin_h", "map_planes")
            m = dict(zip(names, head))
            count = m["map_points_v"] * m["map_points_h"] * m["map_planes"]
            if count > 1 << 20 or 76 + 4 * count > len(body):
                raise DecodeError("gain map larger than its opcode")
            out.append(m | {"gm_idx": k, "pixels": list(struct.unpack_from(f">{count}f", body, 76))})
    return out


def white_levels(levels: list[int], bits: int, decoded_bits: int) -> list[int]:
    """-1 means the largest value of the original depth; then no more than ``decoded_bits`` hold."""
    out = [(1 << bits) - 1 if w == -1 and 0 < bits < 32 else w for w in levels]
    return [min(w, (1 << decoded_bits) - 1) if 0 < decoded_bits < 30 else w for w in out]


#: Lists whose count must be even.
_EVEN = ("profile_tone_curve", "noise_profile")


def _image(entries: dict[int, dict], custom: list[tuple[int, int, str]], warn: list[str]) -> dict:
    image = dict(DEFAULTS, custom_fields={}, gain_maps=[])
    for name, (tag, _) in NUMBERS.items():
        if tag in entries and entries[tag]["count"]:
            image[name] = _wholes(entries[tag])[0]
    for wide, usual in ((61441, "width"), (61442, "height"), (61443, "bits_per_sample_original")):
        if wide in entries and usual not in entries:
            image[usual] = _wholes(entries[wide])[0]
    for name, tag in LISTS.items():
        if tag in entries:
            e = entries[tag]
            real = name in ("analog_balance", "as_shot_neutral", "profile_tone_curve", "noise_profile") or "matrix" in name or "calibration" in name
            image[name] = _reals(e) if real else list(e["values"]) if isinstance(e["values"], bytes) else _wholes(e)
    for name in _EVEN:
        if len(image.get(name) or ()) % 2:
            warn.append(f"{name}: an odd count")
            del image[name]
    if image["profile_embed_policy"] not in range(-1, 4):
        warn.append(f"profile_embed_policy: {image['profile_embed_policy']}")
        image["profile_embed_policy"] = -1
    if 33421 in entries and 33422 in entries:
        dim = _wholes(entries[33421])
        if len(dim) == 2 and len(image["cfa_pattern"]) != dim[0] * dim[1]:
            warn.append(f"cfa_pattern: {len(image['cfa_pattern'])} colours")
            image["cfa_pattern"] = DEFAULTS["cfa_pattern"]
    for name, tag in TEXTS.items():
        if tag in entries:
            raw = entries[tag]["raw"]
            image[name] = raw.split(b"\0", 1)[0].decode("utf-8", "replace")
    spp = image["samples_per_pixel"]
    if not 1 <= spp <= 4:
        raise DecodeError(f"{spp} samples per pixel")
    if image["predictor"] not in (1, 2, 3):
        raise DecodeError(f"predictor {image['predictor']}")
    if JPEG_OFFSET in entries:
        image["strip_offsets"] = _wholes(entries[JPEG_OFFSET])[:1]
    levels = lambda name, default: (image.get(name) or [default] * spp)[:spp]
    image["black_level"] = levels("black_level", 0)
    image["white_level"] = white_levels(levels("white_level", -1), *[image["bits_per_sample_original"]] * 2)
    version = image.pop("dng_version", [0] * 4)
    image["version"] = sum((v & 255) << (8 * i) for i, v in enumerate(version[:4]))
    if image["compression"] == 1 and image.get("jpeg_byte_count", 0) > 0:  # a preview whose payload is a JPEG file: no samples
        image |= {"width": 0, "height": 0}
        if image["bits_per_sample_original"] < 0:
            image["bits_per_sample_original"] = 8
    height, rows = image.get("height"), image["rows_per_strip"]
    image["strips_per_image"] = -(-height // rows) if height and rows > 0 else -1
    for number, tag in enumerate(OPCODES, 1):
        if tag in entries:
            image["gain_maps"] += [m | {"list_no": number} for m in gain_maps(entries[tag]["raw"])]
    for tag, kind, name in custom:
        if tag > 254 and tag in entries and entries[tag]["type"] == kind and entries[tag]["count"]:
            image["custom_fields"][name] = {"tag": tag, "type": kind, "data": entries[tag]["raw"][: TYPES[kind][0]]}
    return image


def parse(data: bytes | None, custom: list[tuple[int, int, str]] = ()) -> dict:
    """{images, tags, ok, err, warn}."""
    out = {"images": [], "tags": [], "ok": True, "err": "", "warn": ""}
    if data is None or not sniff(data):
        return out | {"ok": False, "err": "not a TIFF container"}
    r, seen = _Reader(data), set()

    def directory(at: int, depth: int) -> int:
        if depth > MOST_NESTED or at in seen:
            raise DecodeError(f"directory {at}: nested too deep or met again")
        seen.add(at)
        n = r.number("H", at)
        if not n:
            raise DecodeError("a directory without entries")
        entries = {}
        for k in range(n):
            e = r.entry(at + 2 + 12 * k)
            if e["tag"] < 254:
                raise DecodeError(f"tag {e['tag']}")
            entries[e["tag"]] = e
            pairs = e["values"] if e["type"] in (5, 10) else None
            numbers = _reals(e) if TYPES.get(e["type"], (1, "s"))[1] != "s" else None
            out["tags"].append({"ifd_offset": at, "numbers": numbers, "pairs": pairs and [{"numerator": n, "denominator": d} for n, d in pairs], **{x: e[x] for x in ("tag", "type", "count", "raw")}})
        if SUB_IFDS in entries:
            for child in _wholes(entries[SUB_IFDS]):
                directory(child, depth + 1)
        if len(out["images"]) < MOST_IMAGES:
            warn: list[str] = []
            out["images"].append(_image(entries, list(custom), warn) | {"ifd_offset": at, "big_endian": r.order == ">"})
            out["warn"] += "".join(f"{w}; " for w in warn)
        else:
            out["warn"] += f"more than {MOST_IMAGES} images; "
        return r.number("I", at + 2 + 12 * n)

    try:
        at, steps = r.number("I", 4), 0
        while at and steps < MOST_IMAGES:
            at, steps = directory(at, 0), steps + 1
    except (ValueError, struct.error, KeyError, IndexError, OverflowError, MemoryError, RecursionError) as e:
        out["ok"], out["err"] = False, str(e)
    return out


def segments(image: dict) -> list[dict]:
    """Strips or tiles: seg_idx, offset, byte_count, y0, x0, rows, cols, c0 (the channel, where each has its own segments)."""
    w, h = image.get("width") or 0, image.get("height") or 0
    if w <= 0 or h <= 0:
        return []
    planes = image["samples_per_pixel"] if image["planar_configuration"] == 2 else 1
    if image.get("tile_offsets") and image["tile_width"] > 0 and image["tile_length"] > 0:
        offsets, counts, rows, cols, tiled = image["tile_offsets"], image.get("tile_byte_counts"), image["tile_length"], image["tile_width"], True
    else:
        offsets, counts, cols, tiled = image.get("strip_offsets") or [], image.get("strip_byte_counts"), w, False
        rows = min(image["rows_per_strip"], h) if image["rows_per_strip"] > 0 else h
        counts = counts or ([image["jpeg_byte_count"]] if image.get("jpeg_byte_count") else None)
    across, out = -(-w // cols), []
    each = max(1, across * -(-h // rows)) if planes > 1 else max(1, len(offsets))
    for k, (o, c) in enumerate(zip(offsets, counts or [-1] * len(offsets))):
        c0, at = divmod(k, each)
        y0 = at // across * rows
        out.append({"seg_idx": k, "offset": o, "byte_count": c, "y0": y0, "x0": at % across * cols, "rows": rows if tiled else max(0, min(rows, h - y0)), "cols": cols, "c0": c0, "tiled": tiled})
    return out


#: What decoding needs of an image.
NEEDED = ("samples_per_pixel", "bits_per_sample_original", "sample_format", "compression", "planar_configuration", "predictor", "cr2_slices", "big_endian")


def payload_of(data: bytes, seg: dict) -> bytes:
    end = seg["offset"] + seg["byte_count"] if seg["byte_count"] > 0 else len(data)
    return data[max(0, seg["offset"]) : max(0, end)]


def decode_segment(data: bytes, image: dict, seg: dict) -> np.ndarray:
    """Samples (rows, cols, channels) of one segment of a file; floats if the sample format says so."""
    return decode_payload(payload_of(data, seg), image, seg)


def decode_payload(payload: bytes, image: dict, seg: dict) -> np.ndarray:
    """Whatever is wrong with a payload is a ``DecodeError``."""
    try:
        return _decoded(payload, image, seg)
    except DecodeError:
        raise
    except (ValueError, IndexError, KeyError, TypeError, OverflowError, ZeroDivisionError, struct.error, MemoryError) as e:
        raise DecodeError(f"a damaged payload: {e}") from None


def _fit(decoded: np.ndarray, rows: int, cols: int, spp: int, tiled: bool) -> np.ndarray:
    """A stream's samples in the place they stand for: all in order if they are as many, else the rows' beginnings."""
    if decoded.size == rows * cols * spp:
        return decoded.reshape(rows, cols, spp)
    flat = decoded.reshape(decoded.shape[0], -1)
    if not tiled and (flat.shape[0] < rows or flat.shape[1] < cols * spp):
        raise DecodeError("lossless JPEG: smaller than its strip")
    out = np.zeros((rows, cols * spp), decoded.dtype)
    part = flat[:rows, : cols * spp]
    out[: part.shape[0], : part.shape[1]] = part
    return out.reshape(rows, cols, spp)


def _decoded(payload: bytes, image: dict, seg: dict) -> np.ndarray:
    bits, kind, compression = image["bits_per_sample_original"], image["sample_format"], image["compression"]
    spp = 1 if image["planar_configuration"] == 2 else image["samples_per_pixel"]
    rows, cols = seg["rows"], seg["cols"]
    if not payload or rows <= 0 or cols <= 0 or rows * cols * spp * max(bits, 1) // 8 > MOST_BYTES:
        raise DecodeError("no payload, or too large an image")
    if compression in (6, 7, 34892) and codecs.jpeg_frame(payload)[0] != 0xC3:
        decoded = jpeg.decode(payload)
        if decoded.shape[2] != spp or decoded.shape[0] < rows or decoded.shape[1] < cols:
            raise DecodeError("JPEG: size differs from the segment's")
        return decoded[:rows, :cols]
    if compression in (6, 7):
        decoded = codecs.ljpeg_decode(payload)
        if any(image["cr2_slices"]):
            return codecs.unslice(decoded, tuple(image["cr2_slices"][:3]), rows)[:, :, None]
        return _fit(decoded, rows, cols, spp, seg.get("tiled", False))
    if kind == 3 and bits in (32, 64):
        dtype = np.dtype(f"f{bits // 8}")
    elif bits in (8, 16, 32):
        dtype = np.dtype(f"{'i' if kind == 2 else 'u'}{bits // 8}")
    elif 1 <= bits <= 31:
        dtype = None
    else:
        raise DecodeError(f"a depth of {bits} bits")
    stride = cols * spp * dtype.itemsize if dtype else -(-cols * spp * bits // 8)  # packed rows start on a byte
    need = stride * rows
    if compression == 5:
        payload = codecs.lzw_decode(payload, need)
    elif compression in (8, 32946):
        payload = codecs.inflate(payload, need)
    elif compression != 1:
        raise DecodeError(f"compression {compression} is not supported")
    if len(payload) < need:
        raise DecodeError("the payload ends early")
    if dtype is not None:
        out = np.frombuffer(payload[:need], dtype.newbyteorder(">" if image["big_endian"] else "<")).reshape(rows, cols, spp)
        out = out.astype(np.float64) if kind == 3 else out.astype(np.int64)
    else:
        out = np.stack([codecs.unpack_bits(payload[y * stride : (y + 1) * stride], bits, cols * spp) for y in range(rows)]).reshape(rows, cols, spp)
    if image["predictor"] == 2:
        out = codecs.undo_differencing(out, bits)
    elif image["predictor"] == 3:
        raise DecodeError("floating-point differencing is not supported")
    return out


def rational(value: float, signed: bool = False) -> tuple[int, int]:
    """The nearest fraction with parts under 2^31."""
    most = (1 << 31) - 1
    f = Fraction(value).limit_denominator(most if abs(value) < 1 else max(1, int(most / abs(value))))
    if not signed and f < 0:
        raise ValueError("a negative value in an unsigned rational")
    return f.numerator, f.denominator


def write(images: list[dict], big_endian: bool = False) -> bytes:
    """A container of images in strips or tiles.

    Each image: ``tags`` {tag: (type, values)} and ``data``, the payload bytes in file
    order, or a list of them, one a strip (or tile, if the tags hold a tile width).
    ``children`` are images of nested directories. Offsets and byte counts are added.
    Values of rational types are floats or pairs.
    """
    order = ">" if big_endian else "<"
    blocks: list[bytes] = []
    at = 8

    def put(block: bytes) -> int:
        nonlocal at
        block += b"\0" * (len(block) % 2)
        blocks.append(block)
        at += len(block)
        return at - len(block)

    def directory(entries: list[bytes], following: int) -> bytes:
        return struct.pack(order + "H", len(entries)) + b"".join(entries) + struct.pack(order + "I", following)

    def entries_of(image: dict) -> list[bytes]:
        tags = dict(image["tags"])
        parts = image["data"] if isinstance(image["data"], list) else [image["data"]]
        offsets, counts = (324, 325) if 322 in tags else (273, 279)
        tags[offsets], tags[counts] = (4, [put(p) for p in parts]), (4, [len(p) for p in parts])
        nested = [put(directory(entries_of(child), 0)) for child in image.get("children", ())]
        if nested:
            tags[SUB_IFDS] = (4, nested)
        entries = []
        for tag in sorted(tags):
            kind, values = tags[tag]
            letter = TYPES[kind][1]
            if letter == "s":
                raw = values if isinstance(values, bytes) else values.encode() + b"\0"
                count = len(raw)
            elif len(letter) == 2:
                pairs = [v if isinstance(v, tuple) else rational(v, kind == 10) for v in values]
                raw, count = b"".join(struct.pack(order + letter, *p) for p in pairs), len(pairs)
            else:
                raw, count = struct.pack(f"{order}{len(values)}{letter}", *values), len(values)
            if len(raw) > 4:
                raw = struct.pack(order + "I", put(raw))
            entries.append(struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0"))
        return entries

    directories = [entries_of(image) for image in images]
    first, body = at, b""
    for k, entries in enumerate(directories):
        end = first + len(body) + 2 + 12 * len(entries) + 4
        body += directory(entries, end if k + 1 < len(directories) else 0)
    head = b"MM\0*" if big_endian else b"II*\0"
    return head + struct.pack(order + "I", first if images else 0) + b"".join(blocks) + body


def image_tags(width: int, height: int, bits: int, spp: int = 1, compression: int = 1, sample_format: int = 1, **more) -> dict:
    """The usual tags; ``more`` maps tag<N> to (type, values)."""
    tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [bits] * spp), 259: (3, [compression]), 262: (3, [2 if spp >= 3 else 1]), 277: (3, [spp]), 278: (4, [height]), 284: (3, [1]), 339: (3, [sample_format] * spp)}
    return tags | {int(k[3:]): v for k, v in more.items()}


def _one_or_three(pixels: np.ndarray) -> tuple[int, int, int]:
    if pixels.ndim != 3 or pixels.shape[2] not in (1, 3):
        raise ValueError(f"one or three channels are needed, not an array of shape {pixels.shape}")
    return pixels.shape


def to_pfm(pixels: np.ndarray) -> bytes:
    """Portable float map, little-endian, rows as given; one or three channels."""
    height, width, channels = _one_or_three(pixels)
    return f"{'PF' if channels == 3 else 'Pf'}\n{width} {height}\n-1.0\n".encode() + pixels.astype("<f4").tobytes()


def to_exr(pixels: np.ndarray) -> bytes:
    """OpenEXR, uncompressed scan lines of 32-bit floats; channels Y, or B G R in file order."""
    height, width, channels = _one_or_three(pixels)
    names = ["Y"] if channels == 1 else ["B", "G", "R"]
    text = lambda s: s.encode() + b"\0"
    attribute = lambda name, kind, body: text(name) + text(kind) + struct.pack("<I", len(body)) + body
    listed = b"".join(text(n) + struct.pack("<IIII", 2, 0, 1, 1) for n in names) + b"\0"
    box = struct.pack("<4i", 0, 0, width - 1, height - 1)
    head = struct.pack("<II", 20000630, 2) + attribute("channels", "chlist", listed) + attribute("compression", "compression", b"\0") + attribute("dataWindow", "box2i", box) + attribute("displayWindow", "box2i", box) + attribute("lineOrder", "lineOrder", b"\0") + attribute("pixelAspectRatio", "float", struct.pack("<f", 1)) + attribute("screenWindowCenter", "v2f", struct.pack("<ff", 0, 0)) + attribute("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\0"
    planes = pixels[:, :, ::-1] if channels == 3 else pixels
    line = 8 + 4 * width * len(names)
    table = b"".join(struct.pack("<Q", len(head) + 8 * height + y * line) for y in range(height))
    rows = b"".join(struct.pack("<iI", y, line - 8) + planes[y].T.astype("<f4").tobytes() for y in range(height))
    return head + table + rows
