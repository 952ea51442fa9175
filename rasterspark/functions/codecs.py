"""Payload codecs on bytes and numpy arrays; no Spark in here.

Bit order is most significant first throughout, as the formats define it.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np


class DecodeError(ValueError):
    """Bad payload; readers turn it into a row with ok = false."""


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    """``count`` samples of ``bits`` bits from a packed stream."""
    if bits == 8:
        out = np.frombuffer(data, np.uint8)
    else:
        stream = np.unpackbits(np.frombuffer(data, np.uint8))
        n = len(stream) // bits
        out = stream[: n * bits].reshape(n, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
    if len(out) < count:
        raise DecodeError(f"{len(out)} samples where {count} are needed")
    return out[:count].astype(np.int64)


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    v = np.asarray(values, np.int64).ravel()
    spread = (v[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(spread.astype(np.uint8).ravel()).tobytes()


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """TIFF LZW: 9 to 12 bits, clear 256, end 257, early change. Ends once ``most`` bytes are there."""
    out, table, width, previous, size = [], [bytes([i]) for i in range(256)] + [b"", b""], 9, None, 0
    buffer = held = 0
    for byte in data:
        buffer, held = (buffer << 8 | byte) & 0xFFFFFFFF, held + 8
        while held >= width:
            code = buffer >> (held - width) & ((1 << width) - 1)
            held -= width
            if code == 256:
                del table[258:]
                width, previous = 9, None
                continue
            if code == 257:
                return b"".join(out)
            if previous is None:
                if code > 255:
                    raise DecodeError("LZW: a string before any byte")
                entry = table[code]
            else:
                if code > len(table) or len(table) > 4096:
                    raise DecodeError("LZW: unknown code")
                entry = table[code] if code < len(table) else previous + previous[:1]
                table.append(previous + entry[:1])
            out.append(entry)
            size += len(entry)
            if most is not None and size >= most:
                return b"".join(out)
            previous = entry
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, table, width, current = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    size = 258
    for i in range(len(data)):
        longer = current + data[i : i + 1]
        if longer in table:
            current = longer
            continue
        codes.append((table[current], width))
        table[longer] = size
        size += 1
        width = max(9, size.bit_length())
        if size >= 4094:
            codes.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        current = data[i : i + 1]
    if current:
        codes.append((table[current], width))
        size += 1
        width = max(9, min(12, size.bit_length()))
    codes.append((257, width))
    chunks, pending, held = [], 0, 0
    for code, w in codes:
        pending, held = pending << w | code, held + w
        while held >= 8:
            chunks.append(pending >> (held - 8) & 255)
            held -= 8
        pending &= (1 << held) - 1
    if held:
        chunks.append(pending << (8 - held) & 255)
    return bytes(chunks)


def inflate(data: bytes, most: int | None = None) -> bytes:
    """At most ``most`` bytes; what a stream holds beyond them is not made."""
    try:
        return zlib.decompress(data) if most is None else zlib.decompressobj().decompress(data, max(1, most))
    except zlib.error as e:
        raise DecodeError(f"deflate: {e}") from None


def undo_differencing(samples: np.ndarray, bits: int) -> np.ndarray:
    """Horizontal predictor 2 on an array (rows, columns, channels)."""
    return np.cumsum(samples.astype(np.int64), axis=1) & ((1 << bits) - 1)


def differencing(samples: np.ndarray, bits: int) -> np.ndarray:
    out = samples.astype(np.int64).copy()
    out[:, 1:] -= samples[:, :-1].astype(np.int64)
    return out & ((1 << bits) - 1)


def unslice(samples: np.ndarray, slices: tuple[int, int, int], height: int) -> np.ndarray:
    """Vertical slices, each row-major, side by side: ``slices`` = (count, width, last width)."""
    count, width, last = slices
    flat, parts, at = samples.ravel(), [], 0
    if min(count, width, last) < 0 or (count * width + last) * height != len(flat):
        raise DecodeError("slices: their size differs from the samples'")
    for w in [width] * count + [last]:
        parts.append(flat[at : at + w * height].reshape(height, w))
        at += w * height
    return np.concatenate(parts, axis=1)


def to_slices(samples: np.ndarray, slices: tuple[int, int, int]) -> np.ndarray:
    """What ``unslice`` undoes."""
    count, width, last = slices
    edges = [width * k for k in range(count + 1)] + [width * count + last]
    return np.concatenate([samples[:, a:b].ravel() for a, b in zip(edges, edges[1:])]).reshape(samples.shape)


# --- lossless JPEG (ITU-T T.81, process 14) ---


def _segments(data: bytes):
    if data[:2] != b"\xff\xd8":
        raise DecodeError("lossless JPEG: no start of image")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise DecodeError("lossless JPEG: no marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDA:
            return
        at += 2 + size


def jpeg_frame(data: bytes) -> tuple[int, int, int, int, int]:
    """(SOF marker, precision, height, width, components) of a JPEG stream."""
    for marker, body, _ in _segments(data):
        if marker in (0xC0, 0xC1, 0xC2, 0xC3) and len(body) >= 6:
            return marker, body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
    raise DecodeError("JPEG: no frame header")


def ljpeg_decode(data: bytes) -> np.ndarray:
    """(height, width, components); tables go with the components that the scan header names."""
    tables, frame, selectors, predictor, start = {}, None, [], 1, None
    for marker, body, end in _segments(data):
        if marker == 0xC3:
            frame = (body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5])
        elif marker == 0xC4:
            at = 0
            while at + 17 <= len(body):
                counts = body[at + 1 : at + 17]
                symbols = body[at + 17 : at + 17 + sum(counts)]
                tables[body[at] & 15] = _lookup(counts, symbols)
                at += 17 + sum(counts)
        elif marker == 0xDA:
            n = body[0]
            selectors, predictor, start = [body[2 + 2 * i] >> 4 for i in range(n)], body[1 + 2 * n], end
    if frame is None or start is None or not tables:
        raise DecodeError("lossless JPEG: headers are missing")
    precision, height, width, components = frame
    if any(s not in tables for s in selectors) or len(selectors) != components or not 0 <= predictor <= 7 or not 2 <= precision <= 16:
        raise DecodeError("lossless JPEG: bad scan header")
    stop = data.find(b"\xff\xd9", start)
    stream = data[start : stop if stop >= 0 else len(data)].replace(b"\xff\x00", b"\xff")
    return _scan(stream, [tables[s] for s in selectors], precision, height, width, components, predictor)


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(code length, symbol) of the next 16 bits; (0, -1) where no code begins so."""
    out, code, k = [(0, -1)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first, size = code << (16 - length), 1 << (16 - length)
            if k >= len(symbols) or first + size > 65536:
                raise DecodeError("lossless JPEG: a broken code table")
            out[first : first + size] = [(length, symbols[k])] * size
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _scan(stream, tables, precision, height, width, components, predictor):
    total, size = len(stream) * 8, len(stream)
    if height * width * components > total:  # a sample takes one bit at least
        raise DecodeError(f"lossless JPEG: the stream of {size} bytes ends early")
    stream = stream + b"\0" * 8
    out = [[[0] * components for _ in range(width)] for _ in range(height)]
    bit, read = 0, int.from_bytes
    for y in range(height):
        row, above = out[y], out[y - 1] if y else None
        for x in range(width):
            for c in range(components):
                word = read(stream[bit >> 3 : (bit >> 3) + 6], "big") << (bit & 7) & 0xFFFFFFFFFFFF
                length, category = tables[c][word >> 32]
                if category < 0 or category > 16:
                    raise DecodeError("lossless JPEG: unknown code")
                bit += length
                if category == 0:
                    diff = 0
                elif category == 16:
                    diff = 32768
                else:
                    diff = word >> (48 - length - category) & ((1 << category) - 1)
                    if diff < 1 << (category - 1):
                        diff -= (1 << category) - 1
                    bit += category
                if x and above:
                    a, b, d = row[x - 1][c], above[x][c], above[x - 1][c]
                    guess = (0, a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[predictor]
                elif x:
                    guess = row[x - 1][c]
                elif above:
                    guess = above[0][c]
                else:
                    guess = 1 << (precision - 1)
                row[x][c] = (guess + diff) & 0xFFFF
        if bit > total + 7:
            raise DecodeError(f"lossless JPEG: the stream of {size} bytes ends early")
    return np.array(out, np.int64).reshape(height, width, components)


def residuals(samples: np.ndarray, precision: int, predictor: int = 6) -> np.ndarray:
    """Prediction residuals mod 65536, signed, of an array (rows, columns)."""
    v = samples.astype(np.int64)
    guess = np.zeros_like(v)
    guess[0, 0] = 1 << (precision - 1)
    guess[0, 1:], guess[1:, 0] = v[0, :-1], v[:-1, 0]
    a, b, d = v[1:, :-1], v[:-1, 1:], v[:-1, :-1]
    guess[1:, 1:] = (0 * a, a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[predictor]
    diff = (v - guess) & 0xFFFF
    return np.where(diff > 32768, diff - 65536, diff)


def categories(diff: np.ndarray) -> np.ndarray:
    """Bit lengths of absolute residuals (0 to 16)."""
    size = np.abs(diff)
    return np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1, 0)


def code_lengths(counts: list[int], most: int = 16) -> list[int]:
    """Huffman code lengths; one code of ones stays unused, as the format asks."""
    live = [(n, [s]) for s, n in enumerate(counts) if n] + [(0, [len(counts)])]
    lengths = [0] * (len(counts) + 1)
    if len(live) == 1:
        return lengths[:-1]
    while len(live) > 1:
        live.sort(key=lambda p: (p[0], p[1][0] != len(counts)))
        (n1, s1), (n2, s2) = live[:2]
        for s in s1 + s2:
            lengths[s] += 1
        live[:2] = [(n1 + n2, s1 + s2)]
    if max(lengths) > most:
        return code_lengths([(n + 1) // 2 for n in counts], most)
    return lengths[:-1]


def ljpeg_encode(samples: np.ndarray, precision: int, predictor: int = 6) -> bytes:
    """One component, one Huffman table made for these samples."""
    height, width = samples.shape
    diff = residuals(samples, precision, predictor)
    category = categories(diff)
    lengths = code_lengths(np.bincount(category.ravel(), minlength=17).tolist())
    order = sorted((n, s) for s, n in enumerate(lengths) if n)
    counts = [sum(n == k for n, _ in order) for k in range(1, 17)]
    codes, code, last = {}, 0, order[0][0] if order else 0
    for n, s in order:
        code <<= n - last
        codes[s], last = (n, code), n
        code += 1
    value, held, out = 0, 0, bytearray()
    for d, k in zip(diff.ravel().tolist(), category.ravel().tolist()):
        n, c = codes[k]
        value, held = value << n | c, held + n
        if 0 < k < 16:
            value, held = value << k | (d if d > 0 else d + (1 << k) - 1), held + k
        while held >= 8:
            byte = value >> (held - 8) & 255
            out += b"\xff\x00" if byte == 255 else bytes([byte])
            held -= 8
        value &= (1 << held) - 1
    if held:
        byte = (value << (8 - held) | ((1 << (8 - held)) - 1)) & 255
        out += b"\xff\x00" if byte == 255 else bytes([byte])
    table = bytes([0, *counts, *(s for _, s in order)])
    frame = bytes([precision]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    scan = bytes([1, 1, 0, predictor, 0, 0])
    part = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    return b"\xff\xd8" + part(0xC3, frame) + part(0xC4, table) + part(0xDA, scan) + bytes(out) + b"\xff\xd9"
