"""Sequential Huffman-coded JPEG with 8-bit samples (ITU-T T.81, baseline and extended).

Entropy decoding goes block by block; dequantisation, the inverse transform, scaling of
subsampled components (by repetition) and colour conversion are array operations over
the whole image. Progressive and arithmetic coding raise ``DecodeError``.
"""

from __future__ import annotations

import re

import numpy as np

from .codecs import DecodeError

_LEFT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
#: Places of the coefficients in the order of the stream: diagonals, in alternate directions.
_ZIGZAG = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.n < n:
            chunk = self.data[self.at : self.at + 8]
            if self.at > len(self.data) + 64:
                raise DecodeError("JPEG: the stream ends early")
            self.at += 8
            self.held = self.held << 64 | int.from_bytes(chunk.ljust(8, b"\xff"), "big")
            self.n += 64

    def symbol(self, table: list) -> int:
        self.fill(16)
        found = table[self.held >> (self.n - 16)]
        if found is None:
            raise DecodeError("JPEG: an unknown code")
        self.n -= found[0]
        self.held &= (1 << self.n) - 1
        return found[1]

    def number(self, size: int) -> int:
        """A signed number of ``size`` bits; a leading zero bit means a negative one."""
        if not size:
            return 0
        self.fill(size)
        self.n -= size
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


def _code_table(counts: bytes, symbols: bytes) -> list:
    """16 bits of the stream -> (code length, symbol)."""
    table: list = [None] * (1 << 16)
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            if first >= 1 << 16 or k >= len(symbols):
                raise DecodeError("JPEG: a broken code table")
            table[first : first + (1 << (16 - length))] = [(length, symbols[k])] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return table


def decode(data: bytes) -> np.ndarray:
    """Samples (rows, columns, components) 0 to 255; three components become RGB."""
    try:
        return _decode(data)
    except (IndexError, KeyError, ValueError) as e:
        raise DecodeError(f"JPEG: {e}") from None


def _decode(data: bytes) -> np.ndarray:
    quant, codes, frame, interval, adobe, at, planes = {}, {}, None, 0, None, 2, {}
    if data[:2] != b"\xff\xd8":
        raise DecodeError("JPEG: no start of image")
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] == 0xFF:
            at += 1
            continue
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xD9:
            break
        if marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _code_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise DecodeError(f"JPEG: {body[0]}-bit samples")
            frame = {"h": int.from_bytes(body[1:3], "big"), "w": int.from_bytes(body[3:5], "big"), "parts": [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise DecodeError("JPEG: progressive, lossless or arithmetic coding")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            if frame is None:
                raise DecodeError("JPEG: a scan before its frame")
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(data, at)
            stream = data[at : end.start() if end else len(data)]
            wanted = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            planes |= _scan(stream, frame, wanted, codes, interval)
            at += len(stream)
    if frame is None or len(planes) != len(frame["parts"]):
        raise DecodeError("JPEG: components are missing")
    return _picture(frame, planes, quant, adobe)


def _scan(stream: bytes, frame: dict, wanted: list, codes: dict, interval: int) -> dict:
    """Coefficients (block rows, block columns, 64) of the components of one scan."""
    most_h, most_v = max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"])
    across, down = -(-frame["w"] // (8 * most_h)), -(-frame["h"] // (8 * most_v))
    parts = {p[0]: p for p in frame["parts"]}
    alone = len(wanted) == 1
    out, own = {}, []
    for name, tables in wanted:
        _, h, v, _ = parts[name]
        out[name] = np.zeros((down * v, across * h, 64), np.int32)
        own.append((name, 1 if alone else h, 1 if alone else v, codes[tables >> 4], codes[16 | tables & 15]))
    if alone:  # a scan of one component holds only the blocks that meet the image
        _, h, v, _ = parts[wanted[0][0]]
        across, down = -(-(-(-frame["w"] * h // most_h)) // 8), -(-(-(-frame["h"] * v // most_v)) // 8)
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff+[\xd0-\xd7]", stream)]
    total = across * down
    step = interval or total
    if len(pieces) < -(-total // step):
        raise DecodeError("JPEG: the stream ends early")
    for k, start in enumerate(range(0, total, step)):
        bits, before = _Bits(pieces[k]), dict.fromkeys(out, 0)
        for unit in range(start, min(total, start + step)):
            row, column = divmod(unit, across)
            for name, h, v, dc, ac in own:
                for i in range(h * v):
                    block = out[name][row * v + i // h, column * h + i % h]
                    before[name] += bits.number(bits.symbol(dc))
                    block[0] = before[name]
                    place = 1
                    while place < 64:
                        symbol = bits.symbol(ac)
                        size = symbol & 15
                        if not size and symbol != 0xF0:
                            break
                        place += symbol >> 4
                        if place > 63:
                            raise DecodeError("JPEG: a run beyond its block")
                        block[_ZIGZAG[place]] = bits.number(size)
                        place += 1
    return out


def _picture(frame: dict, planes: dict, quant: dict, adobe: int | None) -> np.ndarray:
    most_h, most_v = max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"])
    made = []
    for name, h, v, table in frame["parts"]:
        steps = np.zeros(64)
        steps[_ZIGZAG] = quant[table]
        blocks = (planes[name] * steps).reshape(*planes[name].shape[:2], 8, 8)
        flat = np.einsum("xu,abuv,yv->axby", _LEFT, blocks, _LEFT, optimize=True)
        plane = flat.reshape(flat.shape[0] * 8, flat.shape[2] * 8) + 128
        if most_h % h or most_v % v:
            raise DecodeError("JPEG: fractional subsampling")
        plane = plane.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)
        made.append(np.clip(np.rint(plane), 0, 255)[: frame["h"], : frame["w"]])
    names = bytes(p[0] for p in frame["parts"])
    if len(made) == 3 and adobe != 0 and names != b"RGB":
        y, cb, cr = made[0], made[1] - 128, made[2] - 128
        #: Full-range YCbCr to RGB.
        made = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(made, axis=2)), 0, 255).astype(np.int64)
