"""Directory settings as columns: names, tags, types and the rules that their values keep. No Spark in here."""

from __future__ import annotations

from math import isfinite, isqrt

_BYTE, _ASCII, _SHORT, _LONG, _RATIONAL, _SRATIONAL, _SLONG = 1, 2, 3, 4, 5, 10, 9
_MOST = {_BYTE: (0, 255), _SHORT: (0, 65535), _LONG: (0, (1 << 32) - 1), _SLONG: (-(1 << 31), (1 << 31) - 1), _RATIONAL: (0, (1 << 32) - 1), _SRATIONAL: (-(1 << 31), (1 << 31) - 1)}

_one_of = lambda *allowed: lambda v, spp: len(v) == 1 and v[0] in allowed
_count = lambda n: lambda v, spp: len(v) == n
_some = lambda v, spp: len(v) >= 1
_each_sample = lambda v, spp: len(v) == spp
_rows_of_3 = lambda v, spp: len(v) >= 3 and len(v) % 3 == 0
_square = lambda v, spp: len(v) >= 1 and isqrt(len(v)) ** 2 == len(v)
_text = lambda most: lambda v, spp: 1 <= len(v) < most

#: Fixed values of the formats: name -> (tag, type, rule).
SETTINGS = {
    "subfile_type": (254, _LONG, lambda v, spp: len(v) == 1 and 0 <= v[0] <= 7),
    "photometric": (262, _SHORT, _one_of(0, 1, 2, 32803, 34892)),
    "image_description": (270, _ASCII, _text(1 << 20)),
    "orientation": (274, _SHORT, _one_of(*range(1, 9))),
    "x_resolution": (282, _RATIONAL, _count(1)),
    "y_resolution": (283, _RATIONAL, _count(1)),
    "resolution_unit": (296, _SHORT, _one_of(1, 2, 3)),
    "software": (305, _ASCII, _text(4096)),
    "cfa_repeat_pattern_dim": (33421, _SHORT, _count(2)),
    "cfa_pattern": (33422, _BYTE, _some),
    "dng_version": (50706, _BYTE, _count(4)),
    "unique_camera_model": (50708, _ASCII, _text(1 << 20)),
    "black_level_repeat_dim": (50713, _SHORT, _count(2)),
    "black_level": (50714, _SHORT, _some),
    "black_level_rational": (50714, _RATIONAL, _each_sample),
    "white_level_rational": (50717, _RATIONAL, _each_sample),
    "color_matrix1": (50721, _SRATIONAL, _rows_of_3),
    "color_matrix2": (50722, _SRATIONAL, _rows_of_3),
    "camera_calibration1": (50723, _SRATIONAL, _square),
    "camera_calibration2": (50724, _SRATIONAL, _square),
    "analog_balance": (50727, _RATIONAL, _some),
    "as_shot_neutral": (50728, _RATIONAL, _some),
    "as_shot_white_xy": (50729, _RATIONAL, _count(2)),
    "calibration_illuminant1": (50778, _SHORT, _count(1)),
    "calibration_illuminant2": (50779, _SHORT, _count(1)),
    "active_area": (50829, _LONG, _count(4)),
    "forward_matrix1": (50964, _SRATIONAL, _rows_of_3),
    "forward_matrix2": (50965, _SRATIONAL, _rows_of_3),
}
#: Columns of (tag, number) maps: fields of one's own.
CUSTOM = {"custom_long": _SLONG, "custom_ulong": _LONG}


def _fits(kind: int, value) -> bool:
    low, high = _MOST[kind]
    return isfinite(value) and low <= value <= high and (kind in (_RATIONAL, _SRATIONAL) or value == int(value))


def tags_of(row: dict, spp: int) -> dict[int, tuple]:
    """{tag: (type, values)} of a row's settings; null columns are left out. A broken rule is a ``ValueError``."""
    tags = {}
    for name, (tag, kind, rule) in SETTINGS.items():
        value = row.get(name)
        if value is None:
            continue
        if kind == _ASCII:
            if not rule(value.encode(), spp):
                raise ValueError(f"{name}: a text of {len(value.encode())} bytes")
            tags[tag] = (kind, value)
            continue
        values = list(value) if isinstance(value, (list, tuple, bytes)) else [value]
        if not rule(values, spp) or not all(v is not None and _fits(kind, v) for v in values):
            raise ValueError(f"{name}: {values[:8]}")
        tags[tag] = (kind, values if kind in (_RATIONAL, _SRATIONAL) else [int(v) for v in values])
    for column, kind in CUSTOM.items():
        for tag, value in row.get(column) or ():
            if not 254 < tag < 65536 or value is None or not _fits(kind, value):
                raise ValueError(f"{column}: {tag} = {value}")
            tags[tag] = (kind, [value])
    return tags
