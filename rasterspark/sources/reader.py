"""Containers as relations: files, tags, images, segments, gain maps, rasters and pixels.

Each relation is a narrow map over the files, so one that needs only headers never
decodes, and a filter on ``segments`` keeps the rest undecoded. Bad input is a row of
``diagnostics``; with ``mode="FAILFAST"`` it raises, with "DROPMALFORMED" only whole
files stay.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import DecodeError
from . import container

FILES = "path string, content binary"
TAGS = "path string, ifd_offset long, tag int, type int, count long, raw binary, numbers array<double>, pairs array<struct<numerator:long,denominator:long>>"
GAIN = "list_no int, gm_idx int, top long, left long, bottom long, right long, plane long, planes long, row_pitch long, col_pitch long, map_points_v long, map_points_h long, map_spacing_v double, map_spacing_h double, map_origin_v double, map_origin_h double, map_planes long, pixels array<float>"
_INTS = ["width", "height", "bits_per_sample_original", "compression", "orientation", "samples_per_pixel", "rows_per_strip", "strips_per_image", "planar_configuration", "predictor", "tile_width", "tile_length", "sample_format", "jpeg_byte_count", "cfa_pattern_dim", "cfa_layout", "calibration_illuminant1", "calibration_illuminant2", "profile_embed_policy", "version"]
_LONG_LISTS = ["strip_offsets", "strip_byte_counts", "tile_offsets", "tile_byte_counts", "black_level", "white_level", "cfa_pattern", "cfa_plane_color", "cr2_slices", "active_area"]
_REAL_LISTS = ["color_matrix1", "color_matrix2", "forward_matrix1", "forward_matrix2", "camera_calibration1", "camera_calibration2", "analog_balance", "as_shot_neutral", "profile_tone_curve", "noise_profile"]
IMAGES = (
    "path string, image_idx int, big_endian boolean, "
    + ", ".join(f"{n} long" for n in _INTS)
    + ", "
    + ", ".join(f"{n} array<long>" for n in _LONG_LISTS)
    + ", "
    + ", ".join(f"{n} array<double>" for n in _REAL_LISTS)
    + ", profile_name string, semantic_name string, custom_fields map<string,struct<tag:int,type:int,data:binary>>"
)
SEGMENT = "seg_idx int, offset long, byte_count long, y0 long, x0 long, rows long, cols long, c0 int"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content) of the containers below a path; others are left out by their first bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return rows.filter(is_container(F.col("content"), F.col("length"))).select("path", "content")


def is_container(content, length=None):
    """Two magic bytes and 32 bytes at least."""
    size = F.length(content) if length is None else length
    return (size >= 32) & F.substring(content, 1, 2).isin(bytearray(b"II"), bytearray(b"MM"))


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def _mapped(files: DataFrame, rows_of, ddl: str, columns=("path", "content"), at_once: int = 4096) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = _parse_datatype_string(ddl)
    assert isinstance(schema, StructType)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                rows = iter(rows_of(*values))
                while part := list(islice(rows, at_once)):
                    yield _table(part, arrow)

    return files.select(*columns).mapInArrow(run, schema)


def tags(files: DataFrame) -> DataFrame:
    """Every directory entry, unknown ones included: raw bytes, and the numbers that they hold (pairs for rationals)."""
    return _mapped(files, lambda p, b: [t | {"path": p} for t in container.parse(b)["tags"]], TAGS)


def diagnostics(files: DataFrame) -> DataFrame:
    def rows(p, b):
        got = container.parse(b)
        return [{"path": p, "n_images": len(got["images"]), **{k: got[k] for k in ("ok", "err", "warn")}}]

    return _mapped(files, rows, "path string, n_images int, ok boolean, err string, warn string")


def images(files: DataFrame, custom: list[tuple[int, int, str]] = (), mode: str = "PERMISSIVE") -> DataFrame:
    """One row per image; ``custom`` declares (tag, type, name) fields."""
    declared = list(custom)

    def rows(p, b):
        got = container.parse(b, declared)
        if not got["ok"] and mode == "FAILFAST":
            raise ValueError(f"{p}: {got['err']}")
        if not got["ok"] and mode == "DROPMALFORMED":
            return []
        return [{n: v for n, v in i.items() if n not in ("gain_maps", "ifd_offset")} | {"path": p, "image_idx": k, "custom_fields": list(i["custom_fields"].items())} for k, i in enumerate(got["images"])]

    return _mapped(files, rows, IMAGES)


def gainmaps(files: DataFrame) -> DataFrame:
    return _mapped(files, lambda p, b: [m | {"path": p, "image_idx": k} for k, i in enumerate(container.parse(b)["images"]) for m in i["gain_maps"]], f"path string, image_idx int, {GAIN}")


def segments(files: DataFrame) -> DataFrame:
    """Strips and tiles of every image, not decoded."""
    return _mapped(files, lambda p, b: [s | {"path": p, "image_idx": k} for k, i in enumerate(container.parse(b)["images"]) for s in container.segments(i)], f"path string, image_idx int, {SEGMENT}")


_PAYLOAD = f"path string, image_idx int, {SEGMENT}, width long, height long, head string, payload binary"
_DECODED = f"path string, image_idx int, {SEGMENT}, width long, height long, spp int, ok boolean, err string, samples array<double>"


def payloads(files: DataFrame, region: tuple[int, int, int, int] | None = None, image_idx: int | None = None, raw_bytes: bool = False, point: tuple[int, int] | None = None) -> DataFrame:
    """The stored bytes of every segment, not decoded, with what decoding needs of its image (``head``, JSON)."""

    def rows(p, b):
        for k, image in enumerate(container.parse(b)["images"]):
            if image_idx is not None and k != image_idx:
                continue
            wanted = region
            if point:  # moved to the image's edge if beyond
                x, y = (max(0, min(at, (image.get(n) or 1) - 1)) for at, n in zip(point, ("width", "height")))
                wanted = (y, x, y + 1, x + 1)
            for s in container.segments(image):
                if wanted and not (s["y0"] < wanted[2] and wanted[0] < s["y0"] + s["rows"] and s["x0"] < wanted[3] and wanted[1] < s["x0"] + s["cols"]):
                    continue
                head = json.dumps({n: image[n] for n in container.NEEDED} | {"tiled": s["tiled"]} | ({"big_endian": False} if raw_bytes else {}))
                yield s | {"path": p, "image_idx": k, "width": image.get("width"), "height": image.get("height"), "head": head, "payload": container.payload_of(b, s)}

    return _mapped(files, rows, _PAYLOAD, at_once=64)


def decoded(payloads_: DataFrame) -> DataFrame:
    """``payloads`` with samples as an array in (row, column, channel) order, ok and err; one segment is in memory at a time."""
    names = [c.split()[0] for c in _PAYLOAD.split(", ")]

    def rows(*values):
        row = dict(zip(names, values))
        head, payload = json.loads(row.pop("head")), row.pop("payload")
        row |= {"spp": 1 if head["planar_configuration"] == 2 else head["samples_per_pixel"], "ok": True, "err": ""}
        try:
            if max(row["y0"] + row["rows"], row["x0"] + row["cols"]) >= 1 << 31:
                raise DecodeError("too large an image")
            v = container.decode_payload(payload, head, row | {"tiled": head["tiled"]})
            row |= {"rows": v.shape[0], "cols": v.shape[1], "spp": v.shape[2], "samples": v.ravel().astype(np.float64)}
        except DecodeError as e:
            row |= {"ok": False, "err": str(e), "samples": None}
        return [row]

    return _mapped(payloads_, rows, _DECODED, names, at_once=1)


def rasters(files: DataFrame, region: tuple[int, int, int, int] | None = None, image_idx: int | None = None, spread: bool = False, raw_bytes: bool = False, point: tuple[int, int] | None = None) -> DataFrame:
    """Decoded segments. Only segments that meet ``region`` (top, left, bottom, right), or hold ``point`` (x, y), are decoded.

    ``spread`` deals the stored bytes of segments out over all tasks before they are
    decoded, for files that are few and large; otherwise a file's segments stay together.
    With ``raw_bytes`` samples of big-endian files are not swapped.
    """
    rows = payloads(files, region, image_idx, raw_bytes, point)
    return decoded(rows.repartition("path", "image_idx", "seg_idx") if spread else rows)


def pixel_at(files: DataFrame, x: int, y: int) -> DataFrame:
    """(path, image_idx, y, x, c, v): the samples of each image at (x, y), moved to its edge if beyond; one segment of a plane is decoded."""
    place = lambda at, size: F.greatest(F.lit(0), F.least(F.lit(at), F.col(size) - 1))
    found = rasters(files, point=(x, y)).withColumn("_x", place(x, "width")).withColumn("_y", place(y, "height")).filter("ok")
    first = ((F.col("_y") - F.col("y0")) * F.col("cols") + F.col("_x") - F.col("x0")) * F.col("spp")
    samples = found.select("path", "image_idx", F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), "c0", F.posexplode(F.slice("samples", (first + 1).cast("int"), F.col("spp"))).alias("i", "v"))
    return samples.select("path", "image_idx", "y", "x", (F.col("c0") + F.col("i")).alias("c"), "v")


def pixels(rasters_: DataFrame) -> DataFrame:
    """(path, image_idx, y, x, c, v); tile parts beyond the image are clipped."""
    flat = rasters_.filter("ok").select("path", "image_idx", "y0", "x0", "cols", "spp", "c0", "width", "height", F.posexplode("samples").alias("i", "v"))
    out = flat.select("path", "image_idx", (F.col("y0") + F.expr("i div (cols * spp)")).cast("int").alias("y"), (F.col("x0") + F.expr("(i div spp) % cols")).cast("int").alias("x"), (F.col("c0") + F.expr("i % spp")).cast("int").alias("c"), "v", "width", "height")
    return out.filter("x < coalesce(width, x + 1) and y < coalesce(height, y + 1)").drop("width", "height")
