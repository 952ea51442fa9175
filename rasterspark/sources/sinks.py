"""Containers, PFM and EXR files from relations; a file is one group, so its size bounds a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import codecs
from . import container, settings

#: Names of the payload codecs and their compression tag values.
COMPRESSIONS = {"none": 1, "lzw": 5, "ljpeg": 7, "deflate": 8}


def encode_samples(v: np.ndarray, bits: int, compression: str = "none", predictor: int = 1, big_endian: bool = False, ljpeg_predictor: int = 6, sample_format: int = 1) -> bytes:
    """The payload of one strip or tile of samples (rows, cols, spp)."""
    import zlib

    if compression == "ljpeg":
        return codecs.ljpeg_encode(v.reshape(v.shape[0], -1), max(2, bits), ljpeg_predictor)
    if predictor == 2:
        v = codecs.differencing(v, bits)
    if bits in (8, 16, 32, 64):
        raw = v.astype(f"{'>' if big_endian else '<'}{ {1: 'u', 2: 'i', 3: 'f'}[sample_format]}{bits // 8}").tobytes()
    else:
        raw = b"".join(codecs.pack_bits(row, bits) for row in v)
    return {"none": lambda b: b, "lzw": codecs.lzw_encode, "deflate": zlib.compress}[compression](raw)


def parts_of(v: np.ndarray, rows_per_strip: int | None = None, tile: tuple[int, int] | None = None) -> list[np.ndarray]:
    """Strips, or whole tiles (width, length) in row order with zeros beyond the edges."""
    height, width, spp = v.shape
    if tile is None:
        step = rows_per_strip or height
        return [v[y : y + step] for y in range(0, height, step)]
    across, down = -(-width // tile[0]), -(-height // tile[1])
    whole = np.zeros((down * tile[1], across * tile[0], spp), v.dtype)
    whole[:height, :width] = v
    return [whole[r * tile[1] : (r + 1) * tile[1], c * tile[0] : (c + 1) * tile[0]] for r in range(down) for c in range(across)]


def to_containers(
    pixels: DataFrame, bits: int, compression: str = "none", predictor: int = 1, big_endian: bool = False, tags: dict | None = None, ljpeg_predictor: int = 6,
    rows_per_strip: int | None = None, tile: tuple[int, int] | None = None, slices: tuple[int, int, int] | None = None, sample_format: int = 1,
    headers: DataFrame | None = None,
) -> DataFrame:
    """``pixels(path, image_idx, y, x, c, v)`` -> (path, content): one container per path.

    Samples are integers (floats with ``sample_format`` 3) in one strip, strips of
    ``rows_per_strip``, or tiles; ``slices`` orders a lossless JPEG's columns.

    ``headers(path, [image_idx,] settings...)`` sets tags from columns (``settings``), for one
    image or all of a file, and ``bits`` where it has such a column. The result then has
    a column ``err``: a file whose settings break a rule has no content, but the reason.
    """
    more = dict(tags or {})
    if predictor != 1:
        more[317] = (3, [predictor])
    if rows_per_strip:
        more[278] = (4, [rows_per_strip])
    if tile:
        more |= {322: (4, [tile[0]]), 323: (4, [tile[1]])}
    if slices:
        more[50752] = (3, list(slices))

    def container_of(group: pa.Table, rows: list[dict]) -> bytes:
        path, idx, y, x, c, v = (group.column(n).to_numpy() for n in ("path", "image_idx", "y", "x", "c", "v"))
        images = []
        for k in np.unique(idx):
            own = idx == k
            h, w, spp = int(y[own].max()) + 1, int(x[own].max()) + 1, int(c[own].max()) + 1
            samples = np.zeros((h, w, spp), np.float64 if sample_format == 3 else np.int64)
            samples[y[own], x[own], c[own]] = v[own].astype(samples.dtype)
            if slices:
                samples = codecs.to_slices(samples[:, :, 0], slices)[:, :, None]
            own = [r for r in rows if r.get("image_idx") in (None, k)]
            depth = next((r["bits"] for r in own if r.get("bits")), bits)
            head = container.image_tags(w, h, depth, spp, COMPRESSIONS[compression], sample_format) | more
            for r in own:
                head |= settings.tags_of(r, spp)
            payload = [encode_samples(p, depth, compression, predictor, big_endian, ljpeg_predictor, sample_format) for p in parts_of(samples, rows_per_strip, tile)]
            images.append({"tags": head, "data": payload})
        return container.write(images, big_endian)

    def build(group: pa.Table) -> pa.Table:
        return pa.table({"path": pa.array([group.column("path")[0].as_py()], pa.string()), "content": pa.array([container_of(group, [])], pa.binary())})

    def build_with(group: pa.Table, rows: pa.Table) -> pa.Table:
        path, content, err = (group if group.num_rows else rows).column("path")[0].as_py(), None, ""
        try:
            if not group.num_rows:
                raise ValueError("no pixels")
            content = container_of(group, rows.to_pylist())
        except ValueError as e:
            err = str(e)
        return pa.table({"path": pa.array([path], pa.string()), "content": pa.array([content], pa.binary()), "err": pa.array([err], pa.string())})

    grouped = pixels.select("path", "image_idx", "y", "x", "c", "v").groupBy("path")
    if headers is None:
        return grouped.applyInArrow(build, "path string, content binary")
    return grouped.cogroup(headers.groupBy("path")).applyInArrow(build_with, "path string, content binary, err string")


def to_float_files(pixels: DataFrame, kind: str = "pfm") -> DataFrame:
    """(path, image_idx, content): each image as PFM or EXR; one or three channels."""
    make = {"pfm": container.to_pfm, "exr": container.to_exr}[kind]

    def build(group: pa.Table) -> pa.Table:
        y, x, c, v = (group.column(n).to_numpy() for n in ("y", "x", "c", "v"))
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, int(c.max()) + 1))
        out[y, x, c] = v
        return pa.table({"path": group.column("path")[:1], "image_idx": group.column("image_idx")[:1], "content": pa.array([make(out)], pa.binary())})

    return pixels.select("path", "image_idx", "y", "x", "c", "v").groupBy("path", "image_idx").applyInArrow(build, "path string, image_idx int, content binary")


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``files(path, content)`` as ``folder``/path; gives (path, n_bytes) when run.

    ``folder`` is a URI of a store that pyarrow opens (file, hdfs, s3, ...) or a mount, and all
    executors must see it. A file is written beside its place and moved there, so a task
    that runs twice leaves the same whole file.
    """

    def run(batches):
        import posixpath
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        root = posixpath.normpath(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = posixpath.normpath(posixpath.join(root, path))
                if not at.startswith(root + "/"):
                    raise ValueError(f"{path} lies outside {folder}")
                store.create_dir(posixpath.dirname(at), recursive=True)
                beside = f"{at}.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content)
                store.move(beside, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in batch.column(1).to_pylist()], pa.int64())], names=["path", "n_bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, n_bytes long")
