"""Choosing images of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def largest(images: DataFrame, key: str = "path", idx: str = "image_idx", by: tuple[str, ...] = ("width",)) -> DataFrame:
    """The widest image of each file (then by further columns; the first of ties), by partial aggregation."""
    rank = F.struct(*[F.col(c) for c in by], (-F.col(idx)).alias("_last"))
    best = images.groupBy(key).agg(F.max_by(F.struct(*[c for c in images.columns if c != key]), rank).alias("_best"))
    return best.select(key, "_best.*")


def layer(images: DataFrame, number: int, key: str = "path", idx: str = "image_idx") -> DataFrame:
    """The image with a number, or the last one if there are fewer."""
    rows = images.filter(F.col(idx) <= number)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(idx)).alias("_best"))
    return best.select(key, "_best.*")


def point(pixels: DataFrame, sizes: DataFrame, x: int, y: int, key: tuple[str, ...] = ("path", "image_idx")) -> DataFrame:
    """The samples of each image at (x, y), moved to its edge if beyond; ``sizes(*key, width, height)`` holds one row an image."""
    at = sizes.select(*key, F.greatest(F.lit(0), F.least(F.lit(x), F.col("width") - 1)).alias("x"), F.greatest(F.lit(0), F.least(F.lit(y), F.col("height") - 1)).alias("y"))
    return pixels.join(at, [*key, "x", "y"], "left_semi")
