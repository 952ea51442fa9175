"""Operators that look at neighbours, as windows over rows and columns of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _neighbours(df: DataFrame, value: str, w: W, first: str, second: str, back: str, forth: str) -> DataFrame:
    """Columns of the values 1 and 2 places back and forth, the edge repeated."""
    v = F.col(value)
    df = df.withColumn(first, F.coalesce(F.lag(value, 1).over(w), v)).withColumn(back, F.lead(value, 1).over(w)).withColumn(back, F.coalesce(back, v))
    return df.withColumn(second, F.coalesce(F.lag(value, 2).over(w), F.col(first))).withColumn(forth, F.coalesce(F.lead(value, 2).over(w), F.col(back)))


def demosaic(df: DataFrame, frame: str = "frame", value: str = "v") -> DataFrame:
    """RGGB mosaic (frame, y, x, v) -> r, g, b by the 5x5 linear kernels of Malvar, He and Cutler (2004), edges clamped."""
    across, down = W.partitionBy(frame, "y").orderBy("x"), W.partitionBy(frame, "x").orderBy("y")
    df = _neighbours(df, value, across, "_l1", "_l2", "_r1", "_r2")
    df = _neighbours(df, value, down, "_u1", "_u2", "_d1", "_d2")
    for side in ("_l1", "_r1"):
        df = df.withColumn(side + "u", F.coalesce(F.lag(side, 1).over(down), F.col(side))).withColumn(side + "d", F.coalesce(F.lead(side, 1).over(down), F.col(side)))
    c, h1, h2, v1, v2 = F.col(value), F.expr("_l1 + _r1"), F.expr("_l2 + _r2"), F.expr("_u1 + _d1"), F.expr("_u2 + _d2")
    d = F.expr("_l1u + _l1d + _r1u + _r1d")
    p0, p1 = (8 * c + 4 * v1 + 4 * h1 - 2 * v2 - 2 * h2) / 16, (12 * c + 4 * d - 3 * v2 - 3 * h2) / 16
    p2, p3 = (10 * c - 2 * d + 8 * h1 + v2 - 2 * h2) / 16, (10 * c - 2 * d + 8 * v1 - 2 * v2 + h2) / 16
    phase = (F.col("y") % 2) * 2 + F.col("x") % 2
    pick = lambda a, b, e, f: F.when(phase == 0, a).when(phase == 1, b).when(phase == 2, e).otherwise(f)
    return df.select(frame, "y", "x", pick(c, p2, p3, p1).alias("r"), pick(p0, c, c, p0).alias("g"), pick(p1, p3, p2, c).alias("b"))


def undo_differencing(df: DataFrame, frame: str = "frame", value: str = "v", bits: int = 8) -> DataFrame:
    """Predictor 2: running sums along each row."""
    w = W.partitionBy(frame, "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.sum(value).over(w).cast("long") % (1 << bits))


def category_histogram(df: DataFrame, precision: int, frame: str = "frame", value: str = "v") -> DataFrame:
    """(ssss, n): bit lengths of predictor-6 residuals, as an entropy coder counts them."""
    across, down = W.partitionBy(frame, "y").orderBy("x"), W.partitionBy(frame, "x").orderBy("y")
    df = df.select(frame, "y", "x", F.col(value).cast("long").alias("v")).withColumn("a", F.lag("v").over(across)).withColumn("b", F.lag("v").over(down))
    df = df.withColumn("d", F.lag("a").over(down))
    guess = F.when(F.col("a").isNull() & F.col("b").isNull(), F.lit(1 << (precision - 1))).when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).otherwise(F.col("b") + F.shiftright(F.col("a") - F.col("d"), 1))
    size = F.abs(F.col("v") - guess)
    return df.select(F.when(size == 0, 0).otherwise(F.length(F.bin(size))).cast("long").alias("ssss")).groupBy("ssss").agg(F.count("*").alias("n"))
