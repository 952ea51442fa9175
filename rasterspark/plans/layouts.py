"""Queries over container layouts: strips, tiles, slices, floats, nested directories, typed tags, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import color
from ..sources import container, reader, sinks
from .queries import _FRAMES_SQL, _SAME, _pixel_rows, _round_trip, frames

QUERIES, ORACLE_SQL = {}, {}
for _name, _options in {
    "strips_lzw_round_trip": {"bits": 16, "compression": "lzw", "rows_per_strip": 5}, "strips_big_endian_round_trip": {"bits": 12, "big_endian": True, "rows_per_strip": 7},
    "tiled_round_trip": {"bits": 16, "tile": (48, 48)}, "tiled_ljpeg_round_trip": {"bits": 12, "compression": "ljpeg", "tile": (48, 48)},
    "tiled_deflate_predictor2_round_trip": {"bits": 16, "compression": "deflate", "predictor": 2, "tile": (48, 48)}, "sliced_ljpeg_round_trip": {"bits": 12, "compression": "ljpeg", "slices": (2, 20, 24)},
    "float32_big_endian_round_trip": {"bits": 32, "sample_format": 3, "big_endian": True}, "int32_round_trip": {"bits": 32, "sample_format": 2},
}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _round_trip(**_options), _SAME


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _made(rows, one):
    """(path, content) of ``rows(path, ...)``: ``one`` makes a container's images of a row's other values."""

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            values = zip(*[c.to_pylist() for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([container.write(one(*v)) for v in values], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(build, "path string, content binary")


def _suppliers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_nationkey").alias("n"))


@query(f"""WITH {_FRAMES_SQL} SELECT frame, y, x, 0 AS c, v FROM frames UNION ALL SELECT frame, y, x, 1, floor(v / 2) FROM frames UNION ALL SELECT frame, y, x, 2, 4095 - v FROM frames""")
def rgb16_round_trip(spark, sf_dir):
    one = _pixel_rows(frames(spark, sf_dir))
    px = one.unionByName(one.withColumn("c", F.lit(1)).withColumn("v", F.floor(F.col("v") / 2).cast("double"))).unionByName(one.withColumn("c", F.lit(2)).withColumn("v", 4095 - F.col("v")))
    got = reader.pixels(reader.rasters(sinks.to_containers(px, bits=16)))
    return got.select(F.col("path").cast("long").alias("frame"), "y", "x", "c", "v")


@query("SELECT s_suppkey AS path, k AS image_idx, CASE k WHEN 2 THEN s_nationkey + 1 ELSE s_nationkey + 2 + k END AS width FROM supplier, (VALUES (0), (1), (2)) t(k)")
def sub_directories(spark, sf_dir):
    """Two nested images in each file; they come before the one that holds them."""

    def one(n):
        image = lambda w: {"tags": container.image_tags(w, 1, 8), "data": bytes(w)}
        return [image(n + 1) | {"children": [image(n + 2), image(n + 3)]}]

    return reader.images(_made(_suppliers(spark, sf_dir), one)).select(F.col("path").cast("long"), "image_idx", F.col("width").cast("int"))


@query("SELECT p_partkey AS path, round(p_retailprice, 4) AS gain, round(-p_retailprice / 8, 4) AS weight FROM part")
def rational_tags(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("path"), "p_retailprice")

    def one(price):
        return [{"tags": container.image_tags(1, 1, 8, tag50727=(5, [price, 1.0, 1.0]), tag50721=(10, [-price / 8] + [0.0] * 8)), "data": b"\0"}]

    return reader.images(_made(rows, one)).select(F.col("path").cast("long"), F.round(F.col("analog_balance")[0], 4).alias("gain"), F.round(F.col("color_matrix1")[0], 4).alias("weight"))


@query("SELECT s_suppkey AS path, CAST((1 << (8 + s_nationkey % 9)) - 1 AS BIGINT) AS white, CAST(0 AS BIGINT) AS black FROM supplier")
def white_level(spark, sf_dir):
    """Derived from the depth where no tag tells it."""
    made = _made(_suppliers(spark, sf_dir), lambda n: [{"tags": container.image_tags(1, 1, 8 + n % 9), "data": b"\0\0"}])
    return reader.images(made).select(F.col("path").cast("long"), F.col("white_level")[0].alias("white"), F.col("black_level")[0].alias("black"))


@query("SELECT s_suppkey AS path, s_nationkey % 3 = 0 AS ok FROM supplier")
def unsupported_payloads(spark, sf_dir):
    """A payload that can't be decoded is a row, not a failure."""
    made = _made(_suppliers(spark, sf_dir), lambda n: [{"tags": container.image_tags(1, 1, 8, 1, (1, 34713, 99)[n % 3]), "data": b"\0"}])
    return reader.rasters(made).select(F.col("path").cast("long"), "ok")


@query("SELECT s_suppkey AS path, 'nation ' || s_nationkey AS profile_name, CAST([1, 4, 0, 0] AS BIGINT[])[1 + s_nationkey % 2] AS version, CAST(s_nationkey AS BIGINT) AS area_top, 1 + s_nationkey % 8 AS orientation FROM supplier")
def typed_tags(spark, sf_dir):
    def one(n):
        return [{"tags": container.image_tags(1, 1, 8, tag50936=(2, f"nation {n}"), tag50706=(1, [(1, 4)[n % 2], 0, 0, 0]), tag50829=(4, [n, 0, n + 1, 1]), tag274=(3, [1 + n % 8])), "data": b"\0"}]

    got = reader.images(_made(_suppliers(spark, sf_dir), one))
    return got.select(F.col("path").cast("long"), "profile_name", F.col("version").cast("long"), F.col("active_area")[0].alias("area_top"), F.col("orientation").cast("int"))


@query(f"WITH {_FRAMES_SQL} SELECT frame, y, x, floor(v * v / 4096) AS v FROM frames")
def linearise(spark, sf_dir):
    table = [float(k * k // 4096) for k in range(4096)]
    return frames(spark, sf_dir).select("frame", "y", "x", color.linearise(F.col("v"), table).alias("v"))


@query(f"WITH {_FRAMES_SQL} SELECT frame, CAST(277 + (max(y) + 1) * (16 + 4 * (max(x) + 1)) AS BIGINT) AS n_bytes, '762F3101' AS magic FROM frames GROUP BY frame")
def exr_sink(spark, sf_dir):
    made = sinks.to_float_files(_pixel_rows(frames(spark, sf_dir)), "exr")
    return made.select(F.col("path").cast("long").alias("frame"), F.length("content").cast("long").alias("n_bytes"), F.hex(F.substring("content", 1, 4)).alias("magic"))
