"""Queries over payloads and settings whose expected samples come from the tables or from bytes made by hand."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from ..operators import color
from ..sources import container, reader, sinks
from . import queries
from .layouts import _made, _suppliers
from .queries import _B, _FRAMES_SQL, _G, _R, _SAME, _named, _pixel_rows, _rgb, _round_trip, frames

QUERIES, ORACLE_SQL = {"ljpeg_old_tag": _round_trip(bits=12, compression="ljpeg", tags={259: (3, [6])})}, {"ljpeg_old_tag": _SAME}
#: 2 x 2 samples of 12 bits as a lossless JPEG, put together by hand: 2048 2049 / 2046 2049.
_BY_HAND = bytes.fromhex("ffd8ffc3000b0c0002000201001100ffc400160001010100000000000000000000000000000102ffda00080100000100005cefffd9")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def flat_jpeg(levels: list[int], gray: bool = True) -> bytes:
    """A baseline JPEG of one row of 8 x 8 blocks, each of one level: DC coefficients alone, in four-bit codes."""
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    n = 1 if gray else 3
    frame = struct.pack(">BHHB", 8, 8, 8 * len(levels), n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n))
    scan = bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + bytes([0, 63, 0])
    codes = part(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])) + part(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    bits, before = "", [0] * n
    for level in levels:
        for k in range(n):
            dc = level - 128 if k == 0 else 0
            diff, before[k] = dc - before[k], dc
            size = abs(diff).bit_length()
            bits += f"{size:04b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    stream = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    return b"\xff\xd8" + part(0xDB, bytes([0, *[8] * 64])) + part(0xC0, frame) + codes + part(0xDA, scan) + stream + b"\xff\xd9"


def _flat_sql(channels: int) -> str:
    return f"SELECT s_suppkey AS path, b AS block, c, CAST(CASE b WHEN 0 THEN s_nationkey * 10 ELSE 255 - s_nationkey * 10 END AS DOUBLE) AS low, CAST(CASE b WHEN 0 THEN s_nationkey * 10 ELSE 255 - s_nationkey * 10 END AS DOUBLE) AS high, 64 AS n FROM supplier, (VALUES (0), (1)) t(b), range({channels}) u(c)"


for _name, _compression, _gray in (("jpeg_old_baseline", 6, True), ("jpeg_new_baseline", 7, True), ("jpeg_new_baseline_rgb", 7, False), ("jpeg_lossy", 34892, True), ("jpeg_lossy_rgb", 34892, False)):

    def _flat(spark, sf_dir, compression=_compression, gray=_gray):
        made = _made(_suppliers(spark, sf_dir), lambda n: [{"tags": container.image_tags(16, 8, 8, 1 if gray else 3, compression), "data": flat_jpeg([n * 10, 255 - n * 10], gray)}])
        px = reader.pixels(reader.rasters(made))
        return px.groupBy(F.col("path").cast("long").alias("path"), F.expr("x div 8").cast("int").alias("block"), F.col("c").cast("long").alias("c")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").cast("int").alias("n"))

    QUERIES[_name], ORACLE_SQL[_name] = _flat, _flat_sql(1 if _gray else 3)


@query(f"WITH {_FRAMES_SQL} SELECT frame, y, x, floor(v / 16) AS v FROM frames")
def jpeg_new_lossless_8(spark, sf_dir):
    """Eight bits and the new JPEG tag, but a lossless stream: its frame header decides."""
    px = _pixel_rows(frames(spark, sf_dir)).withColumn("v", F.floor(F.col("v") / 16).cast("double"))
    return reader.pixels(reader.rasters(sinks.to_containers(px, bits=8, compression="ljpeg"))).select(F.col("path").cast("long").alias("frame"), "y", "x", "v")


def _samples(rows):
    return rows.select(F.col("path").cast("long"), "y", "x", "c", "v")


@query("SELECT s_suppkey AS path, p // 4 AS y, p % 4 AS x, CAST(c AS INTEGER) AS c, CAST(s_nationkey + 40 * c + p AS DOUBLE) AS v FROM (SELECT * FROM supplier, range(3) t(c), (SELECT CAST(range AS INTEGER) AS p FROM range(8)) u)")
def separate_planes(spark, sf_dir):
    """Planar configuration 2: each channel has strips of its own."""
    made = _made(_suppliers(spark, sf_dir), lambda n: [{"tags": container.image_tags(4, 2, 8, 3, tag284=(3, [2]), tag278=(4, [1])), "data": [bytes(range(n + 40 * c + 4 * y, n + 40 * c + 4 * y + 4)) for c in range(3) for y in range(2)]}])
    return _samples(reader.pixels(reader.rasters(made)))


@query("SELECT s_suppkey AS path, CAST((1 << (8 + s_nationkey % 9)) - 1 AS BIGINT) AS white FROM supplier")
def white_level_clamp(spark, sf_dir):
    """A tag beyond the depth."""
    made = _made(_suppliers(spark, sf_dir), lambda n: [{"tags": container.image_tags(1, 1, 8 + n % 9, tag50717=(4, [70000])), "data": b"\0\0"}])
    return reader.images(made).select(F.col("path").cast("long"), F.col("white_level")[0].alias("white"))


@query("SELECT s_suppkey AS path, y, 0 AS x, 0 AS c, CAST(v AS DOUBLE) AS v FROM supplier, (VALUES (0, 2048), (1, 2046)) t(y, v)")
def ljpeg_wider_than_image(spark, sf_dir):
    made = _made(_suppliers(spark, sf_dir), lambda n: [{"tags": container.image_tags(1, 2, 12, 1, 7), "data": _BY_HAND}])
    return _samples(reader.pixels(reader.rasters(made)))


@query("SELECT s_suppkey AS path, y, x, 0 AS c, CAST(CASE WHEN y = 0 AND x < 2 THEN 2048 + x WHEN y = 1 AND x < 2 THEN 2046 + 3 * x ELSE 0 END AS DOUBLE) AS v FROM supplier, (VALUES (0), (1), (2)) t(y), (VALUES (0), (1), (2)) u(x)")
def ljpeg_smaller_than_tile(spark, sf_dir):
    made = _made(_suppliers(spark, sf_dir), lambda n: [{"tags": container.image_tags(3, 3, 12, 1, 7, tag322=(4, [4]), tag323=(4, [4])), "data": [_BY_HAND]}])
    return _samples(reader.pixels(reader.rasters(made, spread=True)))


@query("SELECT s_suppkey AS path, 0 AS width, 0 AS height, 8 AS bits, 0 AS n_segments FROM supplier")
def preview_is_skipped(spark, sf_dir):
    """No compression, but a JPEG byte count: a preview file, which has no samples."""

    def one(n):
        tags = container.image_tags(16, 8, 8, tag514=(4, [100 + n]))
        del tags[258]
        return [{"tags": tags, "data": flat_jpeg([n])}]

    made = _made(_suppliers(spark, sf_dir), one)
    n = reader.segments(made).groupBy("path").agg(F.count("*").alias("n"))
    rows = reader.images(made).join(n, "path", "left")
    return rows.select(F.col("path").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), F.col("bits_per_sample_original").cast("int").alias("bits"), F.coalesce("n", F.lit(0)).cast("int").alias("n_segments"))


@query("SELECT s_suppkey AS path, CAST(4294967295 AS BIGINT) AS rows_per_strip, CAST(1 AS BIGINT) AS strips, CAST(s_nationkey AS DOUBLE) AS v FROM supplier")
def one_strip_value(spark, sf_dir):
    """The largest number of rows per strip means one strip."""
    made = _made(_suppliers(spark, sf_dir), lambda n: [{"tags": container.image_tags(1, 1, 8, tag278=(4, [4294967295])), "data": bytes([n])}])
    return reader.images(made).join(reader.pixels(reader.rasters(made)), ["path", "image_idx"]).select(F.col("path").cast("long"), "rows_per_strip", F.col("strips_per_image").alias("strips"), "v")


@query("SELECT s_suppkey AS path, k AS kind, CAST(1 AS BIGINT) AS reports, true AS survived FROM supplier, range(7) t(k)")
def damaged_files(spark, sf_dir):
    """Files of every codec with bytes changed and cut off: each is reported once and no relation fails."""
    rows = _suppliers(spark, sf_dir).select("path", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).select(F.concat_ws(":", "path", "k").alias("path"), F.xxhash64("path", "k").alias("seed"), "k")

    def one(seed, k):
        r = np.random.default_rng(seed & 0xFFFFFFFF)
        v = r.integers(0, 256, (6, 8, 1))
        tags = container.image_tags(8, 6, 8, 1, (1, 5, 8, 7, 7, 34892, 7)[k])
        payload = sinks.encode_samples(v, 8, ("none", "lzw", "deflate", "ljpeg")[k]) if k < 4 else flat_jpeg([50], k == 4)
        if k == 6:
            payload, tags[50752] = sinks.encode_samples(v, 8, "ljpeg"), (3, [1, 3, 5])
        return [{"tags": tags, "data": payload}]

    def damaged(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = np.random.default_rng(sum(path.encode()))
                b = bytearray(content[: int(r.integers(8, len(content) + 1))])
                for _ in range(int(r.integers(0, 4))):
                    b[int(r.integers(8, len(b)) if len(b) > 8 else 0)] = int(r.integers(0, 256))
                out.append(bytes(b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    files = _made(rows, one).mapInArrow(damaged, "path string, content binary")
    count = lambda rel, name: rel.groupBy("path").agg(F.count("*").alias(name))
    got = count(reader.diagnostics(files), "reports").join(count(reader.images(files), "i"), "path", "left").join(count(reader.rasters(files), "r"), "path", "left").join(count(reader.tags(files), "t"), "path", "left")
    place = F.split("path", ":")
    return got.select(place[0].cast("long").alias("path"), place[1].cast("long").alias("kind"), "reports", (F.coalesce("i", F.lit(0)) <= 1).alias("survived"))


@query("SELECT p_partkey AS path, p_retailprice AS d, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS f, CAST(p_size AS DOUBLE) AS u64, CAST(-p_size AS DOUBLE) AS i64, CAST(p_size AS BIGINT) AS numerator, CAST(7 AS BIGINT) AS denominator FROM part")
def numbers_of_tags(spark, sf_dir):
    """Float, double and 64-bit tags, and both parts of a rational."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("path"), "p_retailprice", "p_size")
    made = _made(rows, lambda price, size: [{"tags": container.image_tags(1, 1, 8, tag60001=(12, [price]), tag60002=(11, [price]), tag60003=(16, [size]), tag60004=(17, [-size]), tag282=(5, [(size, 7)])), "data": b"\0"}])
    value = lambda tag, c="numbers": F.max(F.when(F.col("tag") == tag, F.col(c)[0]))
    got = reader.tags(made).groupBy(F.col("path").cast("long").alias("path")).agg(value(60001).alias("d"), value(60002).alias("f"), value(60003).alias("u64"), value(60004).alias("i64"), value(282, "pairs").alias("p"))
    return got.select("path", "d", "f", "u64", "i64", "p.numerator", "p.denominator")


@query("SELECT s_suppkey AS path FROM supplier WHERE s_nationkey % 2 = 0")
def whole_files_only(spark, sf_dir):
    """DROPMALFORMED: files whose directory is cut off are left out."""
    made = _made(_suppliers(spark, sf_dir), lambda n: [{"tags": container.image_tags(1, 1, 8), "data": bytes([n])}]).withColumn("n", F.length("content"))
    nation = _suppliers(spark, sf_dir)
    cut = made.join(nation.withColumnRenamed("n", "nation"), "path").select("path", F.when(F.col("nation") % 2 == 0, F.col("content")).otherwise(F.expr("substring(content, 1, n - 20)")).alias("content"))
    return reader.images(cut, mode="DROPMALFORMED").select(F.col("path").cast("long"))


@query("SELECT s_suppkey AS path, CAST(k * 256 AS DOUBLE) + s_nationkey AS swapped, CAST(s_nationkey * 256 + k AS DOUBLE) AS kept FROM supplier, (VALUES (3)) t(k)")
def raw_bytes(spark, sf_dir):
    """Big-endian samples, swapped and as they lie."""

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            made = [container.write([{"tags": container.image_tags(1, 1, 16), "data": bytes([3, n])}], True) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    files = _suppliers(spark, sf_dir).mapInArrow(build, "path string, content binary")
    one = reader.rasters(files).select("path", F.col("samples")[0].alias("swapped"))
    return one.join(reader.rasters(files, raw_bytes=True).select("path", F.col("samples")[0].alias("kept")), "path").select(F.col("path").cast("long"), "swapped", "kept")


_N = "s_nationkey"
_FIELDS = {
    "cfa_pattern_dim": ((3, lambda n: [2, 2]), 33421, "2.0"), "cfa_pattern": ((1, lambda n: [n % 3, 1, 1, 2]), 33422, f"{_N} % 3"), "cfa_plane_color": ((1, lambda n: [n % 2, 1, 2]), 50710, f"{_N} % 2"),
    "cfa_layout": ((3, lambda n: [1 + n % 5]), 50711, f"1 + {_N} % 5"), "color_matrix2": ((10, lambda n: [n / 4] + [0.0] * 8), 50722, f"{_N} / 4.0"), "camera_calibration1": ((10, lambda n: [-n / 8] + [0.0] * 8), 50723, f"-{_N} / 8.0"),
    "camera_calibration2": ((10, lambda n: [n / 2] + [0.0] * 8), 50724, f"{_N} / 2.0"), "as_shot_neutral": ((5, lambda n: [n / 4, 1.0, 1.0]), 50728, f"{_N} / 4.0"), "calibration_illuminant1": ((3, lambda n: [n]), 50778, _N),
    "calibration_illuminant2": ((3, lambda n: [n + 1]), 50779, f"{_N} + 1"), "profile_tone_curve": ((11, lambda n: [n / 2, 1.0]), 50940, f"{_N} / 2.0"), "profile_embed_policy": ((4, lambda n: [n % 4]), 50941, f"{_N} % 4"),
    "forward_matrix1": ((10, lambda n: [n / 4] + [0.0] * 8), 50964, f"{_N} / 4.0"), "forward_matrix2": ((10, lambda n: [-n / 4] + [0.0] * 8), 50965, f"-{_N} / 4.0"), "noise_profile": ((12, lambda n: [n / 16, 0.5]), 51041, f"{_N} / 16.0"),
    "black_level": ((3, lambda n: [n]), 50714, _N), "planar_configuration": ((3, lambda n: [1 + n % 2]), 284, f"1 + {_N} % 2"),
}


@query(f"SELECT s_suppkey AS path, 'layer ' || {_N} AS semantic_name, {', '.join(f'CAST({sql} AS DOUBLE) AS {n}' for n, (_, _, sql) in _FIELDS.items())} FROM supplier")
def image_fields(spark, sf_dir):
    """Typed fields of the image relation; the first value of lists."""

    def one(n):
        tags = {tag: (kind, values(n)) for (kind, values), tag, _ in _FIELDS.values()}
        return [{"tags": container.image_tags(1, 1, 8) | tags | {52526: (2, f"layer {n}")}, "data": b"\0"}]

    got = reader.images(_made(_suppliers(spark, sf_dir), one))
    first = lambda name: (F.col(name)[0] if got.schema[name].dataType.typeName() == "array" else F.col(name)).cast("double").alias(name)
    return got.select(F.col("path").cast("long"), "semantic_name", *map(first, _FIELDS))


_M9, _M9_SQL = "array(n / 4D, 0D, 1D, 2D, 3D, 4D, 5D, 6D, 7D)", "s_nationkey / 4.0 + 28"
#: column, its Spark expression, tag, number of values, their sum in SQL
_SET = (
    ("subfile_type", "n % 8", 254, 1, f"{_N} % 8"), ("photometric", "1", 262, 1, "1"), ("orientation", "1 + n % 8", 274, 1, f"1 + {_N} % 8"), ("x_resolution", "1D", 282, 1, "1"), ("y_resolution", "1.25D", 283, 1, "1.25"),
    ("planar_configuration", None, 284, 1, "1"), ("resolution_unit", "1 + n % 3", 296, 1, f"1 + {_N} % 3"), ("cfa_repeat_pattern_dim", "array(2, 2)", 33421, 2, "4"), ("cfa_pattern", "array(0, 1, 1, 2)", 33422, 4, "4"),
    ("dng_version", "array(1, 4, 0, 0)", 50706, 4, "5"), ("black_level_repeat_dim", "array(1, 1)", 50713, 2, "2"), ("black_level", "array(n * 3)", 50714, 1, f"{_N} * 3"), ("white_level_rational", "array(200.5D)", 50717, 1, "200.5"),
    ("color_matrix1", _M9, 50721, 9, _M9_SQL), ("color_matrix2", _M9, 50722, 9, _M9_SQL), ("camera_calibration1", _M9, 50723, 9, _M9_SQL), ("camera_calibration2", _M9, 50724, 9, _M9_SQL), ("analog_balance", "array(0.5D)", 50727, 1, "0.5"),
    ("as_shot_neutral", "array(0.25D, 1D)", 50728, 2, "1.25"), ("as_shot_white_xy", "array(0.375D, 0.25D)", 50729, 2, "0.625"), ("calibration_illuminant1", "n", 50778, 1, _N), ("calibration_illuminant2", "21", 50779, 1, "21"),
    ("active_area", "array(0, 0, n, 1)", 50829, 4, f"{_N} + 1"), ("forward_matrix1", _M9, 50964, 9, _M9_SQL), ("forward_matrix2", _M9, 50965, 9, _M9_SQL), ("custom_long", "map(60100, -n)", 60100, 1, f"-{_N}"),
    ("custom_ulong", "map(60101, n + 4000000000)", 60101, 1, f"{_N} + 4000000000"), ("width", None, 256, 1, "1"), ("height", None, 257, 1, "1"), ("bits", None, 258, 1, "8"), ("rows_per_strip", None, 278, 1, "1"),
)


def _one_pixel(spark, sf_dir):
    return _suppliers(spark, sf_dir).select("path", F.lit(0).alias("image_idx"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0).alias("c"), F.col("n").cast("double").alias("v"))


@query(" UNION ALL ".join(f"SELECT s_suppkey AS path, {tag} AS tag, CAST({n} AS BIGINT) AS n, CAST({total} AS DOUBLE) AS total, CAST(NULL AS VARCHAR) AS words FROM supplier" for _, _, tag, n, total in _SET) + "".join(f" UNION ALL SELECT s_suppkey, {tag}, length('{word} ' || {_N}) + 1, CAST(NULL AS DOUBLE), '{word} ' || {_N} FROM supplier" for tag, word in ((270, "bora"), (305, "made by"), (50708, "model"))))
def settings_from_columns(spark, sf_dir):
    """Every setting written from a column of its own, row by row, and read back as a tag."""
    words = [F.concat(F.lit(f"{w} "), "n").alias(c) for c, w in (("image_description", "bora"), ("software", "made by"), ("unique_camera_model", "model"))]
    headers = _suppliers(spark, sf_dir).select("path", *words, *[F.expr(v).alias(c) for c, v, *_ in _SET if v is not None])
    made = sinks.to_containers(_one_pixel(spark, sf_dir), bits=8, big_endian=True, headers=headers)
    got = reader.tags(made).filter(~F.col("tag").isin(259, 273, 277, 279, 339))
    text = F.when(F.col("type") == 2, F.expr("decode(substring(raw, 1, length(raw) - 1), 'UTF-8')"))
    return got.select(F.col("path").cast("long"), "tag", F.col("count").alias("n"), F.aggregate("numbers", F.lit(0.0), lambda a, b: a + b).alias("total"), text.alias("words"))


@query(f"SELECT s_suppkey AS path, {_N} % 5 = 0 AS written FROM supplier")
def settings_keep_rules(spark, sf_dir):
    """An orientation of 9, an empty text, five numbers of an area, a negative balance: no file, but a reason."""
    n = F.col("n") % 5
    headers = _suppliers(spark, sf_dir).select(
        "path",
        F.when(n == 1, 9).otherwise(1).alias("orientation"),
        F.when(n == 2, "").otherwise("s").alias("software"),
        F.when(n == 3, F.array(*map(F.lit, range(5)))).otherwise(F.array(*map(F.lit, range(4)))).alias("active_area"),
        F.when(n == 4, F.array(F.lit(-1.0))).otherwise(F.array(F.lit(1.0))).alias("analog_balance"),
    )
    made = sinks.to_containers(_one_pixel(spark, sf_dir), bits=8, headers=headers)
    return made.select(F.col("path").cast("long"), (F.col("content").isNotNull() & (F.col("err") == "")).alias("written"))


@query(f"WITH {_FRAMES_SQL} SELECT frame, kind, y, x, v FROM frames, (VALUES ('exr'), ('pfm')) t(kind)")
def float_sink_samples(spark, sf_dir):
    """Every sample of both float formats, found by their fixed layouts."""
    px = _pixel_rows(frames(spark, sf_dir))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "pfm":
                    _, size, _, body = content.split(b"\n", 3)
                    w, h = map(int, size.split())
                    v = np.frombuffer(body, "<f4").reshape(h, w)
                else:
                    at = content.index(b"dataWindow\0box2i\0") + 21
                    _, _, x1, y1 = struct.unpack_from("<4i", content, at)
                    w, h = x1 + 1, y1 + 1
                    head = content.index(b"screenWindowWidth\0float\0") + 33
                    places = struct.unpack_from(f"<{h}Q", content, head)
                    v = np.stack([np.frombuffer(content, "<f4", w, p + 8) for p in places])
                y, x = np.indices(v.shape)
                yield pa.RecordBatch.from_arrays([pa.array([int(path)] * v.size), pa.array([kind] * v.size), pa.array(y.ravel(), pa.int32()), pa.array(x.ravel(), pa.int32()), pa.array(v.ravel().astype(float))], names=["frame", "kind", "y", "x", "v"])

    both = [sinks.to_float_files(px, k).select("path", "content", F.lit(k).alias("kind")) for k in ("pfm", "exr")]
    return both[0].unionByName(both[1]).mapInArrow(read, "frame long, kind string, y int, x int, v double")


@query(f"""WITH {_FRAMES_SQL}, s AS (SELECT frame, y, x, v, CASE x % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS bits FROM frames)
SELECT frame, y, x, round(CASE bits WHEN 8 THEN least(1.0, pow(v / 255.0, 1 / 2.2)) WHEN 16 THEN least(1.0, pow(v / 65536.0, 1 / 2.2)) ELSE v END, 6) AS g FROM s""")
def display_by_depth(spark, sf_dir):
    bits = F.when(F.col("x") % 3 == 0, 8).when(F.col("x") % 3 == 1, 16).otherwise(32)
    rgb = color.to_display(F.array(F.col("v"), F.col("v"), F.col("v"), F.lit(0.0)), F.lit(4), bits, F.lit(True))
    return frames(spark, sf_dir).select("frame", "y", "x", F.round(rgb[1], 6).alias("g"))


_CAMERA, _BALANCE = [[0.7, 0.2, 0.1], [0.15, 0.9, -0.05], [0.02, 0.25, 0.6]], [2.0, 1.0, 1.5]
_CHAIN = np.array(color.XYZ_TO_SRGB) @ np.array(color.D50_TO_D65) @ np.linalg.inv(np.diag(_BALANCE) @ np.array(_CAMERA))
_BLEND = [[(1 - t) * w + t * c for w, c in zip(a, b)] for t in [(1 / 2500 - 1 / 3200) / (1 / 7000 - 1 / 3200)] for a, b in zip(color.WARM_3200, color.COOL_7000)]
for _name, _build, _sql, _places in (
    ("camera_to_srgb_full", lambda v: _named(color.matrix3(_rgb(v), color.camera_to_srgb(_BALANCE, _CAMERA))), {n: f"{_R} * {float(_CHAIN[0][j])!r} + {_G} * {float(_CHAIN[1][j])!r} + {_B} * {float(_CHAIN[2][j])!r}" for j, n in enumerate("rgb")}, 6),
    ("temperature_3x4", lambda v: _named(color.affine3(_rgb(v), color.blend_by_temperature(2500.0, beyond=True))), {n: f"{_R} * {m[0]!r}e0 + {_G} * {m[1]!r}e0 + {_B} * {m[2]!r}e0 + {m[3]!r}e0" for n, m in zip("rgb", _BLEND)}, 6),
    ("saturation_below_zero", lambda v: _named(color.hue_saturation(_rgb(v), 0.0, -0.25)), {n: f"{c} + (({_R} + {_G} + {_B}) / 3 - {c}) * 0.25" for n, c in zip("rgb", (_R, _G, _B))}, 9),
    ("contrast_below_zero", lambda v: {"v": color.brightness_contrast(v / 4096.0, 0.1, -0.25)}, {"v": "(v / 4096.0 + 0.1 - 0.5) * 0.75e0 + 0.5"}, 12),
):
    queries._pixel(_name, _build, _sql, _places)
    QUERIES[_name], ORACLE_SQL[_name] = queries.QUERIES.pop(_name), queries.ORACLE_SQL.pop(_name)
