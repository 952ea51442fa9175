"""Queries over synthetic rasters drawn from the tables, with the SQL of each.

Frames: 64 rows of ``embeddings`` make one 64 x 64 mosaic of 12-bit samples. Byte
images: the UTF-8 bytes of each document are one row of 8-bit samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import color, selection, stencil
from ..sources import reader, sinks

_FRAMES_SQL = """frames AS (
  SELECT CAST(vec_id // 64 AS BIGINT) AS frame, CAST(vec_id % 64 AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, greatest(0.0, least(4095.0, floor((CAST(e AS DOUBLE) + 1.0) * 2048.0))) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, v)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return rows.select(F.expr("vec_id div 64").alias("frame"), F.expr("cast(vec_id % 64 as int)").alias("y"), "x", color.clamp(F.floor((F.col("e").cast("double") + 1.0) * 2048.0).cast("double"), 0.0, 4095.0).alias("v"))


def _pixel_rows(frames_: DataFrame) -> DataFrame:
    """Frames as pixels of one image in one file each."""
    return frames_.select(F.col("frame").cast("string").alias("path"), F.lit(0).alias("image_idx"), "y", "x", F.lit(0).alias("c"), "v")


def _files(spark, sf_dir, **options) -> DataFrame:
    return sinks.to_containers(_pixel_rows(frames(spark, sf_dir)), **options)


def _round_trip(bits: int, **options):
    def run(spark, sf_dir):
        got = reader.pixels(reader.rasters(_files(spark, sf_dir, bits=bits, **options)))
        return got.select(F.col("path").cast("long").alias("frame"), "y", "x", "v")

    return run


QUERIES, ORACLE_SQL = {}, {}
_SAME = f"WITH {_FRAMES_SQL} SELECT frame, y, x, v FROM frames"
for _name, _options in {
    "unpack12": {"bits": 12}, "unpack14": {"bits": 14}, "unpack16": {"bits": 16}, "unpack16_big_endian": {"bits": 16, "big_endian": True}, "lzw_round_trip": {"bits": 16, "compression": "lzw"},
    "lzw_predictor2_round_trip": {"bits": 16, "compression": "lzw", "predictor": 2}, "deflate_round_trip": {"bits": 16, "compression": "deflate"}, "ljpeg_round_trip": {"bits": 12, "compression": "ljpeg"},
}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _round_trip(**_options), _SAME


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {_FRAMES_SQL} SELECT frame AS path, count(DISTINCT x) AS width, count(DISTINCT y) AS height, 12 AS bits_per_sample_original, 4095 AS white, true AS ok
FROM frames GROUP BY frame""")
def header_parse(spark, sf_dir):
    got = reader.images(_files(spark, sf_dir, bits=12))
    return got.select(F.col("path").cast("long"), F.col("width").cast("long"), F.col("height").cast("long"), F.col("bits_per_sample_original").cast("int"), F.element_at("white_level", 1).cast("int").alias("white"), F.lit(True).alias("ok"))


@query(f"WITH {_FRAMES_SQL} SELECT frame AS path, unnest([256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339]) AS tag FROM (SELECT DISTINCT frame FROM frames)")
def tag_scan(spark, sf_dir):
    return reader.tags(_files(spark, sf_dir, bits=12)).select(F.col("path").cast("long"), "tag")


@query("""SELECT doc_id, octet_length(encode(coalesce(text, ''))) >= 32 AND substr(text, 1, 2) IN ('II', 'MM') AS is_container FROM documents""")
def sniff(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", reader.is_container(F.coalesce("text", F.lit("")).cast("binary")).alias("is_container"))


def _pixel(name, build, columns_sql, places=6):
    """A query of per-pixel columns; results are rounded, to more places where exact halves of the sixth occur."""

    def run(spark, sf_dir):
        df = frames(spark, sf_dir)
        return df.select("frame", "y", "x", *[F.round(c, places).alias(n) for n, c in build(F.col("v")).items()])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_FRAMES_SQL} SELECT frame, y, x, {', '.join(f'round({s}, {places}) AS {n}' for n, s in columns_sql.items())} FROM frames"


_R, _G, _B = "(v / 4096.0)", "(v / 8192.0)", "((4096.0 - v) / 4096.0)"


def _rgb(v):
    return v / 4096.0, v / 8192.0, (4096.0 - v) / 4096.0


def _named(rgb):
    return dict(zip("rgb", rgb))


_pixel("black_subtract", lambda v: {"v": color.black_subtract(v, F.lit(256.0), F.lit(3000.0))}, {"v": "greatest(0.0, least(v - 256.0, 3000.0))"})
_pixel("expose", lambda v: {"v": color.expose(v, 1.5, F.lit(256.0), F.lit(4095.0))}, {"v": "1.5 * v / (4095.0 - 256.0)"})
_pixel("normalise", lambda v: {"v": color.normalise(v, F.lit(16.0))}, {"v": "v / 65536.0"})
_pixel("gamma8", lambda v: {"v": color.gamma8(v / 16.0)}, {"v": "greatest(0.0, least(pow(v / 16.0 / 255.0, 1 / 2.2), 1.0))"})
_pixel("gamma16", lambda v: {"v": color.gamma16(v * 16.0)}, {"v": "greatest(0.0, least(pow(v * 16.0 / 65536.0, 1 / 2.2), 1.0))"})
_pixel("display_gamma", lambda v: {"v": color.display_gamma(v / 4096.0, 1.2)}, {"v": "greatest(0.0, least(pow(greatest(v / 4096.0 * 1.2, 0.0), 1 / 2.2), 1.0))"})
_M = [[0.5, 0.25, 0.125], [0.25, 1.0, 0.5], [0.125, 0.25, 0.75]]
_pixel("color_matrix", lambda v: _named(color.matrix3(_rgb(v), _M)), {n: f"{_R} * {_M[0][j]} + {_G} * {_M[1][j]} + {_B} * {_M[2][j]}" for j, n in enumerate("rgb")})
_SEPIA = [[0.5 * w if i != k else 1 - 0.5 * (1 - w) for i, w in enumerate(row)] for k, row in enumerate(((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131)))]
_pixel("sepia", lambda v: _named(color.sepia(_rgb(v), 0.5)), {n: f"least(1.0, {_R} * {_SEPIA[k][0]} + {_G} * {_SEPIA[k][1]} + {_B} * {_SEPIA[k][2]})" for k, n in enumerate("rgb")})
_HUE = ["(2 * cos(0.25 * pi()) + 1) / 3", "(-sqrt(3.0) * sin(0.25 * pi()) - cos(0.25 * pi()) + 1) / 3", "(sqrt(3.0) * sin(0.25 * pi()) - cos(0.25 * pi()) + 1) / 3"]
_TURN = [f"({_R} * {_HUE[a]} + {_G} * {_HUE[b]} + {_B} * {_HUE[c]})" for a, b, c in ((0, 1, 2), (2, 0, 1), (1, 2, 0))]
_pixel("hue_saturation", lambda v: _named(color.hue_saturation(_rgb(v), 0.25, 0.5)), {n: f"{t} + (({_TURN[0]} + {_TURN[1]} + {_TURN[2]}) / 3 - {t}) * (1 - 1 / (1.001 - 0.5))" for n, t in zip("rgb", _TURN)})
_pixel("brightness_contrast", lambda v: {"v": color.brightness_contrast(v / 4096.0, 0.1, 0.25)}, {"v": f"(v / 4096.0 + 0.1 - 0.5) * {1 / 0.75!r}e0 + 0.5"}, 12)
_TOP, _MEAN = f"greatest({_R}, {_G}, {_B})", f"(({_R} + {_G} + {_B}) / 3)"
_pixel("vibrance", lambda v: _named(color.vibrance(_rgb(v), 0.4)), {n: f"{c} + ({_TOP} - {c}) * (({_TOP} - {_MEAN}) * ({-3 * 0.4!r}e0))" for n, c in zip("rgb", (_R, _G, _B))}, 12)
_T = "(v / 4096.0 * 4)"
_pixel("pseudo_color", lambda v: _named(color.pseudo_color(v / 4096.0)), {"r": f"greatest(0.0, least({_T} - 2, 1.0))", "g": f"least({_T}, 1.0, 4 - {_T})", "b": f"greatest(0.0, least(1.0, 2 - {_T}))"})


@query(f"""WITH {_FRAMES_SQL}, across AS (
  SELECT frame, y, x, v, coalesce(lag(v, 1) OVER r, v) AS l1, coalesce(lead(v, 1) OVER r, v) AS r1, coalesce(lag(v, 2) OVER r, lag(v, 1) OVER r, v) AS l2, coalesce(lead(v, 2) OVER r, lead(v, 1) OVER r, v) AS r2
  FROM frames WINDOW r AS (PARTITION BY frame, y ORDER BY x)
), sums AS (
  SELECT frame, y, x, v AS c, l1 + r1 AS h1, l2 + r2 AS h2, coalesce(lag(v, 1) OVER d, v) + coalesce(lead(v, 1) OVER d, v) AS v1,
    coalesce(lag(v, 2) OVER d, lag(v, 1) OVER d, v) + coalesce(lead(v, 2) OVER d, lead(v, 1) OVER d, v) AS v2,
    coalesce(lag(l1, 1) OVER d, l1) + coalesce(lead(l1, 1) OVER d, l1) + coalesce(lag(r1, 1) OVER d, r1) + coalesce(lead(r1, 1) OVER d, r1) AS g
  FROM across WINDOW d AS (PARTITION BY frame, x ORDER BY y)
), parts AS (
  SELECT frame, y, x, c, (8*c + 4*v1 + 4*h1 - 2*v2 - 2*h2) / 16 AS p0, (12*c + 4*g - 3*v2 - 3*h2) / 16 AS p1, (10*c - 2*g + 8*h1 + v2 - 2*h2) / 16 AS p2, (10*c - 2*g + 8*v1 - 2*v2 + h2) / 16 AS p3,
    (y % 2) * 2 + x % 2 AS k FROM sums
)
SELECT frame, y, x, CASE k WHEN 0 THEN c WHEN 1 THEN p2 WHEN 2 THEN p3 ELSE p1 END AS r, CASE k WHEN 0 THEN p0 WHEN 3 THEN p0 ELSE c END AS g, CASE k WHEN 0 THEN p1 WHEN 1 THEN p3 WHEN 2 THEN p2 ELSE c END AS b FROM parts""")
def demosaic(spark, sf_dir):
    return stencil.demosaic(frames(spark, sf_dir))


@query(f"WITH {_FRAMES_SQL} SELECT frame, y, x, CAST(sum(CAST(v AS BIGINT) % 256) OVER (PARTITION BY frame, y ORDER BY x) % 256 AS BIGINT) AS v FROM frames")
def predictor2(spark, sf_dir):
    return stencil.undo_differencing(frames(spark, sf_dir).withColumn("v", F.col("v").cast("long") % 256))


@query(f"""WITH {_FRAMES_SQL}, p AS (
  SELECT frame, y, x, CAST(v AS BIGINT) AS v, CAST(lag(v) OVER (PARTITION BY frame, y ORDER BY x) AS BIGINT) AS a, CAST(lag(v) OVER (PARTITION BY frame, x ORDER BY y) AS BIGINT) AS b FROM frames
), q AS (SELECT *, lag(a) OVER (PARTITION BY frame, x ORDER BY y) AS d FROM p),
e AS (SELECT abs(v - CASE WHEN a IS NULL AND b IS NULL THEN 2048 WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE b + ((a - d) >> 1) END) AS size FROM q)
SELECT CASE WHEN size = 0 THEN 0 ELSE CAST(floor(log2(size)) AS BIGINT) + 1 END AS ssss, count(*) AS n FROM e GROUP BY 1""")
def ssss_histogram(spark, sf_dir):
    return stencil.category_histogram(frames(spark, sf_dir), 12)


def _layers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("width"), F.max("l_partkey").alias("bits")).select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("image_idx"), "width", "bits")


_LAYERS_SQL = "layers AS (SELECT l_orderkey AS path, l_linenumber AS image_idx, CAST(max(l_quantity) AS INTEGER) AS width, max(l_partkey) AS bits FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_LAYERS_SQL} SELECT path, image_idx, width, bits FROM layers QUALIFY row_number() OVER (PARTITION BY path ORDER BY width DESC, image_idx) = 1")
def largest_layer(spark, sf_dir):
    return selection.largest(_layers(spark, sf_dir))


@query(f"WITH {_LAYERS_SQL} SELECT path, image_idx, width, bits FROM layers QUALIFY row_number() OVER (PARTITION BY path ORDER BY width DESC, bits DESC, image_idx) = 1")
def largest_layer_bits(spark, sf_dir):
    return selection.largest(_layers(spark, sf_dir), by=("width", "bits"))


@query(f"WITH {_LAYERS_SQL} SELECT path, image_idx, width, bits FROM layers WHERE image_idx <= 3 QUALIFY row_number() OVER (PARTITION BY path ORDER BY image_idx DESC) = 1")
def chosen_layer(spark, sf_dir):
    return selection.layer(_layers(spark, sf_dir), 3)


@query(f"WITH {_LAYERS_SQL} SELECT path, count(*) AS n_images FROM layers GROUP BY path")
def image_count(spark, sf_dir):
    return _layers(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n_images"))


@query("SELECT s_suppkey AS path, s_nationkey AS my_tag FROM supplier")
def custom_fields(spark, sf_dir):
    from ..sources import container

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_nationkey").alias("n"))

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            made = [container.write([{"tags": container.image_tags(1, 1, 8, tag21264=(9, [n])), "data": b"\0"}]) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    got = reader.images(rows.mapInArrow(build, "path string, content binary"), [(21264, 9, "my_tag")])
    return got.select(F.col("path").cast("long"), _little(F.col("custom_fields")["my_tag"]["data"]).alias("my_tag"))


def _little(data):
    """A little-endian 32-bit number from four bytes."""
    part = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long") * (1 << (8 * i))
    return (part(0) + part(1) + part(2) + part(3)).cast("int")


@query(f"WITH {_FRAMES_SQL} SELECT frame AS path, avg(greatest(0.0, least(v - 256.0, 4095.0))) AS mean_level FROM frames GROUP BY frame")
def mean_level(spark, sf_dir):
    """The flagship: files to headers, the largest layer decoded, black subtracted, averaged."""
    files = _files(spark, sf_dir, bits=12)
    px = reader.pixels(reader.rasters(files))
    best = selection.largest(reader.images(files).select("path", "image_idx", "width", "white_level")).select("path", "image_idx", F.element_at("white_level", 1).alias("white"))
    level = color.black_subtract(F.col("v"), F.lit(256.0), F.col("white"))
    return px.join(best, ["path", "image_idx"]).groupBy(F.col("path").cast("long").alias("path")).agg(F.avg(level).alias("mean_level"))


for _k in range(1, 8):
    QUERIES[f"ljpeg_predictor{_k}"], ORACLE_SQL[f"ljpeg_predictor{_k}"] = _round_trip(bits=12, compression="ljpeg", ljpeg_predictor=_k), _SAME


def _ten_bits(df):
    return df.withColumn("v", F.floor(F.col("v") / 4.0).cast("double"))


@query(f"WITH {_FRAMES_SQL} SELECT frame, y, x, floor(v / 4) AS v FROM frames")
def unpack10(spark, sf_dir):
    px = _ten_bits(frames(spark, sf_dir)).select(F.col("frame").cast("string").alias("path"), F.lit(0).alias("image_idx"), "y", "x", F.lit(0).alias("c"), "v")
    return reader.pixels(reader.rasters(sinks.to_containers(px, bits=10))).select(F.col("path").cast("long").alias("frame"), "y", "x", "v")


@query(f"""WITH {_FRAMES_SQL}, sized AS (SELECT frame, max(y) + 1 AS h FROM frames GROUP BY frame)
SELECT frame AS path, t.tag, t.type, t.count FROM sized, (VALUES (256, 4, 1), (257, 4, 1), (258, 3, 1), (259, 3, 1), (262, 3, 1), (273, 4, 1), (277, 3, 1), (278, 4, 1), (279, 4, 1), (284, 3, 1), (339, 3, 1)) t(tag, type, count)""")
def metadata_dump(spark, sf_dir):
    return reader.tags(_files(spark, sf_dir, bits=12)).select(F.col("path").cast("long"), "tag", "type", F.col("count").cast("int"))


@query(f"WITH {_FRAMES_SQL} SELECT frame AS path, 0 AS seg_idx, 8 AS start, CAST((max(y) + 1) * ((max(x) + 1) * 12 // 8) AS BIGINT) AS byte_count, CAST(max(y) + 1 AS INTEGER) AS n_rows FROM frames GROUP BY frame")
def segment_scan(spark, sf_dir):
    return reader.segments(_files(spark, sf_dir, bits=12)).select(F.col("path").cast("long"), "seg_idx", F.col("offset").cast("int").alias("start"), "byte_count", F.col("rows").cast("int").alias("n_rows"))


@query("SELECT doc_id AS path, octet_length(encode(coalesce(text, ''))) >= 32 AND substr(text, 1, 2) IN ('II', 'MM') AS ok, CAST(0 AS INTEGER) AS n_images FROM documents")
def diagnostics(spark, sf_dir):
    """Texts are not containers: each is reported as a row, none fails the query."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reader.diagnostics(docs.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))).select(F.col("path").cast("long"), "ok", "n_images")


@query(f"WITH {_FRAMES_SQL}, two AS (SELECT frame, 0 AS image_idx, v FROM frames UNION ALL SELECT frame, 1, floor(v / 2) FROM frames) SELECT frame AS path, image_idx, count(*) AS n, sum(v) AS total FROM two GROUP BY 1, 2")
def add_image(spark, sf_dir):
    """Two images of each document by a union of their pixels."""
    one = frames(spark, sf_dir).select(F.col("frame").cast("string").alias("path"), F.lit(0).alias("image_idx"), "y", "x", F.lit(0).alias("c"), "v")
    two = one.withColumn("image_idx", F.lit(1)).withColumn("v", F.floor(F.col("v") / 2).cast("double"))
    px = reader.pixels(reader.rasters(sinks.to_containers(one.unionByName(two), bits=12)))
    return px.groupBy(F.col("path").cast("long").alias("path"), "image_idx").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {_FRAMES_SQL} SELECT frame, y, x, v FROM frames WHERE y >= 8 AND y < 24 AND x >= 16 AND x < 48")
def region(spark, sf_dir):
    px = reader.pixels(reader.rasters(_files(spark, sf_dir, bits=12), region=(8, 16, 24, 48)))
    return px.filter("y >= 8 and y < 24 and x >= 16 and x < 48").select(F.col("path").cast("long").alias("frame"), "y", "x", "v")


@query(f"WITH {_FRAMES_SQL}, sized AS (SELECT frame, max(x) AS w, max(y) AS h FROM frames GROUP BY frame) SELECT f.frame, f.y, f.x, f.v FROM frames f JOIN sized s ON f.frame = s.frame AND f.x = least(10, s.w) AND f.y = least(100000, s.h)")
def point_lookup(spark, sf_dir):
    got = reader.pixel_at(_files(spark, sf_dir, bits=12, rows_per_strip=8), 10, 100000)
    return got.select(F.col("path").cast("long").alias("frame"), "y", "x", "v")


@query(f"WITH {_FRAMES_SQL} SELECT frame, max(y) OVER (PARTITION BY frame) - y AS y, x, round(1.5 * v / 3839.0, 6) AS v FROM frames")
def expose_flip(spark, sf_dir):
    rows = frames(spark, sf_dir)
    sizes = rows.groupBy("frame").agg((F.max("y") + 1).alias("height"))
    return rows.join(sizes, "frame").select("frame", color.flip(F.col("y"), F.col("height")).alias("y"), "x", F.round(color.expose(F.col("v"), 1.5, F.lit(256.0), F.lit(4095.0)), 6).alias("v"))


@query(f"""WITH {_FRAMES_SQL}, s AS (SELECT frame, y, x, v, CASE x % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 2 END AS spp FROM frames)
SELECT frame, y, x, CASE WHEN spp <> 2 THEN v END AS r, CASE WHEN spp = 1 THEN v WHEN spp <> 2 THEN v + 1 END AS g, CASE WHEN spp = 1 THEN v WHEN spp <> 2 THEN v + 2 END AS b FROM s""")
def channel_map(spark, sf_dir):
    """One, three or four samples to RGB; two are not supported and give nulls."""
    v, k = F.col("v"), F.col("x") % 4
    spp = F.when(k == 0, 1).when(k == 1, 3).when(k == 2, 4).otherwise(2)
    samples = F.when(spp == 1, F.array(v)).when(spp == 2, F.array(v, v + 1)).when(spp == 3, F.array(v, v + 1, v + 2)).otherwise(F.array(v, v + 1, v + 2, v + 3))
    rgb = frames(spark, sf_dir).select("frame", "y", "x", color.to_rgb(samples, spp).alias("rgb"))
    return rgb.select("frame", "y", "x", *[F.col("rgb")[i].alias(n) for i, n in enumerate("rgb")])


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 0 THEN 'R' WHEN 1 THEN 'G' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'M' WHEN 5 THEN 'Y' WHEN 6 THEN 'W' ELSE '?' END AS letter FROM lineitem")
def color_letter(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", color.color_name(F.col("l_linenumber")).alias("letter"))


_TO_SRGB = [[sum(color.XYZ_TO_SRGB[i][k] * color.D50_TO_D65[k][j] for k in range(3)) / (2.0, 1.0, 1.5)[j] for j in range(3)] for i in range(3)]
_pixel("camera_to_srgb", lambda v: _named(color.matrix3(_rgb(v), color.camera_to_srgb([2.0, 1.0, 1.5], [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]))), {n: f"{_R} * {_TO_SRGB[0][j]!r} + {_G} * {_TO_SRGB[1][j]!r} + {_B} * {_TO_SRGB[2][j]!r}" for j, n in enumerate("rgb")})
_WARM, _COOL = [[1.0, 0.0, 0.0], [0.0, 0.5, 0.0], [0.0, 0.0, 0.25]], [[0.5, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 2.0]]
_SHARE = "((1 / 5000.0 - 1 / 7000.0) / (1 / 3200.0 - 1 / 7000.0))"
_pixel("temperature", lambda v: _named(color.matrix3(_rgb(v), color.blend_by_temperature(5000.0, _WARM, _COOL))), {n: f"{c} * ({_SHARE} * {_WARM[j][j]} + (1 - {_SHARE}) * {_COOL[j][j]})" for j, (n, c) in enumerate(zip("rgb", (_R, _G, _B)))})


@query(f"WITH {_FRAMES_SQL} SELECT frame, CAST(4 * count(*) + octet_length(encode(concat('Pf ', max(x) + 1, ' ', max(y) + 1, ' -1.0 '))) AS BIGINT) AS n_bytes, concat('Pf ', max(x) + 1, ' ', max(y) + 1) AS head FROM frames GROUP BY frame")
def pfm_sink(spark, sf_dir):
    px = frames(spark, sf_dir).select(F.col("frame").cast("string").alias("path"), F.lit(0).alias("image_idx"), "y", "x", F.lit(0).alias("c"), "v")
    made = sinks.to_float_files(px)
    text = F.decode(F.substring(F.col("content"), 1, 32), "ISO-8859-1")
    return made.select(F.col("path").cast("long").alias("frame"), F.length("content").cast("long").alias("n_bytes"), F.translate(F.substring_index(text, "\n", 2), "\n", " ").alias("head"))


@query("SELECT s_suppkey AS path, 1 AS list_no, i - 1 AS point, CAST(s_nationkey + (i - 1) * 0.5 AS DOUBLE) AS gain FROM supplier, (VALUES (1), (2), (3), (4)) t(i)")
def gain_map(spark, sf_dir):
    """A 2 x 2 gain map in each file, read back point by point."""
    import struct

    from ..sources import container

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_nationkey").alias("n"))

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for n in batch.column(1).to_pylist():
                body = struct.pack(">10I4dI4f", 0, 0, 4, 4, 0, 1, 1, 1, 2, 2, 0.5, 0.5, 0.0, 0.0, 1, *(n + k * 0.5 for k in range(4)))
                codes = struct.pack(">5I", 1, 9, 1, 0, len(body)) + body
                made.append(container.write([{"tags": container.image_tags(1, 1, 8, tag51008=(7, codes)), "data": b"\0"}]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    got = reader.gainmaps(rows.mapInArrow(build, "path string, content binary")).filter("map_planes = 1")
    return got.select(F.col("path").cast("long"), "list_no", F.posexplode("pixels").alias("point", "gain")).withColumn("gain", F.col("gain").cast("double"))
