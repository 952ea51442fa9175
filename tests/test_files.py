"""Files in a folder: written, read, streamed and dumped."""

from pyspark.sql import functions as F

from rasterspark import __main__ as dump
from rasterspark.plans.queries import _files
from rasterspark.sources import reader, sinks
from rasterspark.streaming.ingest import stream_files

SF = "/root/testdata/sf0.001"


def test_folder(spark, tmp_path, capsys):
    files = _files(spark, SF, bits=12).withColumn("path", F.concat("path", F.lit(".tif")))
    want = files.count()
    saved = sinks.save_files(files, str(tmp_path / "in")).collect()
    assert len(saved) == want == len(list((tmp_path / "in").iterdir()))
    (tmp_path / "in" / "other.txt").write_text("not a container, but long enough to be looked at")
    read = reader.images(reader.read_files(spark, str(tmp_path / "in")))
    assert read.filter("bits_per_sample_original = 12").count() == want
    dump.main(str(tmp_path / "in"))
    assert len(capsys.readouterr().out.splitlines()) == want
    px = reader.pixels(reader.rasters(stream_files(spark, str(tmp_path / "in"), 2))).groupBy("path").agg(F.count("*").alias("n"))
    q = px.writeStream.format("memory").queryName("px").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("px").count() == want


def test_paths_stay_in_the_folder(spark, tmp_path):
    rows = spark.createDataFrame([("../out.tif", bytearray(b"x"))], "path string, content binary")
    try:
        sinks.save_files(rows, str(tmp_path / "in")).collect()
    except Exception as e:
        assert "lies outside" in str(e)
    else:
        raise AssertionError("written outside")
