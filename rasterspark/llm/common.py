"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the input folder; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``; only where that
    is unset and all runs in one process (tests) a temporary one is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not at:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Stands for a null id while ids are sorted and joined.
NULL_ID = -(1 << 63)


def with_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """((doc_id, text), back): rows with an id that is never null and has one text only.

    Mostly these are the ids that the rows have, with a stand-in for null, and ``back`` is
    None. If an id (null too) has several texts, the distinct pairs of id and text digest
    are numbered in their order, null first, and ``back(doc_id, own)`` leads to the ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    stand_in = F.col("doc_id").eqNullSafe(NULL_ID)
    # the ids alone first: texts are read only if an id repeats
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | stand_in).isEmpty():
        return plain, None
    digested = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    ends = digested.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    if ends.filter((F.col("a") != F.col("b")) | stand_in).isEmpty():
        return plain, None

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64())], names=["own", "digest", "part", "at"])
            at += n

    order = (F.col("doc_id").asc_nulls_first(), F.col("digest").asc())
    pairs = digested.select("doc_id", "digest").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut(pairs.mapInArrow(number, "own long, digest string, part int, at long"))
    offsets, total = [], 0
    for r in numbered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], total))
        total += r["n"]
    offsets = docs.sparkSession.createDataFrame(offsets, "part int, before long")
    numbered = numbered.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("at")).alias("number"), "own", "digest")
    same = (digested["digest"] == numbered["digest"]) & digested["doc_id"].eqNullSafe(numbered["own"])
    return cut(digested.join(numbered, same).select(F.col("number").alias("doc_id"), "text")), numbered.select(F.col("number").alias("doc_id"), "own")


def own_ids(rows: DataFrame, back: DataFrame | None) -> DataFrame:
    """``rows`` with the ids that ``with_ids`` replaced."""
    if back is None:
        return rows.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
    return rows.join(back, "doc_id").withColumn("doc_id", F.col("own")).drop("own")


def hex_sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [s or "" for s in column.to_pylist()]


_held: dict = {}
#: glibc keeps freed memory unless told; elsewhere there is no such call.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def held(key, make):
    """What a Python worker keeps between tasks: one thing at most, so that operators in one session don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go(keep=None) -> None:
    """Drops what earlier tasks of this worker kept, and hands free memory back to the machine."""
    for key in [k for k in _held if k != keep]:
        del _held[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def map_batches(df: DataFrame, columns: list[str], function, schema: str, keep=None) -> DataFrame:
    """``function(batch)`` gives a dict of columns (or None) for every Arrow batch of the named columns.

    Columns beside those named are never read, so clashing names do no harm.
    """

    def run(batches):
        let_go(keep)
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None:
                    yield out

    return df.select(*columns).mapInArrow(run, schema)


def filter_rows(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text ``keep(texts)`` marks true; columns as they are, no exchange."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        let_go()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(as_text(batch.column(at))), pa.bool_()))

    return docs.mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def bounded_slices(lengths: np.ndarray, limit: int):
    """Consecutive row ranges whose lengths sum to about ``limit``; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))
