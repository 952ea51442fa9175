"""Media columns: content-defined chunks, stored once, and verified reads.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, are the 8-bit
samples of a grey image 576 wide in the portable graymap format (P5). The image
file's bytes are cut where a rolling gear hash says so. A digest table tells which
document owns each chunk (the least (doc, position) with its digest); the chunk
store keeps owned chunks only, in the owner's row, and a document is an ordered list
of digests and lengths. Reading back takes a document's own row and fetches, by a
join on digests, only the chunks that others own; every chunk and every file is
verified by its digest. Copies share one file, found by the text's digest.

Cases: null text counts as empty and is one row of 576 samples; equal texts give
equal values; a null doc_id, and one with several texts, gives each row its own text's
values; repeated rows give repeated results; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut, fresh_path, mix64, table, with_ids

ROW = 576
LEAST, MOST = 512, 16384
#: The gear value's top bits that are all zero at a cut: one in 2048 positions.
_MASK = np.uint32(0xFFE00000)
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def padded(text: bytes) -> bytes:
    size = max(ROW, -(-len(text) // ROW) * ROW)
    return text + b"\xff" * (size - len(text))


def to_media(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_media(media: bytes) -> bytes:
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image of the size it names")
    return samples


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The gear value of a position covers the 32 bytes up to it, so equal passages are cut alike."""
    rolled = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if len(rolled) > step:
            before = rolled[:-step] << np.uint32(step)
            rolled = rolled.copy()
            rolled[step:] += before
    ends, last = [], 0
    for at in (np.flatnonzero(rolled & _MASK == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [len(data)] * (last < len(data))


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(samples: bytes) -> str:
    """Rows, mean, standard deviation and a 4-bin histogram of the samples."""
    values = np.frombuffer(samples, np.uint8)
    bins = np.bincount(values >> 6, minlength=4).tolist()
    n, total, squares = len(values), int(values.sum(dtype=np.uint64)), int((values.astype(np.uint32) ** 2).sum(dtype=np.uint64))
    mean = total / n
    return f"rows={n // ROW};mean={mean:.4f};std={max(0.0, squares / n - mean * mean) ** 0.5:.4f};hist={','.join(map(str, bins))}"


def distinct_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(text_id, least doc_id) of each distinct text, and (doc_id, text_id) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = cut(rows.select("doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("text_id")))
    return keyed.groupBy("text_id").agg(F.min("doc_id").alias("doc_id")), keyed


_PARTS = pa.list_(pa.struct([("seq", pa.int32()), ("bytes", pa.binary()), ("lent", pa.binary())]))
_PARTS_SQL = "array<struct<seq:int,bytes:binary,lent:binary>>"
#: Text sampled to train the dictionary that shortens documents on their way to the store.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY = 2000, 2048, 1 << 16
#: The store is read more often than it is written: a higher level than that of other exchanges.
STORE_LEVEL = 6


def wire_dictionary(docs: DataFrame) -> bytes:
    """A zstandard dictionary from at most SAMPLE_ROWS snippets of SAMPLE_BYTES; only sizes depend on it, never results."""
    import zstandard

    rows = docs.select("doc_id", F.substring("text", 1, SAMPLE_BYTES).alias("s")).filter("s != ''").limit(SAMPLE_ROWS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [r["s"].encode() for r in rows], level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(dictionary: bytes, level: int = 3):
    import zstandard

    own = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=level, **own), zstandard.ZstdDecompressor(**own)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, digest, length) of every chunk of every row of ``docs(doc_id, text)``."""

    def run(batches):
        for batch in batches:
            ids, seqs, digests, lengths = [], [], [], []
            for i, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                parts = chunks(to_media(padded(data)))
                ids += [i] * len(parts)
                seqs += range(len(parts))
                digests += map(digest, parts)
                lengths += map(len, parts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.int32()), pa.array(digests, pa.binary()), pa.array(lengths, pa.int32())], names=["doc_id", "seq", "digest", "length"])

    return docs.mapInArrow(run, "doc_id long, seq int, digest binary, length int")


def store_media(docs: DataFrame, firsts: DataFrame) -> str:
    """Writes the chunk store for the ids in ``firsts(doc_id)`` to the shared folder; returns its path.

    A row of the store: (doc_id, listed array<struct<seq, digest, length, own, shared>>, chunks
    array<struct<seq, bytes, lent>>): the whole ordered list of a document and the bytes of
    the chunks that it owns, with the digest of those that others need too.
    """
    spark = docs.sparkSession
    lists = cut(chunk_lists(docs).join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id", "seq"]))
    owners = lists.groupBy("digest").agg(F.min(F.struct("doc_id", "seq")).alias("owner"), (F.count("*") > 1).alias("shared"))
    owned = lists.join(owners, "digest").select("doc_id", F.struct("seq", "digest", "length", (F.struct("doc_id", "seq") == F.col("owner")).alias("own"), "shared").alias("c"))
    manifest = owned.groupBy("doc_id").agg(F.collect_list("c").alias("listed"))
    dictionary = wire_dictionary(docs)

    def shortened(batches):
        press = _codec(dictionary, STORE_LEVEL)[0]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(b) for b in as_bytes(batch.column(1))], pa.binary())], names=["doc_id", "packed"])

    def stored(batches):
        unpack = _codec(dictionary)[1]
        for batch in batches:
            own = []
            for packed, listed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = chunks(to_media(padded(unpack.decompress(packed))))
                own.append([{"seq": c["seq"], "bytes": parts[c["seq"]], "lent": c["digest"] if c["shared"] else None} for c in listed if c["own"]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, _PARTS)], names=["doc_id", "listed", "chunks"])

    path = fresh_path(spark, "chunks")
    rows = docs.mapInArrow(shortened, "doc_id long, packed binary").join(manifest, "doc_id").dropDuplicates(["doc_id"])
    listed_sql = "array<struct<seq:int,digest:binary,length:int,own:boolean,shared:boolean>>"
    rows.mapInArrow(stored, f"doc_id long, listed {listed_sql}, chunks {_PARTS_SQL}").write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", STORE_LEVEL).parquet(path)
    return path


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, media): every stored file, rebuilt from its ordered chunk list and verified.

    A document that owns all its chunks is read where it lies. For the others the
    chunks they lack come by a join on digests.
    """
    store = spark.read.parquet(path)
    whole = F.forall("listed", lambda c: c["own"])
    lacking = store.filter(~whole)
    wanted = lacking.select("doc_id", F.explode(F.filter("listed", lambda c: ~c["own"])).alias("c")).select("doc_id", "c.seq", "c.digest")
    # only chunks that others need too are sent
    owned = store.select(F.explode(F.filter("chunks", lambda c: c["lent"].isNotNull())).alias("c")).select(F.col("c.lent").alias("digest"), "c.bytes")
    lent = owned.join(wanted.select("digest").distinct(), "digest", "left_semi")
    fetched = wanted.join(lent, "digest").groupBy("doc_id").agg(F.collect_list(F.struct("seq", "bytes", F.lit(None).cast("binary").alias("lent"))).alias("fetched"))
    none = F.array().cast(_PARTS_SQL)
    joined = lacking.join(fetched, "doc_id", "left").select("doc_id", "listed", "chunks", F.coalesce("fetched", none).alias("fetched"))
    rows = store.filter(whole).select("doc_id", "listed", "chunks", none.alias("fetched")).union(joined)

    def rebuilt(batches):
        for batch in batches:
            media = []
            for at, i in enumerate(batch.column(0).to_pylist()):
                listed, own, more = (batch.column(k)[at].as_py() or [] for k in (1, 2, 3))
                have, parts = {c["seq"]: c["bytes"] for c in (*own, *more)}, []
                for entry in sorted(listed, key=lambda e: e["seq"]):
                    part = have.get(entry["seq"])
                    if part is None or len(part) != entry["length"] or digest(part) != entry["digest"]:
                        raise ValueError(f"document {i}: chunk {entry['seq']} is not what its list names")
                    parts.append(part)
                media.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return rows.mapInArrow(rebuilt, "doc_id long, media binary")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain, _ = with_ids(docs)
    texts, _ = distinct_texts(plain)
    media = read_media(spark, store_media(plain, texts.select("doc_id")))

    def measured(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for data in batch.column(1).to_pylist():
                samples = from_media(data)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(samples)))
            n, sha, crc, size, stored, feature = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(stored), pa.array(feature)], names=["first_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = media.mapInArrow(measured, "first_id long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    by_text = texts.withColumnRenamed("doc_id", "first_id").join(found, "first_id").drop("first_id")
    sizes = docs.select(F.col("doc_id").cast("long"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32).alias("text_id"))
    return sizes.join(by_text, "text_id").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
