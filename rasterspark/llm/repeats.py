"""Shared steps of the two substring operators: which anchors repeat, and text on its way.

An anchor is a place in a text that the content around it chooses; equal content
chooses equal places and gives them equal keys. Tasks send anchors in blocks, one row
per task slice and bucket of keys. A key that repeats within a slice is sent once, so
a very common key costs as many entries as there are slices, never as many as there
are rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_slices, fresh_path, let_go, mix64
from .media import _codec, wire_dictionary

#: Text bytes that a task handles at once, and text bytes for each bucket.
SLICE = 4 << 20
BUCKET_BYTES = 8 << 20
#: Rows whose text is unpacked at once.
ROWS = 2048
LEAST_BUCKETS = 64

_BLOCK = "bucket int, keys binary, ids binary, pos binary, kinds binary"


def buckets_for(docs: DataFrame) -> int:
    """Buckets grow with the text, so that one of them stays a bounded task."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-int(total) // BUCKET_BYTES))


def slices(batch: pa.RecordBatch, at: int = 1, limit: int = SLICE):
    """(ids, texts, rows) in order of id, of bounded size."""
    ids, texts = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), as_bytes(batch.column(at))
    order = np.argsort(ids, kind="stable")
    lengths = np.array([len(texts[i]) for i in order.tolist()])
    for a, b in bounded_slices(lengths, limit):
        rows = order[a:b]
        yield ids[rows], [texts[i] for i in rows.tolist()], rows


def parts(batches):
    """The batches, of bounded numbers of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x5BD1E995)) % np.uint64(n)).astype(np.int64)


def by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, parts of the columns), the order within a bucket kept."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))) if len(ordered) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(ordered[a]), [c[order[a:b]] for c in columns]


def _blocks(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (1, 2, 3, 4))], names=["bucket", "keys", "ids", "pos", "kinds"])


def _kinds(first: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For sorted places that begin a key where ``first`` is true: about how many different surroundings the key has, 0 elsewhere.

    Told from 64 bits a key (linear counting); where all are set, every place counts.
    """
    head = np.flatnonzero(first)
    sizes = np.diff(np.append(head, len(first)))
    bits = np.bitwise_count(np.bitwise_or.reduceat(np.uint64(1) << (around >> np.uint64(58)), head))
    table = np.append(np.round(-64 * np.log1p(-np.arange(64) / 64)), 1 << 16).astype(np.int64)
    kinds = np.zeros(len(first), np.uint16)
    kinds[head] = np.clip(np.minimum(table[bits], sizes), 1, 65535)
    return kinds


def key_names(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """A key as its bucket and the half of it that is sent."""
    return bucket_of(keys, n_buckets) << 32 | (keys >> np.uint64(32)).astype(np.int64)


def repeated_places(docs: DataFrame, anchors, n_buckets: int, limit: int = SLICE, common: int = 0) -> DataFrame:
    """(doc_id, pos): places of the anchors whose key another place has too.

    ``anchors(texts)`` -> (text number, position, key) arrays for a list of UTF-8 texts.
    Rows that share an id have one text and are one document; the same place twice is one place.
    With ``common``, ``anchors`` also gives a hash of what lies around each place, and a row
    (name of the key, minus a number) is added for each key whose numbers of different
    surroundings in a slice, as estimated, add up to at least ``common``.
    """

    def send(batches):
        let_go("words")
        for batch in batches:
            for ids, texts, _ in slices(batch, limit=limit):
                owner, pos, keys, *around = anchors(texts)
                if not len(keys):
                    continue
                order = np.argsort(keys, kind="stable")
                k, place_id, place = keys[order], ids[owner[order]], pos[order].astype(np.int64)
                first = np.concatenate(([True], k[1:] != k[:-1]))
                # one row of a key goes for all; the others are known to repeat, unless they are the same place
                lead = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
                other = (place_id != place_id[lead]) | (place != place[lead])
                known = np.zeros(len(k), bool)
                known[lead[other]] = True
                keep = first | other
                kinds = _kinds(first, around[0][order])[keep] if common else np.zeros(int(keep.sum()), "V0")  # without common: no bytes
                k = np.where(first, k, mix64(place_id.view(np.uint64) + mix64(place.astype(np.uint64))))
                mark = np.where(known | ~first, -1 - place, place).astype(np.int32)
                # half a key is enough within a bucket: buckets grow with the text, and a clash only adds a candidate
                half = (k[keep] >> np.uint64(32)).astype(np.uint32)
                out = [(b, *parts) for b, parts in by_bucket(bucket_of(k[keep], n_buckets), half, place_id[keep], mark[keep], kinds)]
                yield _blocks(out)

    def judge(block: pa.Table) -> pa.Table:
        let_go("words")
        keys, ids, pos = (np.frombuffer(b"".join(block.column(c).to_pylist()), t) for c, t in (("keys", np.uint32), ("ids", np.int64), ("pos", np.int32)))
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        known = pos[order] < 0
        place = np.where(known, -1 - pos[order], pos[order])
        repeats = known | np.concatenate(([False], same)) | np.concatenate((same, [False]))
        doc, place = ids[order][repeats], place[repeats].astype(np.int32)
        if common:
            edge = np.flatnonzero(np.concatenate(([True], ~same, [True]))) if len(k) else np.zeros(1, np.int64)
            kinds = np.frombuffer(b"".join(block.column("kinds").to_pylist()), np.uint16)[order]
            sent = np.add.reduceat(kinds, edge[:-1], dtype=np.int64) if len(k) else edge[:0]
            often = np.flatnonzero(sent >= common)
            names = block.column("bucket")[0].as_py() << 32 | k[edge[often]].astype(np.int64)
            doc, place = np.concatenate((doc, names)), np.concatenate((place, -np.minimum(sent[often], (1 << 31) - 1).astype(np.int32)))
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "pos": pa.array(place, pa.int32())})

    return docs.mapInArrow(send, _BLOCK).groupBy("bucket").applyInArrow(judge, "doc_id long, pos int")


def repeated_anchors(docs: DataFrame, anchors, n_buckets: int, limit: int = SLICE) -> DataFrame:
    """(doc_id, at array<int>): ``repeated_places`` of each document."""
    return _lists(repeated_places(docs, anchors, n_buckets, limit))


def _lists(places: DataFrame) -> DataFrame:
    return places.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))


def anchors_and_common(docs: DataFrame, anchors, n_buckets: int, limit: int, common: int, most: int) -> tuple[DataFrame, np.ndarray]:
    """(``repeated_anchors``, sorted names of the keys with ``common`` surroundings or more, added up over slices).

    The names go to every task, so the ``most`` most common are listed at most; a key beyond
    them is only not known as common.
    """
    path = fresh_path(docs.sparkSession, "anchors")
    repeated_places(docs, anchors, n_buckets, limit, common).write.parquet(path)
    places = docs.sparkSession.read.schema("doc_id long, pos int").parquet(path)
    names = places.filter("pos < 0").orderBy("pos", "doc_id").limit(most).select("doc_id").toArrow()
    return _lists(places.filter("pos >= 0")), np.sort(names.column(0).to_numpy())


class Wire:
    """Documents compressed for exchanges with a small dictionary; sizes depend on it, results don't."""

    def __init__(self, docs: DataFrame):
        self.dictionary = wire_dictionary(docs)

    def packed(self, docs: DataFrame) -> DataFrame:
        def run(batches):
            press = _codec(self.dictionary)[0]
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(b) for b in as_bytes(batch.column(1))], pa.binary())], names=["doc_id", "packed"])

        return docs.mapInArrow(run, "doc_id long, packed binary")

    def unpack(self, column: pa.Array) -> pa.Array:
        plain = _codec(self.dictionary)[1]
        return pa.array([plain.decompress(b) for b in column.to_pylist()], pa.binary())


def covered(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` places lie in a span of ``length`` from one of ``starts``."""
    change = np.zeros(size + 1, np.int64)
    if len(starts):
        starts = np.unique(starts)
        np.add.at(change, starts, 1)
        np.add.at(change, np.minimum(starts + length, size), -1)
    return np.cumsum(change[:size]) > 0


def lists_of(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x if x is not None else [], np.int64) for x in (v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in column)]
