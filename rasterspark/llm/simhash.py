"""SimHash near-duplicate groups with pivot distance tables.

1. Fingerprint: 64 majority bits of the XXH64 values of all 3-word shingles.
2. Equal fingerprints become one row (partial aggregation), so a group of copies
   of any size costs one row from here on.
3. Candidates: the 64 bits fall into 6 blocks. Fingerprints that differ in at most
   3 bits agree on 3 whole blocks, so they share one of 20 keys of 31 to 33 bits.
   Pivot coordinates alone cannot spread a table over machines (all distances to
   a random pivot lie near 32), which is why the keys deal out the work.
4. Pivot distance table: within a key each fingerprint gets its Hamming distances
   to ``PIVOTS`` reference fingerprints. By the triangle inequality a pair whose
   coordinates differ by more than 3 anywhere is discarded; survivors are verified
   bit by bit.
5. A key with over ``BUCKET`` fingerprints is cut into chunks and each pair of
   chunks becomes a task of its own: bounded memory, no link lost. A group gives a
   spanning forest of its links, never all pairs.
6. Components by star contraction (``components``).

Cases: null text counts as empty; a text without words has fingerprint zero and
links like any other; texts of any length are read whole; a null doc_id links, but names
a component only if it has no other (null then); rows that share an id are rows of their
own; equal rows give equal results, one each; an empty table gives an empty result;
further columns are ignored. ``near_dedup`` keeps one row of each component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_batches, table
from .components import components

SEED = 42
DISTANCE = 3
PIVOTS = 24
BUCKET = 2048
SMALL = 12
_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
MASKS = [sum(((1 << n) - 1) << at for at, n in chosen) for chosen in combinations(_BLOCKS, 3)]


def pivot_table(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: pseudo-random 64-bit words, the same everywhere."""
    return np.array([xxhash.xxh64_intdigest(b"pivot%d" % i, SEED) for i in range(count)], dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-3])).tolist()
        h = xxhash.xxh64_digest
        digests = b"".join([h(joined[a:b], SEED) for a, b in zip(starts, (ends[2:] - 1).tolist())])
    return _majority(np.frombuffer(digests, np.uint8).reshape(-1, 8))


def _majority(digests: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 15):
        ones += np.unpackbits(digests[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, digest): the fingerprint as a signed long, and the text's digest (empty for null)."""

    def run(batch):
        fps = np.array([fingerprint(b) for b in as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["doc_id", "fp", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _digest(F.col(text_col)).alias("digest"))
    return map_batches(rows, ["doc_id", "text", "digest"], run, "doc_id long, fp long, digest string")


def _digest(text):
    return F.coalesce(F.md5(text), F.lit(""))


def _forest(fps: np.ndarray, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links of one group; row numbers."""
    coordinates = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    todo, found = np.arange(len(fps)), []
    while len(todo):
        frontier, todo = [int(todo[0])], todo[1:]
        while frontier and len(todo):
            at = frontier.pop()
            near = np.abs(coordinates[todo] - coordinates[at]).max(axis=1) <= DISTANCE
            near[near] = np.bitwise_count(fps[todo[near]] ^ fps[at]) <= DISTANCE
            if near.any():
                hits = todo[near].tolist()
                found += [(at, x) for x in hits]
                frontier += hits
                todo = todo[~near]
    return found


def link_groups(groups: np.ndarray, fps: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal group numbers; a spanning forest in runs over ``SMALL`` rows."""
    edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    sizes = np.diff(edge)
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    small = np.flatnonzero(size_of <= SMALL)
    if len(small):
        g, f = groups[small], fps[small]
        coordinates = np.bitwise_count(f[:, None] ^ pivots[None, :]).astype(np.int8)
        for k in range(1, min(SMALL, len(g))):
            at = np.flatnonzero(g[k:] == g[:-k])
            if not len(at):
                break
            at = at[np.abs(coordinates[at] - coordinates[at + k]).max(axis=1) <= DISTANCE]
            at = at[np.bitwise_count(f[at] ^ f[at + k]) <= DISTANCE]
            left.append(f[at])
            right.append(f[at + k])
    for i in np.flatnonzero(sizes > SMALL):
        f = fps[edge[i] : edge[i + 1]]
        found = np.array(_forest(f, pivots), dtype=np.int64).reshape(-1, 2)
        left.append(f[found[:, 0]])
        right.append(f[found[:, 1]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(left), join(right)


def _link_partition(batches):
    """Rows come sorted by (key, part); a group that a batch cuts is carried over. Groups are bounded by BUCKET."""
    pivots, kept = pivot_table(), None
    for batch in batches:
        rows = np.rec.fromarrays([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], names="key,part,fp")
        kept = rows if kept is None else np.concatenate([kept, rows])
        if len(kept) > 2 * BUCKET:
            same = (kept["key"] == kept["key"][-1]) & (kept["part"] == kept["part"][-1])
            last = len(kept) - int(same.sum())
            done, kept = kept[:last], kept[last:]
            yield from _links_of(done, pivots)
    if kept is not None:
        yield from _links_of(kept, pivots)


def _links_of(rows, pivots):
    if len(rows):
        new = np.concatenate(([False], (rows["key"][1:] != rows["key"][:-1]) | (rows["part"][1:] != rows["part"][:-1])))
        a, b = link_groups(np.cumsum(new), np.ascontiguousarray(rows["fp"]).view(np.uint64), pivots)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``distinct(fp)`` -> verified links (u, v) that connect all pairs within DISTANCE."""
    # the key keeps the masked bits and the number of the mask, hashed; a clash only adds candidates
    keyed = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(MASKS)])).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / bucket).cast("int")
    rows = keyed.join(shared, "key").select("key", "fp", chunks.alias("m")).withColumn("i", F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("m")).cast("int"))
    # each pair of chunks is a group: chunk i goes to (min(i, j), max(i, j)) for every j
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("key", (F.least("i", "j").cast("long") * F.col("m") + F.greatest("i", "j")).alias("part"), "fp")
    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_link_partition, "u long, v long").distinct()


def _classes(own: DataFrame) -> DataFrame:
    """(fp, root): the component of each fingerprint of ``own(fp, ...)``."""
    distinct = own.select("fp").distinct()
    found = components(links(distinct))
    return distinct.join(found.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; component_id is the smallest doc_id reachable by links."""
    own = cut(fingerprints(docs, id_col, text_col))
    rooted = own.groupBy("fp").agg(F.min("doc_id").alias("least")).join(_classes(own), "fp")
    of = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(of, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: the least doc_id, null last, of one id the least text digest; columns as they were."""
    own = cut(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    # copies within a fingerprint become one row before components meet
    best = own.groupBy("fp").agg(F.min(order).alias("best")).join(_classes(own), "fp").groupBy("root").agg(F.min("best").alias("best"))
    stay = cut(best.select(F.col("best.doc_id").alias("_id"), F.col("best.digest").alias("_digest")))
    kept = docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["_id"]) & (_digest(docs["text"]) == stay["_digest"]), "left_semi")
    # rows that repeat a kept one: rare, and looked for among ids and digests only
    same = own["doc_id"].eqNullSafe(stay["_id"]) & (own["digest"] == stay["_digest"])
    if own.join(stay, same, "left_semi").groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        return kept
    return kept.withColumn("_digest", _digest(F.col("text"))).dropDuplicates(["doc_id", "_digest"]).drop("_digest")
