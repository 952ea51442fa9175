"""Substring dedup on words by recompression.

Rounds name, everywhere alike because names are hashes of what they stand for: the
first round names runs of equal words, and each of ``ROUNDS`` rounds names pairs of a
left and a right symbol (a symbol's hash and the round decide its side; Jez, 2013).
So equal word sequences get equal symbols but near their ends, and for each symbol
the words that it depends on are known. A symbol whose words all lie in a window is
an interior symbol of it, in each copy of that window; of these the one with the
least name reveals the window. A window is a candidate if its revealing symbol
repeats somewhere, or if it has none (long runs). Candidates are verified by 128-bit
hashes of their words: all but the first of equal windows, by doc_id and start, are
removed. Nothing but candidates is exchanged for verification.

Cases: null text counts as empty and has no words; a text under 20 words keeps all;
a null doc_id sorts first, different texts of one doc_id (or of null) sort by their
digests; rows that share doc_id and text are the same document and give equal rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, held, let_go, mix64, own_ids, table, with_ids
from .repeats import Wire, bucket_of, buckets_for, by_bucket, covered, lists_of, parts, repeated_anchors, slices

WINDOW, ROUNDS = 20, 4
REMEMBERED = 1 << 18
#: Words of texts that are handled as one array; a longer text stands alone.
GROUP = 1 << 16
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_I1 = pow(_B1, -1, 1 << 64)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        out = np.multiply.accumulate(out)
    return out


class _Rows(dict):
    """The row of each word; a new word gets the next one and its digest is put aside."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.fresh.append(xxhash.xxh3_128_digest(word))
        return at


class Words:
    """Words of texts as two 64-bit hashes each; remembers words."""

    def __init__(self):
        self.row, self.hashes = _Rows(), np.zeros((0, 2), np.uint64)

    def __call__(self, texts: list[bytes]):
        """(first hash, second hash, words of each text)."""
        if len(self.row) > REMEMBERED:
            self.__init__()
        row = self.row.__getitem__
        at, sizes = [], []
        for t in texts:
            own = t.split()
            at.append(np.fromiter(map(row, own), np.int32, len(own)))
            sizes.append(len(own))
        if self.row.fresh:
            new = np.frombuffer(b"".join(self.row.fresh), ">u8").astype(np.uint64).reshape(-1, 2)
            self.hashes = np.concatenate((self.hashes, new))
            self.row.fresh = []
        rows = np.concatenate(at) if at else np.zeros(0, np.int32)
        return self.hashes[rows, 1], self.hashes[rows, 0], np.array(sizes, np.int64)


def symbols(words: np.ndarray, rounds: int = ROUNDS):
    """(names, own first word, first word, end) of the symbols after all rounds; the span from first word to end holds every word that a symbol depends on."""
    n = len(words)
    begin = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    end = np.append(begin[1:], n)
    length = end - begin
    name = np.where(length > 1, mix64(words[begin] * np.uint64(3) + length.astype(np.uint64)), words[begin])
    # what stands at a text's ends isn't known within a window: spans may reach one place beyond
    low, high = begin - 1, end + 1
    for t in range(rounds):
        m = len(name)
        left = (mix64(name + np.uint64(t + 1)) & np.uint64(1)).astype(bool)
        pair = np.zeros(m, bool)
        pair[:-1] = left[:-1] & ~left[1:]
        second = np.concatenate(([False], pair[:-1]))
        keep = np.flatnonzero(~second)
        after, before = np.minimum(keep + 1, m - 1), np.maximum(keep - 1, 0)
        paired, to_left = pair[keep], left[keep]
        merged = np.where(paired, mix64(name[keep] ^ mix64(name[after] + np.uint64(t + 1))), name[keep])
        # a lone left symbol depends on the next one, a lone right symbol on the one before
        right = paired | to_left
        low, high, name, begin = np.where(right, low[keep], low[before]), np.where(right, high[after], high[keep]), merged, begin[keep]
    return name, begin, low, high


def revealing(words: np.ndarray, starts: np.ndarray, window: int = WINDOW):
    """The revealing symbol of each window that starts at ``starts`` (-1: none), and the symbols' own first words, spans and keys.

    ``words`` may hold many texts one after another: a symbol that depends on words
    of two texts lies in no window of either.
    """
    name, begin, low, high = symbols(words)
    first, last = np.searchsorted(low, starts, "left"), np.searchsorted(high, starts + window, "right")
    weight = mix64(name ^ np.uint64(0xA5A5A5A5))
    # the least weight of 2^j symbols from each on; of equal weights the last counts
    m = len(name)
    least = [np.arange(m, dtype=np.int32)]
    while 2 << (len(least) - 1) <= (last - first).max(initial=0):
        a, step = least[-1], 1 << (len(least) - 1)
        b = a[np.minimum(np.arange(m) + step, m - 1)]
        least.append(np.where(weight[b] <= weight[a], b, a))
    choice = np.full(len(starts), -1)
    count = last - first
    for j, of in enumerate(least):
        which = np.flatnonzero((count >= 1 << j) & (count < 2 << j))
        if len(which):
            a, b = of[first[which]], of[last[which] - (1 << j)]
            choice[which] = np.where(weight[b] <= weight[a], b, a)
    # the key stands for all words that the symbol depends on
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(_B1, len(words)), dtype=np.uint64)))
    low_at, high_at = np.maximum(low, 0), np.minimum(high, len(words))
    key = mix64((total[high_at] - total[low_at]) * _powers(_I1, len(words) + 1)[low_at] + (high - low).astype(np.uint64))
    return choice, begin, low, high, key


def _groups(sizes: np.ndarray, limit: int):
    """(first text, end, first word, end word, first word of each text in the group, owner and start of each window) of groups of texts that have windows."""
    edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    for a, b in bounded_slices(sizes, limit):
        n, base = np.maximum(sizes[a:b] - WINDOW + 1, 0), edge[a:b] - edge[a]
        if n.any():
            owner = np.repeat(np.arange(b - a), n)
            yield a, b, int(edge[a]), int(edge[b]), base, owner, np.arange(len(owner)) + (base - (np.cumsum(n) - n))[owner]


def word_anchors(words_of: Words, group: int = GROUP):
    """For texts (text number, position, key) of the symbols that reveal a window; the position is the symbol's own first word."""

    def anchors(texts: list[bytes]):
        one, _, sizes = words_of(texts)
        owners, positions, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, _, at, end, base, owner, starts in _groups(sizes, group):
            choice, begin, _, _, key = revealing(one[at:end], starts)
            is_used = np.zeros(len(begin) + 1, bool)
            is_used[choice] = True
            used = np.flatnonzero(is_used[:-1])
            text = np.searchsorted(base, begin[used], "right") - 1
            owners.append(text + a)
            positions.append(begin[used] - base[text])
            keys.append(key[used])
        return np.concatenate(owners), np.concatenate(positions), np.concatenate(keys)

    return anchors


def _anchors(texts):
    return word_anchors(_words())(texts)


def _words() -> Words:
    return held("words", Words)


def candidate_windows(texts: list[bytes], repeated: list[np.ndarray], group: int = GROUP):
    """(text number, start, hash, hash) of the windows to verify."""
    one, two, sizes = _words()(texts)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for first, last, at, end, base, owner, starts in _groups(sizes, group):
        a, b = one[at:end], two[at:end]
        choice, begin, _, _, _ = revealing(a, starts)
        marked = np.zeros(len(a), bool)
        for i in range(first, last):
            marked[repeated[i] + base[i - first]] = True
        flag = np.append(marked[begin], True)  # the last: windows without a symbol
        some = np.flatnonzero(flag[choice])
        if len(some):
            owner, starts = owner[some], starts[some]
            h1, h2 = (np.zeros(len(starts), np.uint64) for _ in range(2))
            for k in range(WINDOW):
                h1 = (h1 + a[starts + k]) * np.uint64(_B1)
                h2 = (h2 ^ b[starts + k]) * np.uint64(_B2)
                h2 ^= h2 >> np.uint64(29)
            out.append((owner + first, starts - base[owner], h1, h2))
    return tuple(np.concatenate(x) for x in zip(*out))


_BLOCK = "bucket int, h1 binary, h2 binary, ids binary, pos binary"


def later_windows(docs: DataFrame, wire: Wire, n_buckets: int) -> DataFrame:
    """(doc_id, at array<int>): starts of the windows whose words start earlier too. ``docs(doc_id, packed, at)``."""

    def send(batches):
        let_go("words")
        for batch in batches:
            ready = pa.RecordBatch.from_arrays([batch.column(0), wire.unpack(batch.column(1))], names=["doc_id", "text"])
            marks = lists_of(batch.column(2))
            for ids, texts, rows in slices(ready):
                owner, start, h1, h2 = candidate_windows(texts, [marks[r] for r in rows.tolist()])
                if not len(h1):
                    continue
                # the slice is in order of id: the first of equal windows goes, the others are known to be later
                order = np.argsort(h1, kind="stable")
                h1, h2, doc, pos = h1[order], h2[order], ids[owner[order]], start[order].astype(np.int32)
                first = np.concatenate(([True], h1[1:] != h1[:-1]))
                lead = np.maximum.accumulate(np.where(first, np.arange(len(h1)), 0))
                first |= h2 != h2[lead]
                later = ~first & ((doc != doc[lead]) | (pos != pos[lead]))
                keep = first | later
                h1 = np.where(first, h1, mix64(doc.view(np.uint64) + mix64(pos.astype(np.uint64))))[keep]
                mark = np.where(first, pos, -1 - pos)[keep].astype(np.int32)
                out = [(b, *parts) for b, parts in by_bucket(bucket_of(h1, n_buckets), h1, h2[keep], doc[keep], mark)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k].tobytes() for r in out], pa.binary()) for k in (1, 2, 3, 4))], names=["bucket", "h1", "h2", "ids", "pos"])

    def judge(block: pa.Table) -> pa.Table:
        let_go("words")
        h1, h2, ids, pos = (np.frombuffer(b"".join(block.column(c).to_pylist()), t) for c, t in (("h1", np.uint64), ("h2", np.uint64), ("ids", np.int64), ("pos", np.int32)))
        known = pos < 0
        open_ = np.flatnonzero(~known)
        open_ = open_[np.lexsort((pos[open_], ids[open_], h2[open_], h1[open_]))]
        a, b, doc, at = h1[open_], h2[open_], ids[open_], pos[open_]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else np.zeros(0, np.int64)
        later = (doc != doc[lead]) | (at != at[lead])
        doc, at = np.concatenate((ids[known], doc[later])), np.concatenate((-1 - pos[known], at[later])).astype(np.int32)
        # one row for each document of the bucket
        by = np.argsort(doc, kind="stable")
        doc, at = doc[by], at[by]
        edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        ends = pa.array(np.append(edge, len(doc)).astype(np.int32), pa.int32())
        return pa.table({"doc_id": pa.array(doc[edge], pa.int64()), "at": pa.ListArray.from_arrays(ends, pa.array(at, pa.int32()))})

    judged = docs.mapInArrow(send, _BLOCK).groupBy("bucket").applyInArrow(judge, "doc_id long, at array<int>")
    return judged.groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("at"))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Wire, DataFrame | None]:
    """((doc_id, packed, at), wire, back): each document, by the ids of ``with_ids``, with the starts of its later windows."""
    rows, back = with_ids(docs, id_col, text_col)
    wire, n = Wire(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), buckets_for(rows)
    packed = wire.packed(rows)
    marked = packed.join(repeated_anchors(rows, _anchors, n), "doc_id", "left")
    return packed.join(later_windows(marked, wire, n), "doc_id", "left"), wire, back


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, wire, back = repeated_words(table(spark, sf_dir, "documents"))

    def run(batches):
        let_go()
        for batch in parts(batches):
            n, gone, digests = [], [], []
            for text, at in zip(wire.unpack(batch.column(1)).to_pylist(), lists_of(batch.column(2))):
                words = text.split()
                away = covered(len(words), at, WINDOW)
                n.append(len(words))
                gone.append(int(away.sum()))
                kept = words if not gone[-1] else [words[i] for i in np.flatnonzero(~away).tolist()]
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return own_ids(out, back)
