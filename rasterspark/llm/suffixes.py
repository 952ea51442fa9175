"""Substring dedup on bytes by suffix arrays.

Anchors: of the 16-byte strings in each 50-byte window the one with the least hash
(winnowing); equal windows choose equal anchors. Windows whose anchor repeats are
sent, as the bytes around the anchor, to the bucket of the anchor's key, so all equal
windows meet there. A bucket's bytes are cut into shards. Each shard gets a suffix
array by Larsson-Sadakane refinement (ranks of prefixes of doubling length, only
groups that still tie are sorted again), and common prefixes of neighbours by Kasai's
rule on permuted order. Runs with 50 bytes in common are equal windows. A key that
fills more than one shard has its shards' sorted strings merged by binary search. An
anchor with ``COMMON`` different surroundings would gather contexts without bound, so its
windows are sent one by one to the bucket of their own hash: no key gathers them, and
equal windows still meet. A window is removed if one of its equals starts in a document with a smaller doc_id
(of one doc_id: a smaller text digest).

Cases: null text counts as empty; a text under 50 bytes keeps all; a null doc_id sorts
first, different texts of one doc_id (or of null) sort by their digests; rows that share doc_id and text are the same document and give equal rows; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, mix64, own_ids, table, with_ids
from .media import _codec
from .repeats import Wire, anchors_and_common, bucket_of, buckets_for, by_bucket, covered, key_names, lists_of, parts, slices

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1  # grams in a window
SHARD = 1 << 16
#: Text bytes that a task handles at once.
SLICE = 2 << 20
#: Surroundings of a key, added up over slices, from which its windows are dealt out one by one, and how many such keys all tasks know (8 bytes each).
COMMON, COMMON_KEYS = 1 << 16, 1 << 20
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _eights(data: np.ndarray) -> np.ndarray:
    """The big-endian number of the 8 bytes from each place; zeros beyond the end."""
    return _eights_at(data)[:-1].astype(np.uint64)


def _eights_at(data: np.ndarray) -> np.ndarray:
    """``_eights`` as a view of the bytes, for those who read few places; one place more, at the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each ``width`` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def choose(text: np.ndarray):
    """(hash of each gram, least hash of each window) of one text of LENGTH bytes at least."""
    eight = _eights(text)
    n = len(text) - GRAM + 1
    grams = mix64(eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(eight[8 : n + 8]))
    return grams, _sliding(grams, SPAN, np.minimum)


def chosen(grams: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Grams that some window chooses."""
    edge = np.zeros(SPAN - 1, np.uint64)
    return np.flatnonzero(grams == _sliding(np.concatenate((edge, least, edge)), SPAN, np.maximum))


def _anchors(texts: list[bytes]):
    """(text number, position, key, hash of the surroundings) of the grams that windows choose."""
    owners, positions, keys, around = [], [], [], []
    for i, t in enumerate(texts):
        if len(t) >= LENGTH:
            grams, least = choose(np.frombuffer(t, np.uint8))
            at = chosen(grams, least)
            owners.append(np.full(len(at), i))
            positions.append(at)
            keys.append(grams[at])
            # grams beside the anchor reach as far as its windows; they are hashes already
            around.append(sum(grams[np.clip(at + by, 0, len(grams) - 1)] * np.uint64(odd) for by, odd in ((1 - SPAN, 3), (-GRAM, 5), (GRAM, 7), (SPAN - 1, 9))))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in (owners, positions, keys, around))


def contexts(text: np.ndarray, repeated: np.ndarray):
    """(start, windows, key) of the runs of windows whose anchor repeats; a run has one key and at most SPAN windows."""
    grams, least = choose(text)
    flagged = np.sort(grams[repeated])
    head = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    at = np.minimum(np.searchsorted(flagged, least[head]), len(flagged) - 1)
    windows = np.flatnonzero(np.repeat(flagged[at] == least[head], np.diff(np.append(head, len(least)))))
    if not len(windows):
        return windows, windows, np.zeros(0, np.uint64)
    key = least[windows]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (windows[1:] != windows[:-1] + 1)))
    head = np.flatnonzero(new)
    # periodic text can keep one key longer: such runs are cut
    run = np.maximum.accumulate(np.where(new, np.arange(len(windows)), 0))
    head = np.flatnonzero((np.arange(len(windows)) - run) % SPAN == 0)
    return windows[head], np.diff(np.append(head, len(windows))), key[head]


def among(names: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which names are in ``common``, which is sorted."""
    if not len(common):
        return np.zeros(len(names), bool)
    return common[np.minimum(np.searchsorted(common, names), len(common) - 1)] == names


def dealt_out(text: np.ndarray, start: np.ndarray, windows: np.ndarray, key: np.ndarray, common: np.ndarray):
    """``contexts`` with each window of the marked ones as a context of its own, known by the hash of its bytes."""
    each = np.repeat(start[common] - (np.cumsum(windows[common]) - windows[common]), windows[common]) + np.arange(int(windows[common].sum()))
    own = _content(text, each, np.full(len(each), LENGTH))
    start, windows, key = (np.concatenate((x[~common], y)) for x, y in ((start, each), (windows, np.ones(len(each), windows.dtype)), (key, own)))
    return start, windows, key


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    ends = np.cumsum(lengths)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def suffix_array(data: np.ndarray, room: np.ndarray | None = None, depth: int = LENGTH) -> np.ndarray:
    """Places of ``data`` in the order of their first ``depth`` bytes at least (Larsson-Sadakane refinement).

    Zero bytes at the very end may tie with the end itself.

    With ``room``, the bytes from each place to the end of its context, only places
    with ``depth`` bytes of room end in order: a place without room for a step isn't
    sorted again, and none with room looks at it.
    """
    n = len(data)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    number = np.arange(n, dtype=np.uint64)
    have = 5 if 40 + int(bits) <= 64 else 4
    head = _eights(data) >> np.uint64(64 - 8 * have)
    packed = np.sort(head << bits | number)
    order, key = (packed & low).astype(np.int64), packed >> bits
    new = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group is known by its first place in order
    rank = np.zeros(n + depth + 1, np.int64)  # beyond the end: least
    rank[order] = group + 1
    tied = np.arange(n)
    while have < depth:
        step = min(have, depth - have)
        tied = tied[~(new[tied] & np.concatenate((new[1:], [True]))[tied])]
        if room is not None:
            tied = tied[room[order[tied]] >= have + step]
        if not len(tied):
            break
        # tied places are sorted by (group, rank of what follows); the rest stay
        places, own = order[tied], group[tied]
        follow = rank[places + step].astype(np.uint64)
        if 3 * int(bits) + 1 <= 64:
            packed = np.sort((own.astype(np.uint64) << bits + np.uint64(1) | follow) << bits | number[: len(tied)])
            places = places[(packed & low).astype(np.int64)]
            follow = packed >> bits
            head = np.concatenate(([True], follow[1:] != follow[:-1]))
        else:
            by = np.lexsort((follow, own))
            places, follow = places[by], follow[by]
            head = np.concatenate(([True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])))
        order[tied], new[tied] = places, head
        group[tied] = own = np.maximum.accumulate(np.where(head, tied, 0))
        rank[places] = own + 1
        have += step
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes in common, up to ``most`` at least, of each place in ``order`` and the one before it.

    Kasai's rule: a place whose predecessor moved on with it has one byte less in
    common than the place before, as long as that had any. Only the others are compared.
    """
    n = len(data)
    before = np.full(n + 1, -2)  # -2: not in order
    if len(order):
        before[order[0]] = -1
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(before[:n] > -2)
    moved = (before[places] == before[places - 1] + 1) & (before[places] > 0) & (before[places - 1] >= 0)
    moved[:1] = False
    eight = np.concatenate((_eights(data), np.zeros(8, np.uint64)))
    count = np.arange(len(places))
    first, fresh = np.zeros(len(places), np.int64), np.flatnonzero(~moved)
    while len(fresh):
        # compared to most bytes beyond what a run of moves takes away
        lead = np.flatnonzero(~moved)
        run = np.diff(np.append(lead, len(places)))[np.searchsorted(lead, fresh)]
        first[fresh] = _compare(eight, n, places[fresh], before[places[fresh]], most + run)
        at = np.maximum.accumulate(np.where(~moved, count, 0))
        left = first[at] - (count - at)
        # behind the first byte that differs nothing is known: compare anew
        fresh = np.flatnonzero(left == -1)
        moved[fresh] = False
    value = np.zeros(n, np.int64)
    if len(places):
        value[places] = left
    return value[order]


def _compare(eight: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Bytes in common from places a and b (none if b is negative), exact below ``want``."""
    common, live = np.zeros(len(a), np.int64), np.flatnonzero(b >= 0)
    while len(live):
        x, y = a[live] + common[live], b[live] + common[live]
        inside = (x < n) & (y < n)
        differ = eight[np.minimum(x, n)] ^ eight[np.minimum(y, n)]
        same = np.where(differ == 0, 8, (64 - _bit_length(differ)) // 8)
        common[live] += np.where(inside, same, 0)
        live = live[inside & (same == 8) & (common[live] < want[live])]
    return np.minimum(common, n - np.maximum(a, b))


def _bit_length(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for s in (32, 16, 8):
        high = x >> np.uint64(s)
        more = high > 0
        out += np.where(more, s, 0)
        x = np.where(more, high, x)
    return out + 8 * (x > 0)  # to whole bytes


def shard_verdict(data: np.ndarray, lengths: np.ndarray, starts: np.ndarray, doc_of: np.ndarray):
    """Least document of each start's string within the shard, and the starts in order with their groups."""
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    order = suffix_array(data, room)
    place = order[room[order] >= LENGTH]  # the starts, in order
    group = np.cumsum(common_prefixes(data, place, LENGTH) < LENGTH)
    number = np.zeros(len(data), np.int64)
    number[starts] = np.arange(len(starts))
    at = number[place]
    docs = doc_of[at]
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(docs, head) if len(head) else docs
    sizes = np.diff(np.append(head, len(group)))
    out = np.zeros(len(starts), np.int64)
    out[at] = np.repeat(least, sizes)
    return out, at, head


def strings_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each start as fixed-width strings that keep zero bytes."""
    wide = np.ones((len(starts), LENGTH + 1), np.uint8)
    wide[:, :LENGTH] = data[starts[:, None] + np.arange(LENGTH)]
    return wide.view(f"S{LENGTH + 1}").ravel()


def merge_sorted(a: np.ndarray, a_least: np.ndarray, b: np.ndarray, b_least: np.ndarray):
    """Merges sorted distinct strings by binary search, with the lesser of the values of equal ones."""
    at = np.searchsorted(a, b)
    hit = (at < len(a)) & (a[np.minimum(at, max(len(a) - 1, 0))] == b) if len(a) else np.zeros(len(b), bool)
    a_least = a_least.copy()
    a_least[at[hit]] = np.minimum(a_least[at[hit]], b_least[hit])
    return np.insert(a, at[~hit], b[~hit]), np.insert(a_least, at[~hit], b_least[~hit])


def judge_contexts(data: np.ndarray, lengths: np.ndarray, keys: np.ndarray, docs: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """For each context the bits of its windows that a smaller document has too."""
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum(lengths)
    begins = ends - lengths
    bits = np.zeros(len(keys), np.uint64)
    sizes, cut = lengths[order], [0]
    total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > shard:
            cut.append(i)
            total = 0
        total += size
    cut.append(len(order))
    # keys that lie in more than one shard; only their windows wait for the other shards
    broken = np.array(sorted({int(keys[order[c]]) for c in cut[1:-1] if keys[order[c]] == keys[order[c - 1]]}), keys.dtype)
    merged, value = np.zeros(0, f"S{LENGTH + 1}"), np.zeros(0, np.int64)
    waiting = []

    def settle(rows, first, starts, owner, least):
        gone = least < docs[rows][owner]
        np.bitwise_or.at(bits, rows[owner[gone]], np.uint64(1) << (starts[gone] - first[owner[gone]]).astype(np.uint64))

    for a, b in zip(cut, cut[1:]):
        rows = order[a:b]
        own = gather(data, begins[rows], lengths[rows])
        first = np.cumsum(lengths[rows]) - lengths[rows]
        windows = lengths[rows] - LENGTH + 1
        starts = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        owner = np.repeat(np.arange(len(rows)), windows)
        least, at, head = shard_verdict(own, lengths[rows], starts, docs[rows][owner])
        of_key = np.isin(keys[rows], broken)
        if not of_key.any():
            settle(rows, first, starts, owner, least)
            continue
        tops = at[head][of_key[owner[at[head]]]]
        strings = strings_of(own, starts[tops])
        by = np.argsort(strings)
        distinct, index = np.unique(strings[by], return_index=True)
        merged, value = merge_sorted(merged, value, distinct, least[tops][by][index])
        ask = of_key[owner]
        settle(rows, first, starts[~ask], owner[~ask], least[~ask])
        waiting.append((rows, own, first, starts[ask].astype(np.int32), owner[ask].astype(np.int32)))
    for rows, own, first, starts, owner in waiting:
        settle(rows, first, starts, owner, value[np.searchsorted(merged, strings_of(own, starts))])
    return bits


def _content(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes, by 8-byte steps; equal hashes are compared before they count."""
    h = mix64(lengths.astype(np.uint64))
    for k in range(0, LENGTH + SPAN, 8):
        part, left = _step(data, starts, lengths, k)
        h = np.where(left > 0, mix64(h * np.uint64(31) + part), h)
    return h


def _step(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int):
    """(the number of the up to 8 bytes from the k-th of each span, how many these are)."""
    left = np.clip(lengths - k, 0, 8)
    eight = _eights_at(data)[np.minimum(starts + k, len(data))].astype(np.uint64)
    return eight >> ((8 - np.maximum(left, 1)) * 8).astype(np.uint64), left


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans from a and from b have the same bytes, all of them compared."""
    same, differ = np.ones(len(a), bool), np.flatnonzero(a != b)
    for k in range(0, LENGTH + SPAN, 8):
        (one, left), (two, _) = (_step(data, x[differ], lengths[differ], k) for x in (a, b))
        same[differ] &= (left == 0) | (one == two)
    return same


_BLOCK = "bucket int, data binary, lengths binary, keys binary, ids binary, times binary, starts binary, known binary"
_FIELDS = (("data", np.uint8), ("lengths", np.int32), ("keys", np.uint32), ("ids", np.int64), ("times", np.int32), ("starts", np.int32), ("known", np.uint64))


def removed_starts(docs: DataFrame, wire: Wire, n_buckets: int, common: np.ndarray) -> DataFrame:
    """(doc_id, starts, bits): removed windows, 64 from a start at most. ``docs(doc_id, packed, at)``; ``common``: names of keys."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # COMMON_KEYS at most

    def send(batches):
        let_go()
        press, common = _codec(wire.dictionary)[0], shared.value
        for batch in batches:
            ready = pa.RecordBatch.from_arrays([batch.column(0), wire.unpack(batch.column(1))], names=["doc_id", "text"])
            marks = lists_of(batch.column(2))
            for ids, texts, rows in slices(ready, limit=SLICE):
                found, base = [], 0
                whole = np.frombuffer(b"".join(texts), np.uint8)
                for i, (t, r) in enumerate(zip(texts, rows.tolist())):
                    if len(t) >= LENGTH and len(marks[r]):
                        text = whole[base : base + len(t)]
                        start, windows, key = contexts(text, marks[r])
                        often = among(key_names(key, n_buckets), common)
                        if often.any():
                            start, windows, key = dealt_out(text, start, windows, key, often)
                        found.append((start + base, start, windows + LENGTH - 1, key, np.full(len(start), i)))
                    base += len(t)
                if not found:
                    continue
                at, start, lengths, keys, owner = (np.concatenate(x) for x in zip(*found))
                if not len(at):
                    continue
                doc = ids[owner]
                # equal contexts of a slice are sent once, for the least document (the slice is in order of id)
                content = _content(whole, at, lengths)
                order = np.argsort(content, kind="stable")
                new = np.concatenate(([True], content[order][1:] != content[order][:-1]))
                lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                same = (lengths[order] == lengths[lead]) & _equal(whole, at[order], at[lead], lengths[order])
                alone = ~same
                lead = np.where(alone, order, lead)
                later = doc[order] > doc[lead]
                # occurrences in the least document itself share its verdict
                joined = np.flatnonzero(~later)
                by_lead = joined[np.argsort(lead[joined], kind="stable")]
                leads, times = np.unique(lead[by_lead], return_counts=True)
                occurrences = start[order[by_lead]]
                all_bits = np.full(len(order), 0, np.uint64)
                windows = (lengths - LENGTH + 1).astype(np.uint64)
                all_bits = np.where(windows >= 64, _MAX, (np.uint64(1) << np.minimum(windows, np.uint64(63))) - np.uint64(1))
                gone = order[later]
                first_of = np.cumsum(times) - times
                out = []
                for b, (which,) in by_bucket(bucket_of(keys[leads], n_buckets), np.arange(len(leads))):
                    c = leads[which]
                    out.append([b, gather(whole, at[c], lengths[c]), lengths[c].astype(np.int32), (keys[c] >> np.uint64(32)).astype(np.uint32), doc[c], times[which].astype(np.int32), gather(occurrences, first_of[which], times[which]).astype(np.int32), np.zeros(len(c), np.uint64)])
                for b, (which,) in by_bucket(bucket_of(mix64(doc[gone].view(np.uint64) + start[gone].astype(np.uint64)), n_buckets), gone):
                    out.append([b, np.zeros(0, np.uint8), np.zeros(len(which), np.int32), np.zeros(len(which), np.uint32), doc[which], np.ones(len(which), np.int32), start[which].astype(np.int32), all_bits[which]])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([press.compress(r[1].tobytes()) for r in out], pa.binary()), *(pa.array([r[k + 1].tobytes() for r in out], pa.binary()) for k in range(1, len(_FIELDS)))], names=["bucket", *(f for f, _ in _FIELDS)])

    def judge(block: pa.Table) -> pa.Table:
        let_go()
        plain = _codec(wire.dictionary)[1]
        data = np.frombuffer(b"".join(plain.decompress(b) for b in block.column("data").to_pylist()), np.uint8)
        lengths, keys, ids, times, starts, known = (np.frombuffer(b"".join(block.column(c).to_pylist()), t) for c, t in _FIELDS[1:])
        bits, open_ = known.copy(), np.flatnonzero(lengths > 0)
        if len(open_):
            bits[open_] = judge_contexts(data, lengths[open_].astype(np.int64), keys[open_], ids[open_])
        each = np.repeat(bits, times)
        some = each > 0
        return pa.table({"doc_id": pa.array(np.repeat(ids, times)[some], pa.int64()), "start": pa.array(starts[some], pa.int32()), "bits": pa.array(each[some].view(np.int64), pa.int64())})

    judged = docs.mapInArrow(send, _BLOCK).groupBy("bucket").applyInArrow(judge, "doc_id long, start int, bits long")
    return judged.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("bits").alias("bits"))


def window_starts(starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The starts of all windows that the bits name."""
    some = (bits.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    row, k = np.nonzero(some)
    return starts[row] + k


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> tuple[DataFrame, Wire, DataFrame | None]:
    """((doc_id, packed, starts, bits), wire, back): each document, by the ids of ``with_ids``, with the windows that a smaller document has too."""
    rows, back = with_ids(docs, id_col, text_col)
    wire, n = Wire(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), buckets_for(rows)
    packed = wire.packed(rows)
    places, names = anchors_and_common(rows, _anchors, n, SLICE, common, COMMON_KEYS)
    marked = packed.join(places, "doc_id", "left")
    return packed.join(removed_starts(marked, wire, n, names), "doc_id", "left"), wire, back


def without_repeats(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``."""
    found, wire, back = repeated_bytes(docs, common=common)

    def run(batches):
        let_go()
        for batch in parts(batches):
            n, gone, spans, digests = [], [], [], []
            for text, starts, bits in zip(wire.unpack(batch.column(1)).to_pylist(), lists_of(batch.column(2)), lists_of(batch.column(3))):
                away = covered(len(text), window_starts(starts, bits), LENGTH)
                n.append(len(text))
                gone.append(int(away.sum()))
                spans.append(int(np.count_nonzero(away[1:] & ~away[:-1])) + int(len(away) > 0 and away[0]))
                digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~away].tobytes() if gone[-1] else text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return own_ids(out, back)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
