"""Benchmark decontamination by template windows.

Words are lower-cased and stripped of outer punctuation; numbers, names and units
become typed placeholders (their values are kept as slots). Windows of five template
words of documents and benchmark items are hash-joined. A second hash of the literal
words, of every window, finds verbatim copies where placeholders say too little. Of the
hits on one diagonal (same offset between document and item) those by literal words
count always; those by template count unless they hold a clashing slot, that is a value
of the item that goes with several values in the document. So a re-parameterised
question matches, and an edited value costs only the windows around it. A document is
contaminated by an item if it holds 80 % of the item's window positions, or 80 % of those
that count as templates (new parameters leave only these), or 16 of its windows on one
diagonal (20 words in a row).

The item windows are handed to every task only if a count shows that they are at
most ``BROADCAST_WINDOWS`` (16 MB); each document is then judged where it lies. Beyond
that the same hits come from a Spark join, by row (id and text), and are judged the same.

Cases: null text counts as empty and is clean; a text of under five words is one
window, and an item of under five words also matches literally, at its own width,
anywhere in a document; windows of which over three words or all are placeholders match
literally only; an item without a word (empty, or outer punctuation only) matches
nothing; of several texts of one item id the least counts, an item without an id doesn't;
each row of documents is judged by its own text, also with a null id or one that other
texts have too; texts of any length are judged whole; repeated rows give repeated
results; empty tables give clean or empty results; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, bounded_slices, filter_rows, map_batches, mix64, table

WINDOW, SHARE, RUN = 5, 0.8, 16
MOST_SLOTS = 3
BROADCAST_WINDOWS = 1 << 20
REMEMBERED, SLICE = 1 << 18, 1 << 20
#: Units of measure, as plain words.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hours minutes seconds days weeks months years meters metres miles feet inches pounds grams liters litres dollars euros cents usd eur percent degrees".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?$")
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "“”‘’«»¿¡…–—"
_PLAIN, _NUM, _TITLE, _UNIT, _VOID = range(5)
_HOLD = np.array([xxhash.xxh64_intdigest(f"<{x}>".encode()) for x in ("NUM", "NAME", "UNIT")], np.uint64)
_TYPED, _LITERAL, _DENSE = range(3)  # by template; by words; by words, and the item's window has no template that counts
_LITERAL_SEED, _LITERAL_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FOUND = "array<struct<item_id:long,share:double,run:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("run", pa.int32())]))


def _describe(word: str) -> tuple[int, int, bool]:
    """(hash of the plain word, kind, whether a sentence may end with it)."""
    core = word.strip(_EDGE)
    ends = word[-1:] in ".!?:" or word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":")
    if not core:
        return 0, _VOID, ends
    low = core.lower()
    kind = _NUM if _NUMBER.match(core) else _UNIT if low in UNITS else _TITLE if core[0].isupper() and core[1:] != core[1:].upper() else _PLAIN
    return xxhash.xxh64_intdigest(low.encode()), kind, ends


class Canonical:
    """Template words of texts: arrays of template hashes, values and slot marks."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.hashes: list[int] = []
        self.kinds: list[int] = []
        self.ends: list[bool] = []

    def _row(self, word: str) -> int:
        at = self.known[word] = len(self.hashes)
        h, kind, ends = _describe(word)
        self.hashes.append(h)
        self.kinds.append(kind)
        self.ends.append(ends)
        return at

    def words(self, texts: list[str]):
        """(template, value, slot, owner) over all texts; owner is the text's number."""
        if len(self.known) > REMEMBERED:
            self.__init__()
        rows, sizes, get = [], [], self.known.get
        for t in texts:
            own = [x if (x := get(w)) is not None else self._row(w) for w in t.split()]
            rows += own
            sizes.append(len(own))
        at = np.array(rows, np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        value = np.array(self.hashes, np.uint64)[at] if len(at) else np.zeros(0, np.uint64)
        kind = np.array(self.kinds, np.int8)[at] if len(at) else np.zeros(0, np.int8)
        ends = np.array(self.ends, bool)[at] if len(at) else np.zeros(0, bool)
        first = np.concatenate(([True], owner[1:] != owner[:-1]))[: len(at)]
        after_end = first | np.concatenate(([True], ends[:-1]))[: len(at)]
        number = kind == _NUM
        after_number = np.concatenate(([False], number[:-1]))[: len(at)] & ~first
        name = (kind == _TITLE) & ~after_end
        unit = (kind == _UNIT) & after_number
        template = value.copy()
        for mark, mask in zip(_HOLD, (number, name, unit)):
            template[mask] = mark
        keep = kind != _VOID
        return template[keep], value[keep], (number | name | unit)[keep], owner[keep]


def windows(template: np.ndarray, slot: np.ndarray, owner: np.ndarray):
    """(hash, start, width) of all windows that count; a text under WINDOW words is one window."""
    n = len(template)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
    sizes = np.diff(edge)
    left = np.repeat(edge[1:], sizes) - np.arange(n)  # words from here to the text's end
    start = np.flatnonzero((left >= WINDOW) | np.isin(np.arange(n), edge[:-1][sizes < WINDOW]))
    width = np.minimum(left[start], WINDOW)
    h, slots = mix64(width.astype(np.uint64)), np.zeros(len(start), np.int64)
    for k in range(WINDOW):
        at = np.minimum(start + k, n - 1)
        inside = k < width
        h = np.where(inside, mix64(h * np.uint64(31) + template[at]), h)
        slots += inside & slot[at]
    fine = (slots <= MOST_SLOTS) & (slots < width)
    return h[fine], start[fine], width[fine]


def literal_windows(value: np.ndarray, owner: np.ndarray, short=None):
    """(hash, start, width) of all windows by their literal words.

    A text of under WINDOW words is one window of its own width; with ``short`` there are
    windows of these widths at every place of every text instead.
    """
    n, out = len(value), [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    sizes = np.bincount(owner) if n else np.zeros(0, np.int64)
    for width in range(1, WINDOW + 1) if short is None else (*short, WINDOW):
        m = n - width + 1
        if m <= 0:
            continue
        own = owner[:m] == owner[width - 1 :]
        if short is None and width < WINDOW:
            own &= sizes[owner[:m]] == width
        start = np.flatnonzero(own)
        if not len(start):
            continue
        h = np.full(m, _LITERAL_SEED ^ np.uint64(width))
        for k in range(width):
            h = (h ^ value[k : k + m]) * _LITERAL_STEP
            h ^= h >> np.uint64(32)
        out.append((h[start], start, np.full(len(start), width)))
    return tuple(np.concatenate(x) for x in zip(*out))


def both_windows(template, value, slot, owner, short=None):
    """(hash, start, width, way) of all windows, by template and by literal words."""
    typed, literal = windows(template, slot, owner), literal_windows(value, owner, short)
    counts = np.zeros(len(template) + 1, bool)
    counts[typed[1]] = True
    way = np.concatenate((np.full(len(typed[0]), _TYPED), np.where(counts[literal[1]], _LITERAL, _DENSE)))
    return (*(np.concatenate(x) for x in zip(typed, literal)), way)


def _sizes(owner, start, way, ids) -> dict[int, tuple[int, int]]:
    """item_id -> (window positions, those that count as templates)."""
    out = {}
    for o in np.unique(owner[start]).tolist() if len(start) else ():
        own = owner[start] == o
        out[int(ids[o])] = (len(np.unique(start[own])), len(np.unique(start[own & (way == _TYPED)])))
    return out


def judge(hits, sizes: dict[int, tuple[int, int]]) -> list[tuple[int, float, int]]:
    """(item_id, share, run) of the items that one document holds; a hit is (pos, item_id, ipos, way, [(item's value, document's value)])."""
    diagonals: dict[tuple, list] = {}
    for pos, item, ipos, way, pairs in hits:
        diagonals.setdefault((item, pos - ipos), []).append((ipos, way, pairs))
    found: dict[int, list] = {}
    for (item, _), rows in diagonals.items():
        values: dict[int, set] = {}
        for _, _, pairs in rows:
            for i, d in pairs:
                values.setdefault(i, set()).add(d)
        kept = [(ipos, way) for ipos, way, pairs in rows if way != _TYPED or all(len(values[i]) == 1 for i, _ in pairs)]
        at, dense, run = found.setdefault(item, [set(), set(), 0])
        own = {ipos for ipos, _ in kept}
        at |= own
        dense |= {ipos for ipos, way in kept if way == _DENSE}
        found[item][2] = max(run, len(own))
    out = []
    for item, (at, dense, run) in found.items():
        n, typed = sizes[item]
        share = max(len(at) / n, len(at - dense) / typed if typed else 0.0)
        if share >= SHARE or run >= RUN:
            out.append((item, share, run))
    return sorted(out)


def item_windows(items: list[tuple[int, str]]) -> dict[str, np.ndarray]:
    """All windows of the items, by hash: hash, item_id, ipos, way, the values and slots they point into, and the widths of short items."""
    template, value, slot, owner = Canonical().words([t for _, t in items])
    h, start, width, way = both_windows(template, value, slot, owner)
    first = np.searchsorted(owner, owner[start]) if len(start) else start
    order = np.argsort(h, kind="stable")
    ids = np.array([i for i, _ in items], np.int64)
    short = np.unique(width[width < WINDOW]).tolist()
    return {"hash": h[order], "item": ids[owner[start]][order] if len(ids) else np.zeros(0, np.int64), "ipos": (start - first)[order], "at": start[order], "way": way[order], "value": value, "slot": slot, "short": short, "sizes": _sizes(owner, start, way, ids)}


class _Matcher:
    """Finds benchmark windows among a document's, by a bit table first and then a binary search."""

    def __init__(self, index):
        self.index, self.bits = index, np.zeros(1 << 22, bool)
        self.bits[index["hash"] >> np.uint64(42)] = True

    def hits(self, h):
        maybe = np.flatnonzero(self.bits[h >> np.uint64(42)])
        low = np.searchsorted(self.index["hash"], h[maybe], "left")
        high = np.searchsorted(self.index["hash"], h[maybe], "right")
        some = high > low
        return maybe[some], low[some], high[some]


def local_judge(index):
    """A function of texts: what ``judge`` finds for each."""
    matcher, words = _Matcher(index), Canonical()

    def found(texts: list[str]) -> list[list[tuple[int, float, int]]]:
        out: list = [[] for _ in texts]
        for at, to in bounded_slices(np.array([len(t) for t in texts]), SLICE):
            template, value, slot, owner = words.words(texts[at:to])
            h, start, width, _ = both_windows(template, value, slot, owner, index["short"])
            which, low, high = matcher.hits(h)
            hits: dict[int, list] = {}
            for w, a, b in zip(which.tolist(), low.tolist(), high.tolist()):
                d, n = int(start[w]), int(width[w])
                pos = d - int(np.searchsorted(owner, owner[d]))
                for r in range(a, b):
                    i, way = int(index["at"][r]), int(index["way"][r])
                    pairs = [(int(index["value"][i + k]), int(value[d + k])) for k in np.flatnonzero(index["slot"][i : i + n]).tolist()]
                    hits.setdefault(at + int(owner[d]), []).append((pos, int(index["item"][r]), int(index["ipos"][r]), way, pairs))
            for row, own in hits.items():
                out[row] = judge(own, index["sizes"])
        return out

    return found


def window_rows(rows: DataFrame, id_type: str, short=None) -> DataFrame:
    """(id, pos, h, way, values): every window of every row of ``rows(id, text)``; values are null but in slots."""

    def run(batch):
        ids, texts, c = batch.column(0).to_pylist(), as_text(batch.column(1)), Canonical()
        out = [[], [], [], [], []]
        for i, t in zip(ids, texts):
            template, value, slot, owner = c.words([t])
            h, start, width, way = both_windows(template, value, slot, owner, short)
            for x, s, w, y in zip(h.view(np.int64).tolist(), start.tolist(), width.tolist(), way.tolist()):
                out[0].append(i)
                out[1].append(s)
                out[2].append(x)
                out[3].append(y)
                out[4].append([int(value[s + k].view(np.int64)) if slot[s + k] else None for k in range(w)])
        return pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.list_(pa.int64()))], names=["id", "pos", "h", "way", "values"])

    return map_batches(rows, ["id", "text"], run, f"id {id_type}, pos int, h long, way int, values array<long>")


def _row_key(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, text)`` with a key of the row's id and text; equal rows have equal keys."""
    return rows.withColumn("key", F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))))


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(key, found) of the rows that hold an item, by a join of all windows; ``rows(key, text)``."""
    i = window_rows(items.select(F.col("item_id").alias("id"), "text"), "long").select(F.col("id").alias("item_id"), F.col("pos").alias("ipos"), "h", "way", F.col("values").alias("iv"))
    sizes = i.groupBy("item_id").agg(F.countDistinct("ipos").alias("n_pos"), F.countDistinct(F.when(F.col("way") == _TYPED, F.col("ipos"))).alias("n_typed"))
    short = sorted(r["n"] for r in i.select(F.size("iv").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # WINDOW - 1 widths at most
    d = window_rows(rows.select(F.col("key").alias("id"), "text"), "string", short).select(F.col("id").alias("key"), "pos", "h", F.col("values").alias("dv"))
    # literal hits have the item's own values, also where the document's word is no slot
    pairs = F.filter(F.zip_with("iv", "dv", lambda a, b: F.struct(a.alias("i"), F.when(F.col("way") == _TYPED, b).otherwise(a).alias("d"))), lambda p: p["i"].isNotNull())
    hits = d.join(i, "h").select("key", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal"), "ipos", "way", pairs.alias("pairs"))
    # the values that clash on a diagonal, then the hits without them
    values = hits.filter(F.size("pairs") > 0).select("key", "item_id", "diagonal", F.explode("pairs").alias("p")).groupBy("key", "item_id", "diagonal", "p.i").agg(F.min("p.d").alias("a"), F.max("p.d").alias("b"))
    clash = values.filter("a != b").groupBy("key", "item_id", "diagonal").agg(F.collect_set("i").alias("clash"))
    kept = hits.join(clash, ["key", "item_id", "diagonal"], "left").filter((F.col("way") != _TYPED) | F.col("clash").isNull() | ~F.exists("pairs", lambda p: F.array_contains("clash", p["i"])))
    places = kept.groupBy("key", "item_id", "diagonal", "ipos").agg(F.max(F.col("way") == _DENSE).alias("dense"))
    runs = places.groupBy("key", "item_id", "diagonal").agg(F.count("*").cast("int").alias("run"))
    best = runs.groupBy("key", "item_id").agg(F.max("run").alias("run"))
    total = places.groupBy("key", "item_id", "ipos").agg(F.max("dense").alias("dense")).groupBy("key", "item_id").agg(F.count("*").alias("found"), F.count_if(~F.col("dense")).alias("typed"))
    share = F.greatest(F.col("found") / F.col("n_pos"), F.col("typed") / F.nullif("n_typed", F.lit(0)))
    scored = total.join(best, ["key", "item_id"]).join(sizes, "item_id").select("key", "item_id", share.alias("share"), "run")
    held = scored.filter((F.col("share") >= SHARE) | (F.col("run") >= RUN))
    return held.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("item_id", "share", "run"))).alias("found"))


def _prepared(items: DataFrame, broadcast_windows: int):
    """(items, the index of their windows or None if it may be too large for every task)."""
    items = items.filter("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    bound = items.agg(F.sum(F.length("text"))).first()[0] or 0  # an item has no more windows than characters and one
    if bound <= 8 * broadcast_windows:
        index = item_windows([(r["item_id"], r["text"]) for r in items.orderBy("item_id").collect()])
        if len(index["hash"]) <= broadcast_windows:
            return items, index
    return items, None


def with_found(docs: DataFrame, items: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, found array<struct<item_id, share, run>>) of every row of ``docs``: the items that it holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, index = _prepared(items, broadcast_windows)
    if index is None:
        rows = _row_key(docs)
        found = _joined(rows.dropDuplicates(["key"]), items)
        return rows.select("doc_id", "key").join(found, "key", "left").select("doc_id", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))
    state: dict = {}

    def run(batch):
        if not state:
            state["find"] = local_judge(index)
        found = state["find"](as_text(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("item_id", "share", "run"), f)) for f in own] for own in found], _FOUND_TYPE)], names=["doc_id", "found"])

    return map_batches(docs, ["doc_id", "text"], run, f"doc_id long, found {_FOUND}")


def contamination(docs: DataFrame, items: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, share, run) of every contaminated document and item."""
    return with_found(docs, items, broadcast_windows).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    share = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.transform("found", lambda f: f["item_id"]).alias("item_ids"), F.round(share, 6).alias("share"))


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without contaminated rows; columns as they were. Rows are judged one by one, so ids may be null or shared."""
    items, index = _prepared(items, broadcast_windows)
    if index is None:
        keyed = _row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        away = _joined(keyed.dropDuplicates(["key"]), items).select(F.col("key").alias("_away"))
        name = F.md5(F.concat_ws("\0", F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("-")), F.coalesce(docs["text"], F.lit(""))))
        return docs.join(away, name == away["_away"], "left_anti")
    state: dict = {}

    def clean(texts):
        if not state:
            state["find"] = local_judge(index)
        return [not own for own in state["find"](texts)]

    return filter_rows(docs, clean)
