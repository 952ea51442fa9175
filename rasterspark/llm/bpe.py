"""Byte-level BPE encoding and decoding with a transducer of frequent words.

Word counts cover all documents. The ``LEXICON_WORDS`` most frequent words (of at
most ``LEXICON_BYTES`` bytes, so the block's size is bounded) are merged once on the
driver and compiled with their ids into a minimal acyclic transducer, which each
Python worker memory-maps. Other words are merged exactly where they occur, many at
once, one merge of each at a step.

Texts are handled many at once as arrays: the distinct stretches between spaces are
found, then the distinct pieces of these, and the ids and decoded bytes of a piece are
made once and put together to those of stretches and of texts.

Cases: null text counts as empty and has no tokens; a text of any length is handled
whole, in a worker's memory; the vocabulary's special token in a text gets its own id;
a null doc_id stays null, and rows that share an id are rows of their own; equal rows
give equal rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, bounded_slices, cut, held, let_go, table
from .lexicon import Lexicon, Words, compile_lexicon, compile_words
from .pretokens import PLACED, WORD, byte_level_pieces, byte_symbols, is_plain, stretch_key, stretch_pieces, stretches

LEXICON_WORDS = 1 << 18
LEXICON_BYTES = 32
#: Text encoded at once in a worker, words merged at once, and text whose words are counted at once.
SLICE, TOGETHER, COUNTED = 3 << 20, 1 << 13, 12 << 20
#: Words of up to so many bytes are merged side by side; longer ones alone.
_WIDTHS = (6, 9, 12, 16, 24, 48)
_FAR, _NEVER = 1 << 60, np.int32((1 << 31) - 1)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Merges and ids of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in ids.items()}
        self.byte_ids = [ids[c] for c in byte_symbols()]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = dict(self.merges.values())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        pairs = np.array(list(self.ranks), np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        # the last entry is what a key beyond all others finds
        self._keys = np.append(keys[order], np.int64(_FAR))
        self._ranks = np.append(np.array(list(self.ranks.values()), np.int32)[order], _NEVER)
        self._made = np.zeros(max(self.made, default=0) + 1, np.int32)
        self._made[list(self.made)] = list(self.made.values())
        self._byte_ids = np.array(self.byte_ids, np.int32)

    def merge(self, word: bytes) -> list[int]:
        """The lowest-ranked pair first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > _WIDTHS[-1]:
            return self._merge_long(ids)
        get = self.ranks.get
        ranks = [get(p, _FAR) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _FAR:
                break
            at = ranks.index(least)
            ids[at : at + 2] = [self.made[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), _FAR)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), _FAR)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.merges[pair][1], None
            after[i] = k = after[j]
            if k < n:
                ahead[k] = i
            for left, right in ((ahead[i], i), (i, k)):
                if left >= 0 and right < n and (p := (ids[left], ids[right])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], left, p))
        return [i for i in ids if i is not None]


    def merge_all(self, words: Words) -> Words:
        """The ids of each word, as ``merge`` gives them; words of about the same length go step by step together."""
        sizes, parts, least = words.sizes.copy(), [], 0
        for most in (*_WIDTHS, None):
            here = np.flatnonzero((words.sizes > least) & (words.sizes <= most) if most else words.sizes > least)
            step = TOGETHER if most else 1
            for at in range(0, len(here), step):
                rows = here[at : at + step]
                if most:
                    ids, sizes[rows] = self._merge_together(words.take(rows))
                else:
                    ids = np.array([self.merge(words.one(int(rows[0])))], np.int32)
                    sizes[rows] = ids.shape[1]
                parts.append((rows, ids))
            least = most
        out = Words(np.zeros(int(sizes.sum()), np.int32), sizes)
        for rows, ids in parts:
            column = np.arange(ids.shape[1])
            own = column < sizes[rows, None]
            out.flat[(out.starts[rows, None] + column)[own]] = ids[own]
        return out

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], _NEVER)

    def _merge_together(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them count) of each word, one row a word. Each step makes one merge in every row that has one left."""
        sizes = words.sizes.copy()
        column = np.arange(int(sizes.max()) + 1)
        out = np.zeros((len(sizes), len(column)), np.int32)
        out[column < sizes[:, None]] = self._byte_ids[words.flat]
        # ranks[i, j] is that of the pair that starts at j; NEVER where there is none, in the last column always
        ranks = np.full(out.shape, _NEVER, np.int32)
        row, j = np.nonzero(column < sizes[:, None] - 1)
        ranks[row, j] = self._ranks_of(out[row, j], out[row, j + 1])
        live, ids = np.arange(len(out)), out.copy()
        while len(live):
            at = ranks.argmin(axis=1)  # the leftmost of equals
            least = ranks[np.arange(len(at)), at]
            go = least != _NEVER
            if not go.all():
                out[live[~go], : ids.shape[1]] = ids[~go]
                live, ids, ranks, at, least = live[go], ids[go], ranks[go], at[go], least[go]
            if not len(live):
                break
            sizes[live] -= 1
            row, width = np.arange(len(live)), ids.shape[1] - 1
            ids[row, at] = self._made[least]
            kept = np.ones(ids.shape, bool)
            kept[row, at + 1] = False
            ids = ids[kept].reshape(-1, width)
            kept[row, at + 1], kept[row, at] = True, False
            ranks = ranks[kept].reshape(-1, width)
            last = at + 1 >= sizes[live]
            ranks[row[last], at[last]] = _NEVER
            row, j = row[~last], at[~last]
            ranks[row, j] = self._ranks_of(ids[row, j], ids[row, j + 1])
            row, j = np.flatnonzero(at > 0), at[at > 0]
            ranks[row, j - 1] = self._ranks_of(ids[row, j - 1], ids[row, j])
        return out, sizes


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts as arrays: texts to stretches, distinct stretches to pieces, distinct pieces to ids, and back up."""

    def __init__(self, path: str, block: bytes):
        self.vocabulary, self.lexicon = vocabulary(path), Lexicon(block)
        self.tokens = pa.array(self.vocabulary.tokens, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(len(self.tokens))], pa.large_binary())
        self.specials = sorted(self.vocabulary.special, key=len, reverse=True)

    def _apart(self, text: str, at: int = 0) -> list[str]:
        """The stretches of a text that holds special tokens; these are found first and stand alone."""
        for k, s in enumerate(self.specials[at:], at):
            if s in text:
                own = [stretch_key(s)]
                return [y for i, x in enumerate(text.split(s)) for y in (own * (i > 0) + self._apart(x, k + 1))]
        return stretches(text)

    def _stretches(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(names of all stretches, how many each text has)."""
        plain = np.array([is_plain(t) and not any(s in t for s in self.specials) for t in texts], bool)
        split = pc.split_pattern(pa.array([PLACED + t for t, p in zip(texts, plain.tolist()) if p], pa.large_string()), " ")
        counts, values = np.zeros(len(texts), np.int64), split.flatten()
        counts[plain] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        if plain.all():
            return values, counts
        others = [self._apart(t) for t, p in zip(texts, plain.tolist()) if not p]
        counts[~plain] = list(map(len, others))
        # back in the order of the texts
        values = pa.concat_arrays([values, pa.array(list(chain.from_iterable(others)), pa.large_string())])
        first = np.zeros(len(texts), np.int64)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        first[order] = np.cumsum(counts[order]) - counts[order]
        return values.take(pa.array(_spread(first, counts))), counts

    def _pieces(self, names: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(names of all pieces of distinct stretches, how many each stretch has)."""
        counts = np.ones(len(names), np.int64)
        whole = pc.match_substring_regex(names, WORD).to_numpy(zero_copy_only=False) | pc.is_in(names, pa.array([stretch_key(s) for s in self.specials], pa.large_string())).to_numpy(zero_copy_only=False)
        others = [[] if name == PLACED else stretch_pieces(name) for name in names.filter(pa.array(~whole)).to_pylist()]
        counts[~whole] = list(map(len, others))
        values = pa.concat_arrays([names.filter(pa.array(whole)), pa.array(list(chain.from_iterable(others)), pa.large_string())])
        first = np.zeros(len(names), np.int64)
        order = np.concatenate((np.flatnonzero(whole), np.flatnonzero(~whole)))
        first[order] = np.cumsum(counts[order]) - counts[order]
        return values.take(pa.array(_spread(first, counts))), counts

    def _ids(self, names: pa.Array) -> Words:
        """The ids of distinct pieces: from the lexicon, or merged."""
        spaced = Words.of(pc.binary_join_element_wise(pa.scalar(" ", names.type), names, pa.scalar("", names.type)).cast(pa.large_binary()))
        skip = 2 * pc.starts_with(names, PLACED).to_numpy(zero_copy_only=False).astype(np.int64)
        words = Words(spaced.flat[_spread(spaced.starts + skip, spaced.sizes - skip)], spaced.sizes - skip)
        ranks = self.lexicon.ranks(words)
        parts = [(np.flatnonzero(ranks >= 0), self.lexicon.outputs(ranks[ranks >= 0]))]
        unseen = np.flatnonzero(ranks < 0)
        parts.append((unseen, self.vocabulary.merge_all(words.take(unseen))))
        for s in self.specials:
            at = pc.index(names, pa.scalar(stretch_key(s), names.type)).as_py()
            if at >= 0:
                parts = [(rows[rows != at], ids.take(np.flatnonzero(rows != at))) for rows, ids in parts]
                parts.append((np.array([at]), Words(np.array([self.vocabulary.special[s]], np.int32), np.array([1]))))
        order = np.argsort(np.concatenate([rows for rows, _ in parts]))
        return Words(np.concatenate([ids.flat for _, ids in parts]), np.concatenate([ids.sizes for _, ids in parts])).take(order)

    def encode(self, texts: list[str], decimal: bool = False) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, ids or with ``decimal`` their decimals joined by commas, decoded bytes) of each text."""
        names, of_text = _distinct(*self._stretches(texts))
        pieces, of_name = _distinct(*self._pieces(names))
        ids = self._ids(pieces)
        raw = _joined(_joined(_joined(self.tokens, ids), of_name), of_text)
        n = of_text.sums(of_name.sums(ids.sizes))
        if decimal:
            shown = pc.utf8_rtrim(_joined(_joined(_joined(self.decimal, ids), of_name), of_text).cast(pa.large_string()), ",")
        else:
            listed = of_name.take(of_text.flat)  # pieces of each stretch of each text
            shown = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(n))), ids.take(listed.flat).flat)
        return n, shown, raw

    def decode(self, ids: list[int]) -> str:
        return _text(b"".join(map(self.vocabulary.tokens.__getitem__, ids)))


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (counts[i] of them), for each i in turn."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _distinct(values: pa.Array, counts: np.ndarray) -> tuple[pa.Array, Words]:
    """(distinct values, the numbers of those of each row)."""
    coded = values.dictionary_encode()
    return coded.dictionary, Words(coded.indices.to_numpy(), counts)


def _joined(values: pa.Array, rows: Words) -> pa.Array:
    """For each row the values it numbers, one after another."""
    parts = Words.of(values.take(pa.array(rows.flat)))
    ends = np.concatenate(([0], np.cumsum(parts.sizes)))[np.concatenate((rows.starts, [len(rows.flat)]))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows.sizes), [None, pa.py_buffer(ends), pa.py_buffer(parts.flat)])


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", errors="replace")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents, of space-separated words; each task adds up those of a slice first."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.large_string())
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in bounded_slices(lengths, COUNTED):
                found = pc.split_pattern(texts[a:b], " ").flatten().value_counts()
                words, n = found.field("values"), found.field("counts")
                size = pc.binary_length(words).to_numpy()
                kept = pa.array((size > 0) & (size <= LEXICON_BYTES))
                yield pa.RecordBatch.from_arrays([words.filter(kept).cast(pa.string()), n.filter(kept)], names=["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, size: int) -> DataFrame:
    """(word, n) of about the ``size`` most frequent words of ``counts(word, n, size)``.

    Tables of count sizes and of counts tell where to cut, so no words are sorted or merged on the
    driver. Of words with the count at the cut about the share that fits is taken, by hashes.
    """
    least, above, more = 0, 0, 0
    for row in sorted(counts.groupBy("size").count().collect(), key=lambda r: -r["size"]):
        least, above, more = row["size"], above + more, row["count"]
        if above + more > size:
            break
    else:
        return counts.select("word", "n")
    # one row a count between 2^least and twice that
    for row in sorted(counts.filter(F.col("size") == least).groupBy("n").count().collect(), key=lambda r: -r["n"]):
        if above + row["count"] > size:
            break
        above += row["count"]
    share = int((size - above) / row["count"] * (1 << 32))
    return counts.filter((F.col("n") > row["n"]) | ((F.col("n") == row["n"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < share))).select("word", "n")


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The compiled block. The driver has it all at once, so words stay in arrays and what it took is handed back."""
    # words seen once can't matter before all others do
    counts = cut(word_counts(docs, text_col).filter("n > 1").withColumn("size", F.floor(F.log2("n")).cast("int")))
    parts = []
    for batch in frequent(counts, size).toArrow().to_batches():
        own = [byte_level_pieces(" " + word) for word in batch.column(0).to_pylist()]
        n = np.repeat(batch.column(1).to_numpy(), list(map(len, own)))
        parts.append(pa.table({"piece": pa.array(chain.from_iterable(own), pa.large_string()).cast(pa.large_binary()), "n": n}).group_by("piece").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}))
    if not parts:
        return compile_lexicon({})
    words = pa.concat_tables(parts).group_by("piece").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("piece", "ascending")])[:size].column("piece")
    del parts
    spelt = words.filter(pc.less_equal(pc.binary_length(words), LEXICON_BYTES)).combine_chunks()
    spelt = Words.of(spelt.take(pc.sort_indices(spelt)))
    block = compile_words(spelt, Vocabulary(path).merge_all(spelt))
    del words, spelt
    let_go()
    return block


def _encoder(path: str, block) -> Encoder:
    """One per worker process and lexicon."""
    return held(("bpe", block.id), lambda: Encoder(path, block.value))


class _Block:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast else 0

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def encode_documents(docs: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): whole texts, exact round trip of the ids."""
    return _encoded(docs, path, text_col, id_col, digest=False)


def _encoded(docs, path, text_col, id_col, digest):
    path = path or vocabulary_path()
    block = _Block(docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, text_col)))

    def run(batches):
        encoder = _encoder(path, block)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in bounded_slices(lengths, SLICE):
                n, shown, raw = encoder.encode(as_text(batch.column(1)[a:b]), digest)
                texts = map(_text, raw.to_pylist())
                own = batch.column(0)[a:b]
                if digest:
                    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                    yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(map(sha, shown.to_pylist()), pa.string()), pa.array(map(sha, texts), pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([own, shown.cast(pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    def task(batches):
        let_go(("bpe", block.id))
        return run(batch for batch in batches if batch.num_rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(table(spark, sf_dir, "documents"), None, "text", "doc_id", digest=True)
