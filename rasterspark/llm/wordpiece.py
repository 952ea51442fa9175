"""Greedy longest-match token counts in linear time.

A trie of the vocabulary has failure links and, for each, the number of pieces that
following it pops (the linear-time WordPiece method of Song and others, 2021). A
word's count is the sum of pops along its path; pieces are never built. The last
byte of a word is a symbol of its own, as the vocabulary marks word ends.

Cases: null text counts as empty, with no words and no tokens; equal rows give equal
rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, map_batches, table
from .pretokens import byte_symbols, word_level_pieces

END = "</w>"
SLICE, REMEMBERED = 1 << 20, 1 << 18


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_symbols(path: str) -> set[tuple[int, ...]]:
    """Each token as byte symbols; 256 is added to a symbol that ends a word."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    to_byte = {c: b for b, c in enumerate(byte_symbols())}
    out = set()
    for token in tokens:
        body = token[: -len(END)] if token.endswith(END) and token != END else token
        if body and all(c in to_byte for c in body):
            symbols = [to_byte[c] for c in body]
            symbols[-1] += 256 * (body is not token)
            out.add(tuple(symbols))
    return out | {(s,) for s in range(512)}  # a single byte always has a token


class LongestMatch:
    def __init__(self, tokens: set[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        last = [False]
        for token in sorted(tokens):
            at = 0
            for s in token:
                if s not in children[at]:
                    children[at][s] = len(children)
                    children.append({})
                    last.append(False)
                at = children[at][s]
            last[at] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = [0]
        for u in queue:  # breadth first
            for s, v in children[u].items():
                queue.append(v)
                if last[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                at, popped = fail[u], pops[u]
                while at >= 0 and s not in children[at]:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[v], pops[v] = children[at][s], popped
        edges = sorted((u << 9 | s, v) for u, own in enumerate(children) for s, v in own.items())
        self.keys = np.array([e[0] for e in edges], np.int64)
        self.targets = np.array([e[1] for e in edges], np.int64)
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of greedy pieces of each non-empty word; all words step together."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(n) - n
        flat[first + n - 1] += 256
        state, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        order = np.argsort(-n, kind="stable")
        longest_first = -n[order]
        for step in range(int(n.max()) if len(n) else 0):
            live = order[: np.searchsorted(longest_first, -step)]
            todo, symbol = live, flat[first[live] + step]
            while len(todo):
                key = state[todo] << 9 | symbol
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                state[todo[found]] = self.targets[at[found]]
                todo, symbol = todo[~found], symbol[~found]
                count[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        return count + self.pops[state]


@cache
def automaton(path: str) -> LongestMatch:
    return LongestMatch(vocabulary_symbols(path))


def normalise(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


def token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_tokens)."""
    path = path or vocabulary_path()
    known: dict[str, int] = {}

    def run(batch):
        texts, words_of, tokens_of, at = as_text(batch.column(1)), [], [], 0
        machine = automaton(path)
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= SLICE):
                group.append(word_level_pieces(normalise(texts[at])))
                size += len(texts[at])
                at += 1
            if len(known) > REMEMBERED:
                known.clear()
            new = list({w for words in group for w in words if w not in known})
            if new:
                known.update(zip(new, machine.counts([w.encode() for w in new]).tolist()))
            words_of += map(len, group)
            tokens_of += [sum(map(known.__getitem__, words)) for words in group]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], run, "doc_id long, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
