"""A minimal acyclic transducer: words to numbers, numbers to id sequences.

Words share prefixes and suffixes (states with equal futures are one state). Each
edge carries how many words sort before those behind it, so the sum along a path is
the word's rank, and the rank finds the word's ids. The whole is one block of bytes
that is memory-mapped and read in place.
"""

from __future__ import annotations

import os
import tempfile
from array import array

import numpy as np

_PARTS = ("keys", "targets", "skips", "final", "offsets", "ids")
_TYPES = {"keys": np.int64, "targets": np.int32, "skips": np.int32, "final": np.uint8, "offsets": np.int32, "ids": np.int32}


class Words:
    """Rows of different lengths, one after another in one array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, column) -> Words:
        """The bytes of a ``large_binary`` column without nulls."""
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(flat[ends[0] : ends[-1]], np.diff(ends))

    def take(self, rows: np.ndarray) -> Words:
        sizes = self.sizes[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return Words(self.flat[at], sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum of the values it numbers."""
        total = np.concatenate(([0], np.cumsum(np.asarray(values, np.int64)[self.flat])))
        return total[self.starts + self.sizes] - total[self.starts]

    def one(self, row: int) -> bytes:
        return self.flat[self.starts[row] : self.starts[row] + self.sizes[row]].tobytes()

    def lists(self) -> list[list[int]]:
        return [self.flat[a : a + n].tolist() for a, n in zip(self.starts.tolist(), self.sizes.tolist())]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """``compile_words`` of a dict; an empty word is left out."""
    ordered = sorted(w for w in words if w)
    ids = [words[w] for w in ordered]
    flat = np.frombuffer(b"".join(ordered), np.uint8)
    return compile_words(Words(flat, list(map(len, ordered))), Words(np.array([i for x in ids for i in x], np.int32), list(map(len, ids))))


def compile_words(words: Words, ids: Words) -> bytes:
    """Incremental construction from the words, distinct and sorted (Daciuk and others, 2000); ``ids`` has a row a word.

    States and edges are kept as numbers in arrays: this runs on the driver, beside its JVM.
    """
    register: dict[bytes, int] = {}
    final, count = bytearray(), array("i")  # of each state; children come before parents
    owner, byte, target, skip = array("i"), bytearray(), array("i"), array("i")  # of each edge

    def freeze(node: list[int]) -> int:
        """node: whether a word ends here, then the byte and state of each edge in turn."""
        at = register.setdefault(array("i", node).tobytes(), len(final))
        if at == len(final):
            total = node[0]
            for b, to in zip(node[1::2], node[2::2]):
                owner.append(at)
                byte.append(b)
                target.append(to)
                skip.append(total)
                total += count[to]
            final.append(node[0])
            count.append(total)
        return at

    path, before = [[0]], b""  # path[i]: the open state after i bytes of the last word
    for row in range(len(words.sizes)):
        word = words.one(row)
        same = len(os.path.commonprefix([before, word]))
        while len(path) > same + 1:
            at = freeze(path.pop())
            path[-1] += (before[len(path) - 1], at)
        path += [[0] for _ in range(len(word) - same)]
        path[-1][0] = 1
        before = word
    while len(path) > 1:
        at = freeze(path.pop())
        path[-1] += (before[len(path) - 1], at)
    root = freeze(path[0])
    del register
    # the root becomes state 0
    name = np.arange(1, len(final) + 1)
    name[root] = 0
    of = lambda x, kind: np.frombuffer(x, kind)
    keys = name[of(owner, np.int32)] << 8 | of(byte, np.uint8)
    order = np.argsort(keys)
    ends = np.zeros(len(final) + 1, np.uint8)
    ends[name] = of(final, np.uint8)
    arrays = {
        "keys": keys[order], "targets": name[of(target, np.int32)[order]], "skips": of(skip, np.int32)[order], "final": ends,
        "offsets": np.concatenate(([0], np.cumsum(ids.sizes))), "ids": ids.flat,
    }
    packed = [np.asarray(arrays[k], dtype=_TYPES[k]).tobytes() for k in _PARTS]
    head = np.array([len(p) for p in packed], np.int64).tobytes()
    return head + b"".join(p + b"\0" * (-len(p) % 8) for p in packed)


class Lexicon:
    """Reads a compiled block from a memory map; the file's name is removed at once, the map stays."""

    def __init__(self, block: bytes):
        handle, at = tempfile.mkstemp(prefix="lexicon-")
        with os.fdopen(handle, "wb") as f:
            f.write(block)
        data = np.memmap(at, np.uint8, "r")
        os.unlink(at)
        sizes, offset = data[: 8 * len(_PARTS)].view(np.int64).tolist(), 8 * len(_PARTS)
        for k, n in zip(_PARTS, sizes):
            setattr(self, k, np.asarray(data[offset : offset + n].view(_TYPES[k])))
            offset += n + -n % 8

    def ranks(self, words: Words) -> np.ndarray:
        """The rank of each word, -1 for one that is not in the lexicon. All words step together."""
        n, flat, first = words.sizes, words.flat, words.starts
        state, rank = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        if not len(self.keys):
            return np.full(len(n), -1)
        live, step = np.flatnonzero(n > 0), 0
        state[n == 0] = -1
        while len(live):
            key = state[live] << 8 | flat[first[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            state[live] = np.where(found, self.targets[at], -1)
            rank[live] += np.where(found, self.skips[at], 0)
            step += 1
            live = live[found & (n[live] > step)]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] > 0
        return np.where(ok, rank, -1)

    def outputs(self, ranks: np.ndarray) -> Words:
        return Words(self.ids, np.diff(self.offsets)).take(ranks)
