"""Toxicity by a support vector machine over a gappy subsequence kernel.

Kernel: the weight of a subsequence of ``ORDER`` characters is LAMBDA to the length
that it spans (Lodhi and others, 2002), over pieces of at most ``PIECE`` characters
of a word with its ends marked; normalised. Inserted or dropped characters thus only
lower the value. Letters set apart ("i d i o t") are also read as one word,
and so are word parts that one or two symbols split ("stu*pid"), with the symbols as characters.
Landmarks: the ``LANDMARKS`` pieces whose share of documents differs most between the
labels, without near copies of each other. A document is the set of its pieces:
against each landmark, its largest kernel value over ``TAU`` and the sum of such
values. Nystroem: these are multiplied by the inverse square root of the landmarks'
kernel matrix. A linear SVM (dual coordinate descent) with Platt's sigmoid gives the
score.

Fitting uses at most ``SAMPLE`` labelled documents of each label (least hashes), that
is a bounded sample; piece counts and features of these are made on the executors.
Scores read only the text.

Cases: null text counts as empty and gets a score too; labels that are null are left
out, several labels of one document count as toxic if any is; with no labels of one
kind every score is 0 (or 1 if all are toxic); texts of any length are read whole; rows
with a null doc_id are scored, never learnt from, and not held out (null); rows that share
an id are scored each by its own text, the least of them is learnt from; equal rows give
equal rows; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, filter_rows, map_batches, table

ORDER, LAMBDA, PIECE, STRIDE = 3, 0.7, 10, 5
LANDMARKS, TAU, ALIKE = 64, 0.5, 0.9
SAMPLE = 3000
POOL = 2000
#: Strings compared at once, words remembered and text handled at once in a worker.
CHUNK, REMEMBERED, SLICE = 2048, 1 << 18, 1 << 20
_WORD = re.compile(r"[^\W_]+")
_SPELT = re.compile(r"(?<![^\W_])[^\W\d_](?:[\W_]{1,2}[^\W_](?![^\W_])){3,}")
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[^\w\s.,;:!?]{1,2}[^\W\d_]++)+")
#: Found wherever _MASKED is; few texts hold one.
_MASK = re.compile(r"[^\w\s.,;:!?](?<=[^\W\d_].)[^\w\s.,;:!?]?[^\W\d_]")
_NOT_WORD = re.compile(r"[\W_]+")
#: Symbols of the kernel: word ends, letters, digits as one, and a few buckets for the rest.
_ALPHABET = 40
_CODES = np.zeros(65536, np.int64)
_CODES[ord("^")], _CODES[ord("$")] = 1, 2
for _c in range(26):
    _CODES[97 + _c] = 3 + _c
_CODES[48:58] = 29
_REST = np.arange(65536)
_REST = 30 + (_REST * 40503 >> 4) % 10
_CODES = np.where(_CODES == 0, _REST, _CODES)
_TRIPLES = np.array(list(combinations(range(PIECE), ORDER)))
_SPANS = (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1).astype(np.int32)
#: Weight of a subsequence by the length that it spans; 0 stands for one that runs beyond the string.
_WEIGHT_OF = np.array([0.0, *(LAMBDA**k for k in range(1, 16))])


def words(text: str) -> list[str]:
    low = text.lower()
    found = _WORD.findall(low)
    found += [_NOT_WORD.sub("", m) for m in _SPELT.findall(low)]
    return found + _MASKED.findall(low) if _MASK.search(low) else found


def pieces(word: str) -> list[str]:
    marked = f"^{word}$"
    if len(marked) <= PIECE:
        return [marked]
    return [marked[i : i + PIECE] for i in range(0, len(marked) - PIECE + STRIDE, STRIDE)]


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight) of each string, normalised to length 1; equal features of a string are summed in one place."""
    raw = "".join(s.ljust(PIECE, "\0")[:PIECE] for s in strings).encode("utf-16-le", "replace")
    chars = np.frombuffer(raw, np.uint16)
    if len(chars) != len(strings) * PIECE:  # characters outside the base plane
        chars = np.array([[min(ord(c), 65535) for c in s.ljust(PIECE, "\0")[:PIECE]] for s in strings], np.uint16).ravel()
    chars = chars.reshape(-1, PIECE)
    codes = _CODES[chars].astype(np.int32)
    a, b, c = (codes[:, _TRIPLES[:, k]] for k in range(3))
    # feature and span in one number, so that sorting moves both
    key = ((a * _ALPHABET + b) * _ALPHABET + c) << 4
    key |= np.where(chars[:, _TRIPLES[:, 2]] != 0, _SPANS, 0)
    key.sort(axis=1)
    feature, weight = key >> 4, _WEIGHT_OF[key & 15]
    n, t = feature.shape
    flat = np.ones((n, t), bool)
    flat[:, 1:] = feature[:, 1:] != feature[:, :-1]
    at = np.flatnonzero(flat.ravel())
    summed = np.zeros(n * t)
    if len(at):
        summed[at] = np.add.reduceat(weight.ravel(), at)
    summed = summed.reshape(n, t)
    norm = np.sqrt((summed**2).sum(axis=1, keepdims=True))
    return feature, summed / np.where(norm == 0, 1, norm)


class Kernel:
    """Kernel values of strings against fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        feature, weight = subsequences(landmarks)
        self.table = np.zeros((_ALPHABET**ORDER, len(landmarks)), np.float32)
        for j in range(len(landmarks)):
            np.add.at(self.table[:, j], feature[j], weight[j])
        self.live = self.table.any(axis=1)

    def __call__(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        for at in range(0, len(strings), CHUNK):
            feature, weight = subsequences(strings[at : at + CHUNK])
            live = self.live[feature] & (weight > 0)
            # a string's share of the landmarks' features bounds its value: skip what can't reach TAU
            fine = np.flatnonzero(np.einsum("ij,ij,ij->i", weight, weight, live) >= TAU**2)
            feature, weight, live = feature[fine], weight[fine].astype(np.float32), live[fine]
            own = np.zeros((len(fine), len(self.landmarks)), np.float32)
            for k in range(feature.shape[1]):
                row = np.flatnonzero(live[:, k])
                if len(row):
                    own[row] += self.table[feature[row, k]] * weight[row, k, None]
            out[at + fine] = own
        return out


class Features:
    """Pooled kernel features of documents; remembers words."""

    def __init__(self, landmarks: list[str]):
        self.kernel, self.rows = Kernel(landmarks), None
        self.forget()

    def forget(self):
        self.row: dict[str, int] = {}
        self.vectors, self.used = np.zeros((1024, len(self.kernel.landmarks)), np.float32), 1  # row 0: nothing over TAU

    def learn(self, new: list[str]) -> None:
        parts = [pieces(w) for w in new]
        owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
        flat = [x for p in parts for x in p]
        values = np.maximum(self.kernel(flat) - TAU, 0)
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        best = np.maximum.reduceat(values, start, axis=0)
        some = best.any(axis=1)
        while self.used + int(some.sum()) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        at = np.zeros(len(new), np.int64)
        at[some] = self.used + np.arange(int(some.sum()))
        self.vectors[at[some]] = best[some]
        self.used += int(some.sum())
        self.row.update(zip(new, at.tolist()))

    def __call__(self, texts: list[str]) -> np.ndarray:
        m, out, at = len(self.kernel.landmarks), [], 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= SLICE):
                group.append(words(texts[at]))
                size += len(texts[at])
                at += 1
            if len(self.row) > REMEMBERED:
                self.forget()
            new = list({w for own in group for w in own if w not in self.row})
            if new:
                self.learn(new)
            for own in group:
                hits = [r for r in map(self.row.__getitem__, own) if r]
                pooled = np.zeros(3 * m)
                if hits:
                    v = self.vectors[hits]
                    total = v.sum(axis=0, dtype=np.float64)
                    pooled[:m], pooled[m : 2 * m], pooled[2 * m :] = v.max(axis=0) / (1 - TAU), np.log1p(total), 10 * total / (len(own) + 20)
                out.append(pooled)
        return np.array(out).reshape(len(texts), 3 * m)


def nystroem(landmarks: list[str]) -> np.ndarray:
    """Inverse square root of the landmarks' kernel matrix, with a ridge."""
    k = Kernel(landmarks)
    feature, weight = subsequences(landmarks)
    full = np.array([(k.table[feature[i]] * weight[i][:, None]).sum(axis=0) for i in range(len(landmarks))], np.float64)
    values, vectors = np.linalg.eigh((full + full.T) / 2 + 0.1 * np.eye(len(landmarks)))
    return vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent (Hsieh and others, 2008); y in {-1, 1}."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = 1 / (2 * cost)
    q = (x**2).sum(axis=1) + diagonal
    order, random = np.arange(len(x)), np.random.default_rng(0)
    for _ in range(rounds):
        random.shuffle(order)
        worst = 0.0
        for i in order.tolist():
            g = y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            step = max(alpha[i] - g / q[i], 0) - alpha[i]
            worst = max(worst, abs(g))
            alpha[i] += step
            w += (step * y[i]) * x[i]
        if worst < 1e-3:
            break
    return w


def platt(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a f + b))) by damped Newton steps."""
    up, down = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    design = np.stack([f, np.ones_like(f)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        gradient = design.T @ (weight * (p - target)) + [1e-3 * (a - 1), 0]
        hessian = design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(hessian, gradient)
        scale = min(1.0, 5 / (abs(da) + abs(db) + 1e-9))
        a, b = a - scale * da, b - scale * db
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b


class Model:
    def __init__(self, landmarks, transform, weights, a, b, constant=None):
        self.landmarks, self.transform, self.weights, self.a, self.b, self.constant = landmarks, transform, weights, a, b, constant

    def map(self, pooled: np.ndarray) -> np.ndarray:
        m = len(self.landmarks)
        return np.concatenate([*(pooled[:, k * m : (k + 1) * m] @ self.transform for k in range(3)), np.ones((len(pooled), 1))], axis=1)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.a * (self.map(pooled) @ self.weights) + self.b, -30, 30)))


def held_out(id_col="doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def training_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic): at most ``size`` rows of each label, the least hashes; no held-out rows."""
    rows = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).filter(~held_out())
    picked = [rows.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    return picked[0].union(picked[1])


def _training_pieces(batch):
    ids, strings, toxic = [], [], []
    for t, y in zip(as_text(batch.column(1)), batch.column(2).to_pylist()):
        own = {p for w in set(words(t)) for p in pieces(w)}
        own |= {p[:k] for p in own if p[0] == "^" for k in range(6, min(9, len(p)))}
        strings += own
        toxic += [y] * len(own)
    return pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(toxic, pa.int32())], names=["piece", "toxic"])


def choose_landmarks(ranked: list[str], count: int = LANDMARKS) -> list[str]:
    """The best ranked strings, each less than ALIKE to those before it."""
    chosen: list[str] = []
    features = dict(zip(ranked, zip(*subsequences(ranked)))) if ranked else {}
    vectors = []
    for s in ranked:
        f, w = features[s]
        v = {}
        for x, y in zip(f.tolist(), w.tolist()):
            if y:
                v[x] = v.get(x, 0) + y
        if all(sum(y * o.get(x, 0) for x, y in v.items()) < ALIKE for o in vectors):
            chosen.append(s)
            vectors.append(v)
            if len(chosen) == count:
                break
    return chosen


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Learns from at most ``size`` labelled documents of each label."""
    sample = training_sample(labels, size)
    totals = {bool(r["toxic"]): r["n"] for r in labels.filter("toxic is not null").filter(~held_out()).groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    # at most 2 * size ids, one row each: a proven bound
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    counts = map_batches(rows, ["doc_id", "text", "toxic"], _training_pieces, "piece string, toxic int").groupBy("piece").agg(F.sum(F.col("toxic")).alias("up"), F.sum(1 - F.col("toxic")).alias("down"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    up, down = n.get(1, 0), n.get(0, 0)
    if not up or not down:
        return Model([], None, None, 0, 0, constant=float(bool(up)))
    share = (F.col("up") + F.col("down")) / float(up + down)
    z = F.abs(F.col("up") / float(up) - F.col("down") / float(down)) / F.sqrt(share * (1 - share) * (1 / up + 1 / down) + 1e-9)
    ranked = [r["piece"] for r in counts.filter("up + down >= 3").select("piece", F.round(z, 6).alias("z")).orderBy(F.desc("z"), "piece").limit(POOL).collect()]
    landmarks = choose_landmarks(ranked) or ["^a$"]
    pooled = rows.select("doc_id", "text", "toxic")
    state: dict = {}

    def run(batch):
        f = state.setdefault("f", Features(landmarks))
        x = f(as_text(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = sorted((r["doc_id"], r["toxic"], r["x"]) for r in map_batches(pooled, ["doc_id", "text", "toxic"], run, "doc_id long, toxic int, x array<double>").collect())
    y = np.array([2.0 * t - 1 for _, t, _ in got])
    model = Model(landmarks, nystroem(landmarks), None, 1.0, 0.0)
    x = model.map(np.array([v for _, _, v in got]))
    model.weights = svm(x, y, np.where(y > 0, 0.5 * len(y) / up, 0.5 * len(y) / down))
    # the sigmoid answers for the labels' own shares, not the sample's
    whole = {k: max(totals.get(k, 0), 1) for k in (True, False)}
    weight = np.where(y > 0, whole[True] / up, whole[False] / down)
    model.a, model.b = platt(x @ model.weights, y, weight * len(y) / weight.sum())
    return model


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score): whole texts."""
    state: dict = {}

    def run(batch):
        if model.constant is not None:
            scores = np.full(batch.num_rows, model.constant)
        else:
            scores = model.score(state.setdefault("f", Features(model.landmarks))(as_text(batch.column(1))))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rows predicted toxic; columns as they were. Rows are judged one by one, so ids may be null or shared."""
    model = fit(docs, labels)
    state: dict = {}

    def clean(texts):
        if model.constant is not None:
            return [model.constant < 0.5] * len(texts)
        return (model.score(state.setdefault("f", Features(model.landmarks))(texts)) < 0.5).tolist()

    return filter_rows(docs, clean)
