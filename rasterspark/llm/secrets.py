"""Secret scans: fixed rules, and automata learnt from the credentials they label.

Two passes over whole texts. The first finds what the fixed rules label. Of each kind at
most ``SAMPLE`` distinct credentials (the least hashes of all documents) are learnt, by
the shapes of their characters, as one probabilistic automaton; runs of credential
characters with letters but no digits, and those with digits but no letters, at most
``SAMPLE`` each, as background automata. The second pass scores every candidate, that is
every run of credential characters that no base span touches, however long or mixed. One
is a span of kind ``like_<kind>`` if it is no shorter than the shortest credential learnt
of the kind, as likely as 95 % of these under the kind's automaton, and likelier than under
its background (of letters, if it has any) by ``MARGIN`` a symbol; of several such kinds
the likeliest counts. Nothing but hashes and shapes of credentials is written on the way.

Cases: null text counts as empty and has no spans; texts of any length are read whole; a
null doc_id stays null, and rows that share an id are rows of their own; equal rows give
equal rows; an empty table gives an empty result; without enough labelled credentials
(``LEAST``) of a kind no automaton is learnt and nothing is added; further columns are
ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata
from .common import as_text, cut, let_go, map_batches, table

KINDS = ("assign", "access", "hex")
SAMPLE, LEAST, MARGIN = 400, 8, 0.25
BACKGROUNDS = ("letters", "digits")
#: Shapes whose verdict a worker remembers.
REMEMBERED = 1 << 18
#: Base rules. Fixed patterns; keywords in either case, ASCII letters only.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORD = re.compile(r"(?ai:passw(?:or)?d|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is a greedy match that is long enough
#: A credential that the rules label has six characters or more.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) by start, then kind as listed; code points, end exclusive."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b, v) for a, k, b, v in sorted(found)]


def untouched(spans: list[tuple[int, int]], base: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
    """Those of ``spans``, in order, that no base span touches."""
    out, i, reach = [], 0, 0
    taken = sorted((a, b) for _, a, b, _ in base)
    for a, b in spans:
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            out.append((a, b))
    return out


def _background(value: str) -> str | None:
    """The background that a run is an example of: all but mixed ones and mere symbols."""
    digit, letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    return None if digit == letter else "digits" if digit else "letters"


class _Least:
    """At most ``size`` distinct (hash, shape), those of the least hashes."""

    def __init__(self, size: int):
        self.size, self.kept, self.most = size, {}, 1 << 63

    def add(self, value: str) -> None:
        h = xxhash.xxh64_intdigest(value) >> 1
        if h < self.most:
            self.kept[h] = automata.shape(value)
            if len(self.kept) > 2 * self.size:
                self.cut()

    def cut(self) -> None:
        rows = sorted(self.kept.items())[: self.size]
        self.kept, self.most = dict(rows), rows[-1][0] + 1 if len(rows) == self.size else 1 << 63


def examples(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(kind, h, shape): of each kind and background the least hashes of each task."""

    def run(batches):
        let_go()
        least, seen = {k: _Least(sample) for k in (*KINDS, *BACKGROUNDS)}, set()
        for batch in batches:
            for text in as_text(batch.column(0)):
                base = base_spans(text)
                for kind, _, _, value in base:
                    least[kind].add(value)
                new = set(_CANDIDATE.findall(text)) - seen if not base else {text[a:b] for a, b in untouched([m.span() for m in _CANDIDATE.finditer(text)], base)} - seen
                for value in new:
                    kind = _background(value)
                    if kind:
                        least[kind].add(value)
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen |= new
        rows = []
        for kind, own in least.items():
            own.cut() if own.kept else None
            rows += [(kind, h, x) for h, x in own.kept.items()]
        if rows:
            kinds, hashes, shapes = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(hashes, pa.int64()), pa.array(shapes)], names=["kind", "h", "shape"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, h long, shape string")


def learn_formats(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> dict:
    """kind -> (states, least mean log likelihood, least length); backgrounds too. At most ``sample`` rows a kind reach the driver."""
    pool, models = cut(examples(docs, text_col, sample).distinct()), {}
    for kind in (*KINDS, *BACKGROUNDS):
        shapes = [r["shape"] for r in pool.filter(F.col("kind") == kind).orderBy("h", "shape").limit(sample).collect()]
        if len(shapes) >= LEAST:
            states = automata.learn(shapes)
            scores = sorted(automata.likelihood(states, s) for s in shapes)
            models[kind] = (states, scores[len(scores) // 20], min(map(len, shapes)))
    return models


def judge(shape: str, models: dict) -> tuple[str, float] | None:
    """The kind that a candidate of a shape is like, with its likelihood, or None."""
    letters = any(c in shape for c in "hHlU")
    if not letters and "d" not in shape:
        return None
    background = models.get("letters" if letters else "digits")
    floor = (automata.likelihood(background[0], shape) if background else automata.FLOOR) + MARGIN
    fits = []
    for kind in KINDS:
        if kind in models and len(shape) >= models[kind][2]:
            score = automata.likelihood(models[kind][0], shape)
            if score >= max(models[kind][1], floor):
                fits.append((score, kind))
    return max(fits)[::-1] if fits else None


class Scanner:
    """Base and added spans of texts; remembers verdicts on shapes."""

    def __init__(self, models: dict):
        self.models, self.verdicts, self.clean = models, {}, set()
        self.any = any(k in models for k in KINDS)

    def verdict(self, value: str):
        s = automata.shape(value)
        if s not in self.verdicts:
            if len(self.verdicts) > REMEMBERED:
                self.verdicts.clear()
            self.verdicts[s] = judge(s, self.models)
        return self.verdicts[s]

    def __call__(self, text: str):
        """(base spans, added spans), each (kind, start, end)."""
        base, added = base_spans(text), []
        if self.any:
            values = set(_CANDIDATE.findall(text)) - self.clean
            flagged = {v for v in values if self.verdict(v)}
            if len(self.clean) > REMEMBERED:
                self.clean = set()
            self.clean |= values - flagged
            if flagged:
                found = [m.span() for m in _CANDIDATE.finditer(text) if m[0] in flagged]
                added = [(f"like_{self.verdict(text[a:b])[0]}", a, b) for a, b in untouched(found, base)]
        return [s[:3] for s in base], added


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, base, added): base spans, and spans that the automata add (kind ``like_<kind>``)."""
    models = learn_formats(docs, text_col)
    state: dict = {}

    def run(batch):
        scan = state.setdefault("scan", Scanner(models))
        rows = [scan(t) for t in as_text(batch.column(1))]
        spans = lambda k: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in r[k]] for r in rows], _SPAN_TYPE)
        return pa.RecordBatch.from_arrays([batch.column(0), spans(0), spans(1)], names=["doc_id", "base", "added"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], run, f"doc_id long, base {_SPANS}, added {_SPANS}")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    # by start, then kind as listed; added kinds come after base kinds of the same start
    order = lambda s: F.struct(s["start"].alias("at"), F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int"), F.lit(0)).alias("k"), s.alias("s"))
    placed = F.transform(F.sort_array(F.transform(F.concat("base", "added"), order)), lambda x: x["s"])
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(placed).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            out += [text[at : max(a, at)], "<SECRET>" if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each base and added span of ``text`` replaced by ``<SECRET>``; rows and columns as they were.

    A document whose text has no span keeps it as it is, null included.
    """
    models, schema, names = learn_formats(docs), docs.schema, docs.columns
    at = names.index("text")

    def run(batches):
        scan = Scanner(models)
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                spans = [(a, b) for own in scan(t) for _, a, b in own] if t else []
                out.append(redact(t, spans) if spans else t)
            columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
