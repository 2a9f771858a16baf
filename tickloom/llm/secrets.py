"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Labelled samples come from the corpus itself: strings that the fixed patterns found are random strings, all
other runs of the alphabet are ordinary identifiers. First-order transition counts of both are summed over
all documents. A long run outside the fixed spans is a secret when the random model explains it better by
``LEAST_LLR`` per character; its own transitions are taken off the ordinary counts first. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.staging import staged
from tickloom.llm.words import slices

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: With the least length inside the pattern: the first match of a run is its longest.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
#: Runs that the models judge: of the alphabet without the sentence's full stop.
LEAST_RUN = 20
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
LEAST_LLR = 1.0

#: Bytes of text of which a worker has Python strings at a time; an Arrow batch may hold all rows of a task.
PART_BYTES = 2 << 20

N = len(ALPHABET)
_CODE = np.full(256, N, np.int64)
_CODE[list(ALPHABET.encode())] = np.arange(N)

SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_TOKEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string())]))
_COUNT = pa.list_(pa.struct([("random", pa.bool_()), ("pair", pa.int32()), ("n", pa.int64())]))
SCANNED = f"found {SPANS}, tokens array<struct<start:long,end:long,token:string>>, counts array<struct<random:boolean,pair:int,n:long>>"


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
    """(start, index of the kind, end) in order, and the strings that the spans hide; a string inside another, as a hex
    key of an assignment, is hidden once."""
    spans, hidden = [], []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
            hidden.append(m.span(2))
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        for m in pattern.finditer(text):
            spans.append((m.start(), kind, m.end()))
            hidden.append(m.span())
    strings, last = [], 0
    for s, e in sorted(hidden, key=lambda x: (x[0], -x[1])):
        if e > last:
            strings.append(text[max(s, last): e])
            last = e
    return sorted(spans), strings


def free_runs(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Long runs with a letter and a digit that touch no fixed span."""
    out = []
    for m in _RUN.finditer(text):
        t = m[0]
        if not t.isalpha() and any(c.isdigit() for c in t) and not (t.isdigit()) and not any(s < m.end() and m.start() < e for s, _, e in spans):
            out.append((m.start(), m.end(), t))
    return out


def transitions(data: np.ndarray, cuts: np.ndarray = ()) -> np.ndarray:
    """Counts of neighbours within runs of the alphabet, as (N * N) numbers; bytes before and after a cut, where the
    next text begins, are no neighbours."""
    c = _CODE[data]
    pair = c[:-1] * (N + 1) + c[1:]
    if len(cuts):
        pair = pair.copy()
        pair[cuts[(cuts > 0) & (cuts < len(c))] - 1] = (N + 1) ** 2 - 1
    return np.bincount(pair, minlength=(N + 1) ** 2).reshape(N + 1, N + 1)[:N, :N].ravel() if len(pair) else np.zeros(N * N, np.int64)


@dataclass(frozen=True)
class Model:
    """Transition counts of ordinary identifiers, and log probabilities under the random model. Transitions back
    off to how often the second character occurs at all, and that to uniform."""

    random: np.ndarray
    ordinary: np.ndarray
    alone: np.ndarray

    @classmethod
    def fit(cls, random: np.ndarray, ordinary: np.ndarray) -> Model:
        def smooth(counts):
            c = counts.reshape(N, N).astype(float)
            return c, (c.sum(0) + 0.5) / (c.sum() + 0.5 * N)

        c, alone = smooth(random)
        # Half of the random model is uniform: keys also come in alphabets that no fixed pattern has shown.
        p = 0.5 * (c + 2 * alone) / (c.sum(1, keepdims=True) + 2) + 0.5 / N
        return cls(np.log(p), *smooth(ordinary))

    def per_character(self, token: str) -> float:
        """Mean log-likelihood ratio; positive where a random string is likelier."""
        c = _CODE[np.frombuffer(token.encode(), np.uint8)]
        a, b = c[:-1], c[1:]
        own = transitions(np.frombuffer(token.encode(), np.uint8)).reshape(N, N)
        seen, row = np.maximum(self.ordinary[a, b] - own[a, b], 0), np.maximum(self.ordinary[a].sum(1) - own[a].sum(1), 0)
        return float((self.random[a, b] - np.log((seen + 2 * self.alone[b]) / (row + 2))).mean())

    def spans(self, runs: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
        return [(s, 3, e) for s, e, t in runs if self.per_character(t) >= LEAST_LLR]


def _parts(b: pa.RecordBatch) -> list[pa.RecordBatch]:
    """Consecutive rows of a batch, about ``PART_BYTES`` of text each, without copying."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0]
    while cuts[-1] < len(ends):
        i = cuts[-1]
        cuts.append(max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PART_BYTES, side="right"))))
    return [b.slice(i, j - i) for i, j in zip(cuts, cuts[1:])]


def _scan(batches):
    for whole in batches:
        parts = _parts(whole)
        random, every = np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)
        for at, b in enumerate(parts, 1):
            found, tokens = [], []
            for t in b.column("text").to_pylist():
                spans, hidden = base_spans(t or "")
                found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                tokens.append([{"start": s, "end": e, "token": x} for s, e, x in free_runs(t or "", spans)])
                if hidden:
                    random += transitions(np.frombuffer("\n".join(hidden).encode(), np.uint8))
            for _, part in slices(b.column("text")):
                every += transitions(part.data, part.offsets[1:-1])
            counts = None
            if at == len(parts):
                counts = [{"random": r, "pair": int(i), "n": int(c[i])} for r, c in ((True, random), (False, np.maximum(every - random, 0))) for i in np.flatnonzero(c)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, _SPAN), pa.array(tokens, _TOKEN), pa.array([counts] + [None] * (len(found) - 1), _COUNT)], names=["doc_id", "found", "tokens", "counts"])


def scan(docs: DataFrame) -> DataFrame:
    """Fixed spans and candidate runs per document, with the transition counts of a batch on one of its rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {SCANNED}"), "secrets")


def fit(scanned: DataFrame) -> Model:
    """The models from the counts of all documents: at most 2 * N * N rows reach the driver."""
    rows = scanned.select(F.explode("counts").alias("c")).groupBy("c.random", "c.pair").agg(F.sum("c.n").alias("n")).collect()
    counts = {True: np.zeros(N * N), False: np.zeros(N * N)}
    for r in rows:
        counts[r["random"]][r["pair"]] = r["n"]
    return Model.fit(counts[True], counts[False])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)``: all spans of each document by start, then kind. Null texts have none; repeated rows
    are scanned each; columns besides ``doc_id`` and ``text`` are ignored."""
    scanned = scan(docs)
    model = fit(scanned)

    def judge(batches):
        for b in batches:
            all_found = []
            for spans, tokens in zip(b.column("found").to_pylist(), b.column("tokens").to_pylist()):
                more = model.spans([(t["start"], t["end"], t["token"]) for t in tokens])
                all_found.append(sorted(spans + [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in more], key=lambda x: (x["start"], KINDS.index(x["kind"]))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(all_found, _SPAN)], names=["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scanned.select("doc_id", "found", "tokens").mapInArrow(judge, f"doc_id {kind}, found {SPANS}")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` (overlapping spans by one); nulls stay null. ``n_chars``,
    if there, follows the text. All other columns and all rows stay."""
    model = fit(scan(docs))

    def clean(batches):
        for b in (part for whole in batches for part in _parts(whole)):
            out = []
            for t in b.column("text").to_pylist():
                if t:
                    spans, _ = base_spans(t)
                    spans = sorted(spans + model.spans(free_runs(t, spans)))
                    parts, at = [], 0
                    for s, _, e in spans:
                        if s >= at:
                            parts += [t[at:s], mark]
                        at = max(at, e)
                    t = "".join(parts) + t[at:] if spans else t
                out.append(t)
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out
