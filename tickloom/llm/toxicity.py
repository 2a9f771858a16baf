"""Toxicity: a logistic classifier on word presence, regularised by counterfactual identity terms.

Features are the distinct words of a text and their first four and five bytes (insults come in families).
For every labelled text that names a group, a twin is made with the group swapped for another; training
penalises the squared difference of the two log-odds, so that a group's name itself moves no score.
Groups are named by a list of pairs; where no labelled text has a term of the list, the terms are drawn from the
labelled texts: frequent words that toxic texts have as often as others, each paired with the next in frequency.
The classifier is fitted on a bounded sample of labelled rows and scores every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.staging import staged
from tickloom.llm.words import Texts, mix, prefix_hashes, slices, span_hashes

#: Labelled rows that training takes at most (by hash of the id). They bound the features, too: those in at least
#: LEAST_DOCS of them whose share of toxic ones stands LEAST_Z standard deviations off the share of all.
SAMPLE = 20_000
LEAST_DOCS, LEAST_Z = 4, 2.0
#: A drawn identity term stands in at least this share of the labelled texts; its share of toxic ones lies within so many
#: standard deviations of the share of all; its partner is at most so much more frequent.
TERM_SHARE, TERM_Z, TERM_RATIO = 0.01, 1.0, 1.25
THRESHOLD = 0.7
L2, COUNTERFACTUAL = 2e-5, 1.0

#: Pairs of identity terms that stand in for each other, both ways.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslim", "christian"), ("muslims", "christians"), ("jewish", "buddhist"), ("jews", "hindus"),
    ("black", "white"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("immigrants", "natives"), ("immigrant", "native"),
    ("african", "european"), ("asian", "american"), ("disabled", "able-bodied"), ("elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen"), ("juden", "buddhisten"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens"), ("juifs", "bouddhistes"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos"), ("judíos", "budistas"), ("extranjeros", "españoles"),
)

# Bytes that end a word: all ASCII but letters and digits; and lower case for ASCII.
_BREAK = np.zeros(256, bool)
_BREAK[:128] = [not chr(i).isalnum() for i in range(128)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"): ord("Z") + 1] += 32
_FOLD[:128][_BREAK[:128]] = 0x20
_PREFIXES = (4, 5)
_WORD, _JOINED = re.compile(r"\w+"), re.compile(r"\w+(?:-\w+)*")


def folded(part: Texts) -> Texts:
    """ASCII and Latin-1 letters in lower case, everything but letters and digits as spaces."""
    data = _FOLD[part.data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][upper] += 0x20
    return Texts(data, part.offsets)


def features(part: Texts):
    """(feature hash, text) of every word and its prefixes; not distinct."""
    low = folded(part)
    starts, ends, at = low.words()
    run = prefix_hashes(low.data)
    text = np.searchsorted(at, np.arange(len(starts)), side="right") - 1
    out = [(span_hashes(run, starts, ends), text)]
    for n in _PREFIXES:
        long = ends - starts > n
        out.append((mix(span_hashes(run, starts[long], starts[long] + n) + np.uint64(n)), text[long]))
    return (np.concatenate(x) for x in zip(*out))


def small(batches, rows: int = 512):
    """Batches cut to so many rows, as feature sets are larger than their texts."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _swapper(pairs):
    """Every term swapped for its partner; words joined by hyphens are one term if listed, else each for itself."""
    other = {a: b for p in pairs for a, b in (p, p[::-1])}

    def swapped(m):
        found = other.get(m[0].lower())
        return found or (_WORD.sub(lambda w: other.get(w[0].lower(), w[0]), m[0]) if "-" in m[0] else m[0])

    return (lambda t: _JOINED.sub(swapped, t)) if other else (lambda t: t)


def _feature_rows(identity):
    swap = _swapper(identity)

    def sets(texts: pa.Array):
        for _, part in slices(texts):
            h, text = features(part)
            o = np.lexsort((h, text))
            h, text = h[o], text[o]
            keep = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
            h, text = h[keep], text[keep]
            for i, j in zip(*(np.searchsorted(text, np.arange(len(part.offsets) - 1), side=s) for s in ("left", "right"))):
                yield h[i:j].tobytes()

    def rows(batches):
        for b in small(batches):
            texts = b.column("text").to_pylist()
            twins = [swap(t or "") for t in texts]
            changed = [i for i, (t, u) in enumerate(zip(texts, twins)) if t and t != u]
            other = dict(zip(changed, sets(pa.array([twins[i] for i in changed], pa.string()))))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(list(sets(b.column("text"))), pa.binary()), pa.array([other.get(i) for i in range(len(texts))], pa.binary())], names=["toxic", "own", "twin"])

    return rows


@dataclass(frozen=True)
class Classifier:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    twins: int = 0  # labelled texts that had a twin

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, part in slices(texts):
            n = len(part.offsets) - 1
            z = np.full(n, self.bias)
            if len(self.hashes):
                h, text = features(part)
                i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[i] == h
                pair = np.unique(text[hit] * len(self.hashes) + i[hit])
                z += np.bincount(pair // len(self.hashes), self.weights[pair % len(self.hashes)], minlength=n)
            out[at: at + n] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit(labels: np.ndarray, own: list[np.ndarray], lost: list[np.ndarray | None], gained: list[np.ndarray | None], vocabulary: np.ndarray, counterfactual: float = COUNTERFACTUAL, l2: float = L2, steps: int = 300) -> Classifier:
    """Adam on the mean log loss + l2 |w|^2 + counterfactual * mean squared log-odds gap between twins. ``own`` holds
    places in the sorted ``vocabulary``; ``lost`` and ``gained`` are the places in which a text's twin differs (null: no
    twin), as only those make the gap. Both classes weigh the same in the loss, so the threshold does not depend on
    how rare toxic texts are."""
    y, m = np.asarray(labels, float), len(vocabulary)
    if not len(y):
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), -30.0)

    def rows(sets):
        return np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets]), np.concatenate([np.zeros(0, np.int32), *sets]).astype(np.int32)

    d, f = rows(own)
    paired = [k for k, t in enumerate(gained) if t is not None]
    (d1, f1), (d2, f2) = rows([lost[k] for k in paired]), rows([gained[k] for k in paired])
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    each = np.where(y == 1, 0.5 / p, 0.5 / (1 - p)) / len(y)
    w, b = np.zeros(m), 0.0 if 0 < y.mean() < 1 else float(np.log(p / (1 - p)))
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        e = (1 / (1 + np.exp(-np.clip(b + np.bincount(d, w[f], minlength=len(y)), -30, 30))) - y) * each
        g = np.append(np.bincount(f, e[d], minlength=m) + 2 * l2 * w, e.sum())
        if paired:
            gap = np.bincount(d1, w[f1], minlength=len(paired)) - np.bincount(d2, w[f2], minlength=len(paired))
            g[:-1] += 2 * counterfactual * (np.bincount(f1, gap[d1], minlength=m) - np.bincount(f2, gap[d2], minlength=m)) / len(paired)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Classifier(vocabulary, w, float(b), len(paired))


def _tally(batches):
    """Documents and toxic documents of each feature in a batch."""
    for b in small(batches):
        sets = [np.frombuffer(x, np.int64) for x in b.column("own").to_pylist()]
        y = b.column("toxic").to_numpy(zero_copy_only=False)
        h, which, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
        toxic = np.bincount(which, np.repeat(y, [len(x) for x in sets]), minlength=len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), pa.array(toxic)], names=["h", "n", "toxic"])


def _vocabulary(rows: DataFrame, share: float) -> np.ndarray:
    """The features whose share of toxic documents stands off the overall share: as many as the sample has."""
    seen = rows.select("toxic", "own").mapInArrow(_tally, "h long, n long, toxic long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    z = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    best = seen.where((F.col("n") >= LEAST_DOCS) & (z > LEAST_Z)).select("h").toArrow()
    return np.sort(best.column("h").to_numpy().view(np.uint64))


def drawn_terms(texts: DataFrame, n: int, share: float) -> list[tuple[str, str]]:
    """Pairs of neutral words from ``(text, toxic)``. Only words of a hundredth of the texts or more reach the driver."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0)))
    seen = texts.select(F.explode(words).alias("word"), "toxic").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    z = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    rows = seen.where((F.col("n") >= max(TERM_SHARE * n, LEAST_DOCS)) & (z < TERM_Z)).orderBy("n", "word").collect()
    pairs, i = [], 0
    while i + 1 < len(rows):
        if rows[i + 1].n <= TERM_RATIO * rows[i].n:
            pairs.append((rows[i].word, rows[i + 1].word))
            i += 1
        i += 1
    return pairs


def _pick(vocabulary: np.ndarray):
    """Feature sets as places in the vocabulary, and how a twin's differ; what is not in it is dropped."""
    def places(x):
        h = np.frombuffer(x, np.uint64)
        if not len(vocabulary):
            return np.zeros(0, "<i4")
        i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        return i[vocabulary[i] == h].astype("<i4")

    def run(batches):
        for b in small(batches):
            own, lost, gained = [], [], []
            for x, t in zip(b.column("own").to_pylist(), b.column("twin").to_pylist()):
                x = places(x)
                own.append(x.tobytes())
                t = None if t is None else places(t)
                lost.append(None if t is None else np.setdiff1d(x, t).tobytes())
                gained.append(None if t is None else np.setdiff1d(t, x).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(c, pa.binary()) for c in (own, lost, gained))], names=["toxic", "own", "lost", "gained"])

    return run


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, identity=IDENTITY, sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL) -> Classifier:
    """A document is toxic if any of its labels is 1; null ids and labels are ignored. Of more than ``sample``
    labelled documents those with the smallest hashes are taken; their ids are what is broadcast; of rows that repeat
    an id the smallest text counts. Features are counted and chosen by Spark; the driver gets at most ``sample`` rows of
    their places in the vocabulary. ``identity``: pairs of terms; drawn from the texts where none occurs in them."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max(F.expr("CAST(toxic = 1 AS INT)")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    texts = staged(texts.select("text", "toxic"), "toxic-texts")
    listed = F.rlike(F.lower("text"), F.lit(r"\b(" + "|".join(sorted({re.escape(t) for p in identity for t in p}, key=len, reverse=True)) + r")\b")) if identity else F.lit(False)
    size = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.coalesce(F.max(listed), F.lit(False)).alias("listed")).first()
    share = min(max((size.toxic or 0) / max(size.n, 1), 1e-3), 1 - 1e-3)
    terms = identity if size.listed else drawn_terms(texts, size.n, share)
    rows = staged(texts.mapInArrow(_feature_rows(terms), "toxic int, own binary, twin binary"), "toxic-sample")
    vocabulary = _vocabulary(rows, share)
    picked = rows.mapInArrow(_pick(vocabulary), "toxic int, own binary, lost binary, gained binary").toArrow()
    sets = [[None if not x.is_valid else np.frombuffer(x.as_buffer(), "<i4") for x in picked.column(c)] for c in ("own", "lost", "gained")]
    return fit(picked.column("toxic").to_numpy(), *sets, vocabulary, counterfactual)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` columns as they are, plus ``score`` and ``predicted``. A null text scores as an empty one; without
    any labelled row every score is about 0. Columns named like the results are replaced."""
    model = train(docs, labels, **options)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*keep)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column("text")))], names=[*b.schema.names, "score"])

    schema = docs.limit(0).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
