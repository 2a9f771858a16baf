"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the whole text (lower case, everything but letters as spaces) are hashed
to ``BUCKETS``. Document frequencies cover all training documents; the weights are trained on a bounded sample
of them by follow-the-regularised-leader with an elastic-net penalty, which leaves most of them at zero, and a
temperature fitted on held-back rows of the sample turns the scores into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.staging import staged

UNKNOWN = "und"
BITS, BUCKETS = 15, 1 << 15
#: Training documents at most, dealt evenly over the languages by hash of the id; of each language one at least.
SAMPLE = 4_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.3, 0.01
CALIBRATE = 5  # every fifth row of the sample sets the temperature

_LETTER = regex.compile(r"\p{L}")
_A, _B, _C = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_SHIFT = np.uint32(32 - BITS)
_ASCII = np.full(128, 32, np.uint32)
_ASCII[ord("a"): ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def counts(text: str) -> np.ndarray:
    """Occurrences of each n-gram bucket."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    keep = (c[1:] != 32) | (c[:-1] != 32)  # runs of spaces count once
    c = np.append(c[:1], c[1:][keep])
    one, two = c * _A, c[:-1] * _B + c[1:] * _A
    three = c[:-2] * _C + two[1:] + c[1:-1] * _B
    return np.bincount(np.concatenate((one >> _SHIFT, two >> _SHIFT, three >> _SHIFT)), minlength=BUCKETS)


def tf(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = counts(text)
    i = np.flatnonzero(n)
    return i, np.log1p(n[i])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS, languages), mostly zero
    temperature: float

    def features(self, i: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = x * self.idf[i]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, i: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.features(i, x) @ self.weights[i]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        z = self.logits(*tf(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> np.ndarray:
    """Weights after EPOCHS passes over (buckets, features, class) rows."""
    z, n = np.zeros((BUCKETS, languages)), np.zeros((BUCKETS, languages))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, x, k in rows:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[k] -= 1
            g = x[:, None] * p
            grown = ni + g * g
            z[i] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[i] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The T of [0.05, 20] that minimises the log loss of softmax(logits / T), by golden section on log T."""
    if not len(classes):
        return 1.0

    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), classes]).mean())

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def _statistics(limits: dict[str, int]):
    """Rows (bucket, n) of document frequencies per task, and the features of sampled documents."""
    def run(batches):
        df = np.zeros(BUCKETS, np.int64)
        for b in batches:
            out = []
            for t, lang, h in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "h"))):
                if t and _LETTER.search(t):
                    i, x = tf(t)
                    df[i] += 1
                    if h < limits.get(lang, 0):
                        out.append((lang, h, i.astype("<u2").tobytes(), x.astype("<f4").tobytes()))
            if out:
                lang, h, i, x = zip(*out)
                none = pa.nulls(len(out), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(lang), pa.array(h, pa.int64()), pa.array(i, pa.binary()), pa.array(x, pa.binary())], names=["bucket", "n", "lang", "h", "i", "x"])
        seen = np.flatnonzero(df)
        if len(seen):
            k = len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen]), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=["bucket", "n", "lang", "h", "i", "x"])

    return run


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from ``text`` and ``lang`` of rows that are not held out. Of each language the rows with the smallest
    hashes are sampled, its first one with a letter always. All languages are learned. BUCKETS rows of document
    frequencies, two numbers per language and the sample reach the driver; the weights take BUCKETS doubles for each."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select("text", F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("h"))).alias("first")).collect()
    sizes = {r.lang: r.n for r in found}
    if not sizes:
        return Model((), np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    each = max(sample // len(sizes), 1)
    limits = {r.lang: max(min(1 << 30, int((1 << 30) * each / r.n) + 1), (r.first or 0) + 1) for r in found}
    rows = staged(known.mapInArrow(_statistics(limits), "bucket long, n long, lang string, h long, i binary, x binary"), "ngrams")
    df, documents = np.zeros(BUCKETS), sum(sizes.values())
    for r in rows.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket] = r.n
    idf = np.log((1 + documents) / (1 + df)) + 1
    taken = rows.where("lang IS NOT NULL").select("lang", "h", "i", "x").orderBy("h", "lang", "i").limit(2 * max(sample, len(sizes))).collect()
    languages = tuple(sorted({r.lang for r in taken}))
    draft = Model(languages, idf, np.zeros((BUCKETS, len(languages))), 1.0)
    data = []
    for r in taken:
        i = np.frombuffer(r.i, "<u2").astype(np.int64)
        data.append((i, draft.features(i, np.frombuffer(r.x, "<f4").astype(float)), languages.index(r.lang)))
    first = {d[2]: k for k, d in reversed(list(enumerate(data)))}  # a language's first row is always learned from
    aside = {k for k, d in enumerate(data) if k % CALIBRATE == 0 and first[d[2]] != k}
    weights = ftrl([d for k, d in enumerate(data) if k not in aside], len(languages))
    checked = [data[k] for k in sorted(aside)]
    logits = np.array([x @ weights[i] for i, x, _ in checked]).reshape(-1, len(languages))
    return Model(languages, idf, weights, temperature(logits, np.array([k for _, _, k in checked], int)))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row. ``und`` with score 0 for a text that is null or has no letter, and
    for every text when there was nothing to learn from. Repeated rows are predicted each; only ``doc_id``,
    ``text`` and ``lang`` are read, and ``lang`` only in training."""
    model = train(docs, sample)

    def run(batches):
        for b in batches:
            found = [model.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
