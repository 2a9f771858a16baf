"""Quality rules at host level: rule failures by domain, shrunk by an empirical beta prior, joined back.

Every document is measured on its whole text and held against a few rules. Per host (``source``; null is
a host of its own) the failures of each rule are counted; the rate is shrunk towards all hosts with a beta
prior fitted by moments, so a host with three documents is judged mostly by the prior. A host whose shrunk
rate of a rule exceeds the rule's limit is condemned on that rule, and its documents that fail the rule go.
A single soft failure on a decent host is forgiven; a document that fails no rule always stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.staging import staged
from tickloom.llm.words import mix, per_text, prefix_hashes, slices, span_hashes

WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)

BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
#: Rule -> (failure of a document, highest shrunk failure rate of a decent host).
RULES = {
    "base": (BASE_FAILED, 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "lines": ("n_dup_lines > 3", 0.5),
    "length": ("word_chars < 2 * n_words OR word_chars > 15 * n_words", 0.5),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))


def measure(texts: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` per text."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    for at, part in slices(texts):
        data, offsets = part.data, part.offsets
        starts, ends, where = part.words()
        n, run = len(offsets) - 1, prefix_hashes(data)
        rows = out[at: at + n]
        rows[:, 0] = np.diff(where)
        later = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data & 0xC0) == 0x80, out=later[1:])
        rows[:, 1] = per_text(ends - starts - (later[ends] - later[starts]), where)
        rows[:, 2] = _counts(SYMBOLS[data], offsets)

        breaks = np.flatnonzero(data == 10)
        s, e = np.sort(np.append(offsets[:-1], breaks + 1)), np.sort(np.append(breaks, offsets[1:]))
        full = np.searchsorted(starts, e) > np.searchsorted(starts, s)
        s, e = s[full], e[full]
        text = np.searchsorted(offsets, s, side="right") - 1
        _, first = np.unique(mix(span_hashes(run, s, e) + text.astype(np.uint64) * _ODD), return_index=True)
        rows[:, 3] = np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)

        word = span_hashes(run, starts, ends)
        begin = np.arange(max(len(word) - WINDOW + 1, 0))
        text = np.searchsorted(where, begin, side="right") - 1
        begin = begin[begin + WINDOW <= where[text + 1]]
        key = (np.searchsorted(where, begin, side="right") - 1).astype(np.uint64) * _ODD
        for j in range(WINDOW):
            key = mix(key * np.uint64(31) + word[begin + j])
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = begin[times[which] > 1]
        cover = np.zeros(len(word) + 1, np.int64)
        cover[twice] += 1
        cover[twice + WINDOW] -= 1
        rows[:, 4] = per_text(np.cumsum(cover[:-1]) > 0, where)
    return out


def _measured(batches):
    for b in batches:
        m = measure(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *(pa.array(c) for c in m.T)], names=["doc_id", "source", *MEASURES])


def beta_prior(hosts: DataFrame, fails: str, n: str = "n") -> tuple[float, float]:
    """(a, b) by moments over hosts: mean and variance of the rates, less the variance that counting alone makes.
    Without variance left, or with one host, the prior weighs as much as the hosts' mean size."""
    rate = F.col(fails) / F.col(n)
    r = hosts.agg(F.count("*").alias("k"), F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col(n)).alias("inv"), F.avg(n).alias("size")).first()
    if not r.k:
        return 1.0, 1.0
    m = min(max(r.m, 1e-6), 1 - 1e-6)
    spread = r.v - m * (1 - m) * r.inv
    weight = max(m * (1 - m) / spread - 1, 1e-3) if spread > 0 else r.size
    weight = min(weight, r.size)
    return m * weight, (1 - m) * weight


def host_verdicts(measured: DataFrame, rules: dict = RULES) -> DataFrame:
    """``(source, n, fail_*, rate_*, bad_*)`` per host; counts meet as partial sums, whatever a host's size."""
    hosts = staged(measured.groupBy("source").agg(F.count("*").alias("n"), *(F.sum(F.expr(f"CAST({r} AS LONG)")).alias(f"fail_{k}") for k, (r, _) in rules.items())), "hosts")
    for k, (_, limit) in rules.items():
        a, b = beta_prior(hosts, f"fail_{k}")
        hosts = hosts.withColumn(f"rate_{k}", (F.col(f"fail_{k}") + a) / (F.col("n") + a + b)).withColumn(f"bad_{k}", F.col(f"rate_{k}") > limit)
    return hosts


def host_rules(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """Per document its measures, ``base_failed``, the host's shrunk rates and ``kept``.

    ``docs`` needs ``doc_id``, ``source`` and ``text``; other columns are ignored. A null text measures as empty
    and fails the base rule. Repeated rows are measured and counted each. The join of documents and hosts moves
    measures only, never texts, and a host with a third of all documents is split by adaptive execution.
    """
    s = docs.schema
    kinds = f"doc_id {s['doc_id'].dataType.simpleString()}, source {s['source'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = staged(docs.select("doc_id", "source", "text").mapInArrow(_measured, kinds), "measured")
    hosts = host_verdicts(measured, rules)
    verdicts = hosts.select(F.col("source").alias("host"), F.col("n").alias("host_docs"), *(c for k in rules for c in (f"rate_{k}", f"bad_{k}")))
    out = measured.join(verdicts, F.col("source").eqNullSafe(F.col("host")), "left").withColumn("base_failed", F.expr(BASE_FAILED))
    fails = " OR ".join(f"(bad_{k} AND ({r}))" for k, (r, _) in rules.items())
    return out.withColumn("kept", F.expr(f"NOT (base_failed OR {fails})")).drop("host", *(f"bad_{k}" for k in rules))
