"""Hard negatives, clusters and decontamination against plain versions."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, negatives, shallot

VECTORS = "vec_id long, embedding array<float>, label int"


def floored(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, every=50):
    """All scores of all pairs, in Python integers."""
    known = [(i, floored(v, 256), y) for i, v, y in rows if i is not None and y is not None and good(v)]
    asked = {}
    for i, v, y in known:
        if i % every == 0:
            asked[i] = max(asked.get(i, (v, y)), (v, y))
    out = []
    for a, (v, y) in asked.items():
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in known if i != a))
        for s, p, _ in [t for t in scored if t[2] == y][:5]:
            fit = [(-t, i) for t, i, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, r + 1, i, -s, t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def vector_rows(n, width, seed, labels=4):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0.15, 0.2, width).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]
    return rows


def awkward_vectors(width):
    base = vector_rows(150, width, 4)
    same = base[3][1]
    return base + [(i, same, 1 + i % 3) for i in range(200, 240)] + [(300, same, 1), (300, same, 1), (350, same, 2), (400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * width, 1), (403, [float("inf")] * width, 0),
                                                                     (404, same, None), (None, same, 1), (450, [], 1), (451, [], 1), (452, [], 2), (500, same[:2], 1), (-50, same, 1), (453, [3.0] * width, 2)]


@pytest.mark.parametrize("per_block", [16, 4096])
def test_hard_negatives_match_brute_force(spark, per_block):
    rows = awkward_vectors(8)
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("block", F.lit("x")).withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    got = sorted(map(tuple, negatives.hard_negatives(df, per_block=per_block).collect()))
    assert got == brute_negatives(rows) and len(got) > 10
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []


def test_negatives_of_wide_integers(spark):
    """Components so large that one sum needs more than 64 bits: the fields live in Python integers."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0.5, 1, 2000) * (1e5 if i % 2 else 1)).astype(np.float32).tolist(), i % 3) for i in range(60)]
    got = sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == brute_negatives(rows)


@pytest.mark.parametrize("low,high,width", [(0, 1, 1), (-159, 159, 64), (-3, 2, 7), (-(1 << 27), 1 << 27, 3), (-(1 << 27), 1 << 27, 600)])
def test_fields_hold_the_largest_sums(low, high, width):
    fields = negatives.Fields.of(low, high, width)
    rng = np.random.default_rng(width)
    a = np.concatenate([np.full((1, width), low), np.full((1, width), high), rng.integers(low, high + 1, (3, width))])
    c = np.concatenate([np.full((2, width), high), np.full((2, width), low), rng.integers(low, high + 1, (7, width))])
    exact = a.astype(object) @ c.astype(object).T
    assert (fields.products(a, fields.pack(c), c.sum(1)) == np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)).all()
    assert fields.count > 1 or fields.bits > 32


def brute_clusters(rows, k=16, rounds=3, width=64, scale=64):
    kept = [(i, floored(v, scale)) for i, v in rows if good(v) and len(v) == width]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in first]
    dist = lambda v, w: sum((p - q) ** 2 for p, q in zip(v, w))
    near = lambda v: min((dist(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(x) // len(m) for x in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == j]) else c[j] for j in range(len(c))]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in last)
    return sorted(((i, j, d, sum(e for _, q, e in last if q == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in last), key=str)


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(0, 0.3, 64) + (i % 5)).astype(np.float32).tolist()) for i in range(250)]
    # Groups of equal vectors (empty clusters, ties), no id, repeated ids, wrong lengths, unusable components.
    rows += [(1000 + i, [0.5] * 64) for i in range(60)] + [(2000 + i, [0.25] * 32 + [0.75] * 32) for i in range(60)]
    rows += [(None, [0.5] * 64), (None, [1.5] * 64), (7, [0.5] * 64), (7, [0.5] * 64), (3000, None), (3001, [0.1] * 63), (3002, [0.1] * 63 + [None]), (3003, [float("nan")] * 64), (3004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumn("near", F.lit(1)).withColumn("cluster", F.lit("c"))
    got = sorted(map(tuple, shallot.with_inertia(*shallot.clusters(df)).collect()), key=str)
    assert got == brute_clusters(rows)
    few = rows[:5]
    assert sorted(map(tuple, shallot.with_inertia(*shallot.clusters(spark.createDataFrame(few, "vec_id long, embedding array<float>"))).collect()), key=str) == brute_clusters(few)
    assert shallot.with_inertia(*shallot.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>"))).collect() == []


def test_shallot_search_agrees_with_all_distances_and_looks_at_fewer():
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (16, 8))
    x = centres[rng.integers(16, size=4000)] + rng.integers(-9, 10, (4000, 8))
    c = shallot.Centroids(centres.copy(), np.zeros(16))
    state, looked = shallot.first_search(x, c), 0
    for step in range(6):
        at = c.at + rng.integers(-4, 5, c.at.shape)
        if step == 3:
            at[5] = at[2]  # two centroids in one place: ties
        c = shallot.Centroids(at, np.sqrt(shallot.squared(at, c.at).astype(float)))
        *state, n = shallot.search(x, c, *state)
        looked += n
        d = ((x[:, None, :] - c.at[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        assert (state[2] >= np.sqrt(d.min(1)) - 1e-6).all() and (state[3] <= np.sqrt(np.sort(d, 1)[:, 1]) + 1e-6).all()
    assert looked < 6 * 4000 * 16 / 3


def brute_leaks(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = []
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        sets.append((i, n, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()))
    out = []
    for d, t in docs:
        w = words(t)
        hit, names = set(), set()
        for i, n, s in sets:
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k:k + n]) in s:
                    hit |= set(range(k, k + n))
                    names.add(i)
        names = sorted(str(i) for i in names if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_cases(awkward):
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join(f"w{rng.integers(300)}" for _ in range(n))
    long = prose(60)
    items = [(1, long), (2, "Two\twords"), (3, prose(12)), (4, None), (5, ""), (6, "...!"), (7, long), (10, prose(9)), (11, "Éa ß-ñ 日本 x"), (None, prose(15)), (12, " ".join(["so"] * 30)), (13, prose(200))]
    text = dict(items)
    docs = [(r[0], r[1]) for r in awkward]
    docs += [(100, prose(20) + " " + text[1] + " " + prose(9)), (101, text[1].upper().replace(" ", "--\n")), (102, " ".join(text[1].split()[20:29])), (103, " ".join(text[1].split()[20:30])), (104, "two words, two WORDS; twowords"),
             (105, text[3] + " " + text[3]), (106, text[10][:-1]), (107, text[10]), (108, "éa ß ñ 日本 x"), (109, text[None]), (110, " ".join(["so"] * 55)), (111, text[13][3:]), (None, text[3]), (112, "x" * 300 + " " + text[3]), (113, text[13] + " two words " + text[1])]
    return docs, items


@pytest.mark.parametrize("windows,piece", [(decontaminate.WINDOWS, decontaminate.PIECE), (40, 7)])
def test_leaks_match_brute_force(spark, make_docs, awkward, monkeypatch, windows, piece):
    """Also with a benchmark of many blocks, whose items are cut into several rows."""
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    docs, items = leak_cases(awkward)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("x"))
    df = make_docs(docs).withColumn("doc", F.lit("d")).withColumn("hits", F.lit(3)).withColumn("items", F.lit(3)).withColumn("n_words", F.lit(3))
    got = sorted(map(tuple, decontaminate.report(df, bench, windows=windows).collect()), key=str)
    assert got == brute_leaks(docs, items)
    assert decontaminate.report(make_docs([]), bench).collect() == []
    assert {r.n_hit for r in decontaminate.report(df, bench.limit(0)).collect()} == {0}


def test_cleaned_documents_have_no_hits(spark, make_docs, awkward):
    docs, items = leak_cases(awkward)
    bench = spark.createDataFrame([i for i in items if i[0] not in (2, 12)], "item_id long, text string")
    df = make_docs(docs).withColumn("hits", F.lit(3))
    cut, kept = decontaminate.clean(df, bench), decontaminate.clean(df, bench, drop_documents=True)
    assert cut.columns == df.columns == kept.columns and cut.count() == len(docs)
    left = {r.doc_id: r for r in decontaminate.report(df, bench).collect()}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in decontaminate.report(df, bench).collect() if not r.contaminated)
    after = {r.doc_id: r for r in decontaminate.report(cut, bench).collect() if r.doc_id is not None}
    assert all(after[i].n_words == left[i].n_words - left[i].n_hit for i in after if i is not None)
    assert {r.doc_id: r.text for r in cut.collect()}[4] == "one"


def test_equal_hashes_are_told_apart(monkeypatch):
    """All windows collide; the words decide."""
    monkeypatch.setattr(decontaminate, "mix", lambda x: np.zeros_like(x) + np.uint64(5))
    docs, items = leak_cases([])
    rows = [type("R", (), {"item_id": i, "words": b" ".join(w.encode() for w in re.findall(r"\w+", t.lower()))}) for i, t in [(1, items[0][1]), (3, items[2][1])]]
    found = decontaminate.WindowSet.of(rows)
    assert len(set(found.hashes)) == 1 and len(found.hashes) == 51 + 3
    body = np.frombuffer((docs[0][1] + " " + items[2][1]).encode(), np.uint8)
    first, _ = found.scan(decontaminate.Words(decontaminate.Texts(body, np.array([0, len(body)]))), found.bits())
    assert sorted(first) == [*range(20, 71), *range(89, 92)]
