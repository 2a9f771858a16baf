"""Near duplicates and exact repeats against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tickloom.llm import graph, near_dedup, repeats, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def near(df):
    out = near_dedup.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def edited(rng, words, share):
    return [f"edit{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def families():
    """Groups of near copies around the threshold, documents that share one passage, and strangers."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = fresh(40), []
    for _ in range(6):
        base = fresh(rng.choice((30, 90, 200)))
        rows += [base] + [edited(rng, base, rng.choice((0, 0.005, 0.02, 0.03, 0.05))) for _ in range(14)]
    rows += [fresh(40) + passage + fresh(20) for _ in range(25)] + [fresh(60) for _ in range(15)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_near_duplicates_match_brute_force(make_docs, families):
    assert near(make_docs(families)) == brute_components(families)


def test_near_duplicates_of_awkward_rows(make_docs, awkward):
    assert near(make_docs(awkward)) == brute_components(awkward)


def test_small_blocks_give_the_same(make_docs, families, monkeypatch):
    for name in ("BLOCK", "GROUP", "PART", "BROADCAST_IDS"):
        monkeypatch.setattr(near_dedup, name, 3)
    assert near(make_docs(families)) == brute_components(families)


@pytest.mark.parametrize("both, union", [(3, 4), (6, 8), (9, 12), (15, 20), (60, 80)])
def test_short_pairs_at_the_threshold_share_a_band(both, union):
    rng = np.random.default_rng(both)
    for _ in range(2000):
        s = near_dedup.mix(rng.integers(0, 2**63, union, dtype=np.uint64))
        a, b = (near_dedup.band_keys(near_dedup.minhash(np.sort(x))) for x in (s, s[:both]))
        assert (a == b).any()


def test_short_texts_with_another_last_word_are_linked(make_docs):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(11)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], "other"]))]
    assert near(make_docs(rows)) == sorted(((i, 7, i - i % 2) for i, _ in rows), key=str)


def test_failed_try_against_the_smallest_member_leaves_the_others(make_docs):
    """y links x to its group, but every key of y and x holds a smaller copy of y, none of them similar enough to x."""
    line = [f"w{i}" for i in range(118)]
    y, x = line[:104], line[14:]
    copies = [y[:i] + [f"c{n}"] + y[i + 1:] for n, i in enumerate(random.Random(4).choices(range(22, 96), k=300))]
    rows = [(n, " ".join(w)) for n, w in enumerate([*copies, y, x])]
    want = brute_components(rows)
    assert {c for _, _, c in want} == {0} and not any(4 * len(shingles(t) & shingles(rows[-1][1])) >= 3 * len(shingles(t) | shingles(rows[-1][1])) for _, t in rows[:-2])
    assert near(make_docs(rows, parts=1)) == want


def test_empty_table(make_docs):
    assert near(make_docs([])) == []
    assert repeats.remove_repeats(make_docs([])).collect() == []


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.6, 0.75, 0.9):
        n = 3000
        fresh = lambda k: near_dedup.mix(rng.integers(0, 2**63, k, dtype=np.uint64))
        a = np.unique(fresh(n))
        keep = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.append(a[rng.permutation(len(a))[:keep]], fresh(len(a) - keep)))
        z = np.bitwise_count(near_dedup.odd_sketch(near_dedup.minhash(a)) ^ near_dedup.odd_sketch(near_dedup.minhash(b))).sum()
        m, k = near_dedup.SKETCH_BITS, near_dedup.ROWS * near_dedup.BANDS
        assert abs(1 + m / (4 * k) * np.log(1 - 2 * z / m) - share) < 0.12
        assert share < 0.7 or z <= near_dedup.furthest(np.array([n]))[0]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_suffix_order_matches_sorting_in_memory_and_on_disk():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, k, length = int(rng.integers(0, 150)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
        t = rng.integers(0, k, n).astype(np.uint16)
        if trial % 3 == 0 and n > 20:
            t[n // 2: n // 2 + n // 4] = t[: n // 4]
        blocks = list(suffixes.suffix_order(t, length, 10**9 if trial % 2 else 0))
        p, c = (np.concatenate(x) for x in zip(*blocks)) if blocks else ([], [])
        heads = [tuple(t[i: i + length]) for i in p]
        assert sorted(p) == list(range(n)) and heads == sorted(heads)
        for i in range(1, n):
            same = next((j for j, (x, y) in enumerate(zip(heads[i - 1], heads[i])) if x != y), min(len(heads[i - 1]), len(heads[i])))
            assert same == c[i]


def test_disk_queue_keeps_order(tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "QUEUE_MEMORY", 10)
    q = suffixes.Queue(str(tmp_path / "q"))
    for i in range(50):
        q.push(np.arange(i * 3, i * 3 + 3), np.full(3, i % 7, np.uint8))
    got = list(q.drain())
    assert np.array_equal(np.concatenate([p for p, _ in got]), np.arange(150)) and np.concatenate([c for _, c in got])[-1] == 49 % 7


def brute_repeats(rows, length=50):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1 if i is not None else 0):
            k = b[s: s + length]
            seen[k] = min(seen.get(k, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1 if i is not None else 0):
            if seen[b[s: s + length]] < i:
                gone[s: s + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_cases():
    rng = random.Random(2)
    letters = lambda n, a="abcdefgh ": "".join(rng.choice(a) for _ in range(n))
    passages = [letters(k) for k in (49, 50, 51, 80, 300)]
    rows = [(i, letters(rng.randrange(80)) + rng.choice(passages) + letters(rng.randrange(80), "xyzäö ") + rng.choice(passages)) for i in range(60)]
    return rows + [(100, "é" * 200), (101, "é" * 130), (102, "ab" * 100), (103, "ba" * 90), (104, "q" * 49), (105, "q" * 50), (106, "q" * 400), (107, letters(49))]


@pytest.mark.parametrize("in_memory", [repeats.IN_MEMORY, 0])
def test_repeats_match_brute_force(make_docs, in_memory):
    rows = repeat_cases()
    assert sorted(map(tuple, repeats.remove_repeats(make_docs(rows), in_memory).collect()), key=str) == brute_repeats(rows)


def test_repeats_of_awkward_rows(make_docs, awkward):
    rows = [(i, (t or "")[:2000] if t else t) for i, t in awkward]
    assert sorted(map(tuple, repeats.remove_repeats(make_docs(rows)).collect()), key=str) == brute_repeats(rows)


def test_repeats_join_when_ids_are_many(make_docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 200)
    rows = repeat_cases()
    assert sorted(map(tuple, repeats.remove_repeats(make_docs(rows)).collect()), key=str) == brute_repeats(rows)


def test_segments_of_long_texts_cover_every_string():
    """A text of several slices comes in pieces that overlap: each string of 50 bytes lies in one segment at least,
    and its core is that of the whole text."""
    import pyarrow as pa

    from tickloom.llm import words

    text = "".join(random.Random(3).choice("abcd ") for _ in range(3000))
    whole = [(s, e, c) for _, _, a, b, core, _ in repeats.segments(pa.array([text])) for s, e, c in zip(a, b, core)]
    pieces, small = words.pieces, lambda t, overlap: words.pieces(t, overlap, 256)
    try:
        repeats.pieces = small
        cut = [(s, e, c) for _, _, a, b, core, _ in repeats.segments(pa.array([text])) for s, e, c in zip(a, b, core)]
    finally:
        repeats.pieces = pieces
    cores = lambda spans: sorted({(p, c) for s, e, c in spans for p in range(s, e - repeats.LENGTH + 1)})
    assert cores(cut) == cores(whole) and [p for p, _ in cores(whole)] == list(range(3000 - 49))
    assert len(cut) > len(whole)


def test_segments_that_share_their_core_alone_are_not_sorted(monkeypatch):
    """Their share grows with the text. What goes into the sort is no longer than the pieces two documents can share."""
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()
    core, common = letters(18), letters(60)
    bodies = [letters(32) + core + letters(32) for _ in range(200)] + [letters(30) + common + letters(30) for _ in range(2)] + [common[5:] + letters(10)]
    n, sizes = len(bodies), []
    order = repeats.suffix_order
    monkeypatch.setattr(repeats, "suffix_order", lambda x, *a: sizes.append(len(x)) or order(x, *a))
    ids = list(range(n))
    rows = repeats._batch(repeats._SPANS, ids, ids, [100] * n, [0] * n, [1] * n, bodies)
    (found,) = repeats._sort_shards(repeats.IN_MEMORY)(iter([rows.slice(0, 90), rows.slice(90, 0), rows.slice(90)]))
    assert sum(sizes) <= 2 * 61
    assert sorted(zip(*(c.to_pylist() for c in found.columns))) == [(201, 201, 130, 190), (202, 202, 100, 155)]


def test_shards_end_between_cores(monkeypatch):
    rows, shards = [(c, 10 * c + i) for c, n in enumerate((1, 1, 5, 1, 2, 1, 1, 1)) for i in range(n)], []
    monkeypatch.setattr(repeats, "SHARD_BYTES", 200)
    monkeypatch.setattr(repeats, "_repeated", lambda docs, *a: shards.append(docs.tolist()) or [docs[:0]] * 4)
    core, doc = zip(*rows)
    zero = [0] * len(rows)
    b = repeats._batch(repeats._SPANS, doc, zero, zero, zero, core, [b"x" * 60] * len(rows))
    for step in (1, 3, len(rows)):
        shards.clear()
        list(repeats._sort_shards(1)(b.slice(i, step) for i in range(0, len(rows), step)))
        assert shards == [[0, 10, 20, 21, 22, 23, 24], [30, 40, 41, 50], [60, 70]]


@pytest.mark.parametrize("held", [1, 7, 1 << 16])
def test_fates_of_segments_in_any_order(monkeypatch, held):
    """Rows of a core come in any order and over several batches."""
    monkeypatch.setattr(repeats, "HELD_ROWS", held)
    rng = np.random.default_rng(held)
    for _ in range(60):
        n = int(rng.integers(0, 60))
        core = np.sort(rng.integers(0, 6, n))
        seg, doc, step = core * 10 + rng.integers(0, 3, n), rng.integers(0, 5, n), int(rng.integers(1, 9))
        batches = [repeats._batch(repeats._SEGMENTS, *(c[i: i + step] for c in (core, seg, doc))) for i in range(0, n, step)]
        got = [r for b in repeats._judge(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        want = set()
        for s in set(seg.tolist()):
            d, least = set(doc[seg == s].tolist()), int(doc[seg == s].min())
            want |= {(x, s, True) for x in d - {least}} | ({(least, s, False)} if len(set(seg[core == s // 10])) > 1 else set())
        assert set(got) == want and len([r for r in got if not r[2]]) == len([r for r in want if not r[2]])
