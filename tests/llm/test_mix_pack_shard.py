"""Mixing, packing, sharding, top-k and the pipeline."""

from __future__ import annotations

import importlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tickloom.llm import mixing, near_dedup, packing, queries, secrets, sharding, topk, toxicity

from llm.test_dedup import brute_components

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        out = {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_meets_targets(make_docs):
    rng = np.random.default_rng(0)
    rows = []
    for k, (s, n) in enumerate({"b": 900, "a": 30, "é": 200, "c": 300, None: 120, "empty": 3}.items()):
        for i in range(n):
            rows.append((k * 1000 + i, "" if s == "empty" else " ".join(["w"] * int(rng.integers(1, 200))), "en", s))
    rows += [(9000, None, "en", "b"), (9001, "w " * 50, "en", "b"), (9001, "w " * 50, "en", "b")]
    df = make_docs(rows, extra=False)
    mixed = mixing.mix(mixing.with_size(df).drop("text")).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = dict.fromkeys(want, 0)
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9) and 0 <= r.copies <= 3
        taken[r.source] += r.n * r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 20), s
    again = mixing.mix(mixing.with_size(df.repartition(7)).drop("text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))
    assert mixing.mix(mixing.with_size(make_docs([])).drop("text")).collect() == []


def test_packing_is_an_exact_round_trip(make_docs, awkward):
    tok = Tokenizer.from_file(PATH)
    df = make_docs(awkward, extra=False)
    pieces = packing.pack(df, PATH, with_ids=True).collect()
    want = sorted((str(i), tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in awkward)
    # Documents again, by the order of the stream: repeated ids are told apart by their place.
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    docs, at = [], 0
    for p in stream:
        assert p.sequence_id * 1024 + p.offset == at and len(p.ids) == p.length <= 1024
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        at += p.length
        if p.start == 0:
            docs.append((str(p.doc_id), []))
        assert p.start == len(docs[-1][1])
        docs[-1][1].extend(p.ids)
        assert p.start + p.length <= p.doc_tokens
    assert sorted((i, tuple(x)) for i, x in docs) == want
    packed = packing.sequences(packing.pack(df, PATH, with_ids=True)).orderBy("sequence_id").collect()
    assert all(r.n_tokens == 1024 == len(r.ids) for r in packed[:-1])
    last = packed[-1]
    assert len(last.ids) == (last.n_tokens if last.n_tokens & (last.n_tokens - 1) == 0 else 1024)
    assert packing.pack(make_docs([]), PATH).collect() == []


def test_shards_are_even_and_complete(make_docs, awkward):
    rows = awkward + [(100 + i, "copy") for i in range(300)]
    got = sharding.shards(make_docs(rows), bucket_bytes=2000).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(r[:2]) for r in rows)
    assert all(r.size == len((r.text or "").encode()) + 8 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 24 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shards(make_docs([])).collect() == []


def test_fisher_yates_is_fair_and_seeded():
    orders = [tuple(sharding.fisher_yates(4, s)) for s in range(4800)]
    counts = {o: orders.count(o) for o in set(orders)}
    assert len(counts) == 24 and 120 < min(counts.values()) and max(counts.values()) < 280
    assert np.array_equal(sharding.fisher_yates(50, 7), sharding.fisher_yates(50, 7)) and sorted(sharding.fisher_yates(1, 1)) == [0]


def test_written_shards_are_in_slot_order(spark, make_docs, tmp_path):
    dealt = sharding.shards(make_docs([(i, f"t{i}") for i in range(200)], extra=False), count=4)
    sharding.write_shards(dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def brute_top(rows, k=5, every=50):
    good = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for i, q in good:
        if i % every == 0:
            s = sorted((-int(v @ q), j) for j, v in good if j != i)[:k]
            out += [(i, r + 1, j, -score) for r, (score, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block", [topk.DATA_BLOCK, 100])
def test_top_k_matches_brute_force(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=16) * 0.3]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(2000, None), (2001, [1.0, None] * 8), (2002, [float("nan")] * 16), (2050, [float("inf")] * 16), (None, rows[0][1]), (2100, [0.0] * 16), (2150, [1.0, 2.0]), (2200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("block", F.lit(2)).repartition(3)
    got = topk.top_k(df, data_block=block, query_block=max(block // 20, 3)).collect()
    assert sorted(map(tuple, got)) == brute_top(rows)


def test_top_k_with_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.top_k(make([])).collect() == [] and topk.top_k(make([(50, [1.0])])).collect() == []
    assert [tuple(r) for r in topk.top_k(make([(50, [1.0]), (1, [0.5])])).collect()] == [(50, 1, 1, 256 * 128)]


def test_cover_tree_invariants():
    x = np.random.default_rng(0).normal(size=(700, 8))
    t = topk.CoverTree(x)
    assert sorted(t.order) == list(range(700))
    for i in range(len(t.lo)):
        own = x[t.order[t.lo[i]: t.hi[i]]]
        assert np.sqrt(((own - t.centre[i]) ** 2).sum(1)).max() <= t.radius[i] + 1e-9
        if t.first[i] < t.last[i]:
            kids = range(t.first[i], t.last[i])
            assert [t.lo[k] for k in kids][0] == t.lo[i] and all(t.hi[a] == t.lo[b] for a, b in zip(kids, list(kids)[1:])) and t.hi[kids[-1]] == t.hi[i]
            c = t.centre[t.first[i]: t.last[i]]
            gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)) + np.eye(len(c)) * 1e9
            assert gaps.min() > t.radius[i] / topk.SHRINK - 1e-9


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    clean = {r.doc_id for r in scored if r.predicted == 0}
    step = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
        seen.append(step)
        if name != "pack":
            assert step.columns == docs.columns
    assert {r.doc_id for r in seen[0].collect()} == clean
    kept = {i for i, _, c in brute_components([(i, rows[i].text) for i in clean]) if i == c}
    assert {r.doc_id for r in seen[1].collect()} == kept
    redacted = {r.doc_id: r for r in seen[2].collect()}
    assert set(redacted) == kept
    assert all(("[secret]" in redacted[i].text) or redacted[i].text == rows[i].text for i in kept)
    assert all(not secrets.base_spans(r.text)[0] for r in redacted.values())
    mixed = seen[3].collect()
    assert {r.doc_id for r in mixed} <= kept and all(r.text == redacted[r.doc_id].text for r in mixed)
    pieces = seen[4].collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert len([p for p in pieces if p.start == 0]) == len(mixed)
    firsts = lambda rows: sorted((p.doc_id, p.doc_tokens) for p in rows if p.start == 0)
    assert firsts(corpus_pipeline.run(spark, SF).collect()) == firsts(pieces)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_pipeline_packs_token_ids(spark):
    """The last stage's pieces carry the ids that their digests are of, and make whole windows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    pieces = corpus_pipeline.pack(spark, docs, SF)
    rows = pieces.collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    windows = packing.sequences(pieces).collect()
    assert sum(w.n_tokens for w in windows) == sum(r.length for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    duckdb = importlib.import_module("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted(map(str, (tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall())))
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, map(tuple, df.select(*sorted(names)).collect()))) == want


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert near_dedup.SIMILARITY == (75, 100)


def test_pack_takes_long_runs_of_white_space():
    """The fast encoder gives up on these; the tokenizers library decides."""
    ids, plain = packing.tokenize(PATH), Tokenizer.from_file(PATH)
    for c in (" ", "\t", "\n"):
        text = "a" + c * 1_000_000 + "b"
        assert ids(text)[:-1].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_top_k_of_empty_vectors(spark):
    rows = [(0, []), (50, []), (7, None), (8, [1.0, None])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 50, 0), (50, 1, 0, 0)]


def test_mix_breaks_ties_alike_beside_null_ids():
    """The order in which rows of a chunk arrive decides nothing."""
    import pyarrow as pa

    rows = [(1, 10, 1), (2, 10, 1), (3, 10, 1), (None, 10, 1), (None, 5, 2)]
    seen = set()
    for seed in range(20):
        t = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]
        table = pa.table({"doc_id": pa.array([r[0] for r in t], pa.int64()), "size": [r[1] for r in t], "n": [r[2] for r in t], "rate": [0.5] * len(t)})
        seen.add(tuple(sorted(((r["doc_id"] or 0, r["size"], r["copies"]) for r in mixing._copies(table).to_pylist()))))
    assert len(seen) == 1


def test_mix_replaces_clashing_columns(spark, make_docs):
    """A ``size`` of the input is no word count, and the pipeline's stage returns columns named like its own."""
    df = make_docs([(i, "w " * (i + 1), "en", "ab"[i % 2]) for i in range(40)]).withColumn("copies", F.lit(9)).withColumn("copy_", F.lit("c")).withColumn("row", F.lit(1))
    assert {r.doc_id: r.size for r in mixing.with_size(df).collect()} == {i: i + 1 for i in range(40)}
    out = corpus_pipeline.mix_sources(spark, df, "")
    assert out.columns == df.columns and {(r.copies, r.copy_, r["size"]) for r in out.collect()} == {(9, "c", "x")}


def test_shards_do_not_depend_on_the_order_of_arrival(spark, make_docs):
    """One bucket: the same rows in the same input partitions give the same order, however they are fetched."""
    rows = [(i, "t" * (i % 7)) for i in range(300)]
    df = make_docs(rows, extra=False, parts=1).coalesce(1).sortWithinPartitions("doc_id")
    got = [sorted((r.doc_id, r.shard, r.slot) for r in sharding.shards(df).collect()) for _ in range(2)]
    assert got[0] == got[1]
    assert sorted(r[1:] for r in got[0]) == sorted((p % 24, p // 24) for p in range(300))


def test_pack_holds_a_part_of_a_batch_at_a_time(monkeypatch):
    """Parts of a batch, a long text in one of its own, give the same tokens and pieces as the whole batch."""
    import pyarrow as pa

    texts = ["one two three four", None, "", "word " * 900, "a"] * 6
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = []
    for size in (1 << 20, 40):
        monkeypatch.setattr(packing, "PART_BYTES", size)
        tokenized = list(packing._tokenized([batch.slice(0, 0), batch.slice(2), batch], PATH, 3))
        cut = list(packing._cut(tokenized[:1] if size > 40 else [pa.Table.from_batches(tokenized).combine_chunks().to_batches()[0]], {3: 100}, 64, True))
        assert (len(tokenized) == 2 and len(cut) == 1) if size > 40 else (len(tokenized) > 12 and len(cut) > 12 and max(b.num_rows for b in tokenized) < 6)
        got.append(([r for b in tokenized for r in b.to_pylist()], [r for b in cut for r in b.to_pylist()]))
    assert got[0][0] == got[1][0] and len(got[0][0]) == 2 * len(texts) - 2
    assert got[1][1][:len(got[0][1])] == got[0][1] and sum(r["length"] for r in got[1][1]) == sum(r["n_tokens"] for r in got[1][0])


def test_pipeline_bounds_the_bytes_of_a_batch(spark):
    """After any stage that goes through Python, a task's rows come in batches of few MB, not all in one."""
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    large = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('ab ', 70000) AS text")
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.redact_secrets, corpus_pipeline.mix_sources, corpus_pipeline.pack):
            spark.conf.unset(key)
            stage(spark, docs, "")
            found = [r.n for r in large.mapInArrow(sizes, "n long").collect()]
            assert sum(found) > 12_000_000 and max(found) <= corpus_pipeline.BATCH_BYTES + 250_000
    finally:
        spark.conf.unset(key)


def test_cover_tree_splits_only_where_points_are_close():
    """Vectors without structure made a node each, at a distance pass a node."""
    rng = np.random.default_rng(3)
    assert len(topk.CoverTree(rng.normal(size=(2000, 64))).lo) == 1
    centres = rng.normal(size=(12, 64)) * 9
    t = topk.CoverTree(centres[np.arange(2400) % 12] + rng.normal(size=(2400, 64)) * 0.01)
    assert t.last[0] - t.first[0] == 12 and (t.hi - t.lo)[1:13].tolist() == [200] * 12


def test_top_k_sends_queries_once_a_group(spark, monkeypatch):
    """Not once a block: 60 blocks of 50 vectors are held by a few tasks, which get every query once."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(3000)]
    sent = []
    monkeypatch.setattr(topk, "GROUPS", 3)
    dealt = type(spark.range(0)).repartitionById
    monkeypatch.setattr(type(spark.range(0)), "repartitionById", lambda df, *a: sent.append(df.groupBy("kind").count().collect()) or dealt(df, *a))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2), data_block=50, query_block=60)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert dict(sent[0])[1] <= 2 * 3


@pytest.mark.parametrize("twin", [None, 7])
def test_top_k_of_many_equal_vectors(spark, twin):
    """More ties than fit, in one block and over several, also with a repeated id."""
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(700)] + [(1000 + i, [float(i % 3), 1.0, -2.0]) for i in range(300)] + [(twin, [9.0, 9.0, 9.0])] * 3
    for block in (64, topk.DATA_BLOCK):
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2), data_block=block, query_block=30)
        assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_top_k_of_long_vectors_is_exact(spark):
    """Sums beyond 2^24, where 4-byte floats are no longer exact, in the same block as short vectors."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-20000, 20000, 6) if i % 2 else rng.integers(-3, 3, 6)).astype(float).tolist()) for i in range(400)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2), data_block=100)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
