"""Near-duplicate documents: MinHash bands propose pairs, odd sketches screen them, full sets decide.

A document's set has its distinct 5-word shingles of ASCII-lower-cased words; two documents are
linked when the Jaccard similarity of their sets is at least ``SIMILARITY``.

1. One pass computes per document a 64-bit hash of every shingle, a MinHash of ``BANDS * ROWS``
   independent hash functions, the band keys, an odd sketch (every MinHash value flips one of
   ``SKETCH_BITS`` bits) and a 128-bit fingerprint of the whole set.
2. Documents meet on band keys. Each map task first links the members of a key to their smallest
   member and sends on that member alone, so a group with a third of all documents sends one row per
   map batch. The reducers link those in turn, streaming over sorted rows. Nothing is quadratic here.
3. Links with equal fingerprints hold. The others are screened by the population count of the XOR of
   the two sketches and confirmed on the full sets, read again from the text. Components are formed.
4. Exact rest: in keys whose members still lie in several components, every document outside of the largest asks
   each larger component: single documents if the sketches allow it, others in parts of bounded size. What leaves
   is not pairs but (document, part of a component); each is answered on the full sets. Members of one component
   need no further comparison, which is what keeps large groups cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.graph import components, merged
from tickloom.llm.staging import staged
from tickloom.llm.words import LOWER, Texts, mix, prefix_hashes, slices, span_hashes

SHINGLE = 5
SIMILARITY = (75, 100)
#: A pair at 0.75 shares no band with probability (1 - 0.75^6)^80 = 1.5e-7, whatever the size of its sets.
ROWS, BANDS = 6, 80
SKETCH_BITS = 1024
#: Rows of one block in the comparison of step 4, pairs of one confirming group, documents of a component's part.
BLOCK, GROUP, PART = 2048, 1024, 256
#: Up to this many ids a semi join is broadcast (two longs each); beyond, it shuffles.
BROADCAST_IDS = 200_000

_SLOTS = ROWS * BANDS
_FACTORS = np.random.Generator(np.random.PCG64(17)).integers(0, 2**63, _SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty without words."""
    for _, part in slices(texts):
        low = Texts(LOWER[part.data], part.offsets)
        starts, ends, at = low.words()
        word = span_hashes(prefix_hashes(low.data), starts, ends)
        full = np.zeros(max(len(word) - SHINGLE + 1, 0), np.uint64)
        for j in range(SHINGLE):
            full = mix(full * np.uint64(31) + word[j: j + len(full)])
        for i, j in zip(at[:-1], at[1:]):
            if j - i >= SHINGLE:
                yield np.unique(full[i: j - SHINGLE + 1])
            elif j > i:
                one = np.array([j - i], np.uint64)
                for w in word[i:j]:
                    one = mix(one * np.uint64(37) + w)
                yield one
            else:
                yield np.zeros(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``_SLOTS`` hash functions: the shingle hashes, which are well mixed, times a
    random odd number. Every value looks at the whole set, so those of short sets do not agree or differ together."""
    out = np.full(_SLOTS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 64):
        np.minimum(out, (shingles[i: i + 64, None] * _FACTORS).min(0), out=out)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in sample.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(31) + column)
    return key.view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity of the MinHash values that fall on each bit."""
    bit = mix(sample + np.arange(_SLOTS, dtype=np.uint64) * _ODD) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1)


def furthest(n: np.ndarray) -> np.ndarray:
    """Largest XOR population count at which sets of ``n`` shingles may still reach the similarity: the expected
    count at 0.75 and five standard deviations, of the MinHash sample and of the parity bits together. Small sets
    are never screened."""
    n = np.maximum(np.asarray(n, float), 1)
    s, m, k = SIMILARITY[0] / SIMILARITY[1], SKETCH_BITS, _SLOTS
    differ = 2 * k * (1 - s)
    count = m / 2 * (1 - np.exp(-2 * differ / m))
    per_similarity = 2 * k * np.exp(-2 * differ / m)
    deviation = np.sqrt(s * (1 - s) / np.minimum(n, k) * per_similarity**2 + m / 4 * (1 - np.exp(-4 * differ / m)))
    return np.where(n < 40, m, count + 5 * deviation)


def _pa(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, sketch binary, keys binary"


def _sign(batches):
    for b in batches:
        rows = []
        for s in shingle_sets(b.column("text")):
            if len(s):
                sample = minhash(s)
                total = int(np.bitwise_xor.reduce(mix(s ^ _ODD)).view(np.int64)), int(mix(s + _ODD).sum(dtype=np.uint64).view(np.int64))
                rows.append((len(s), *total, odd_sketch(sample).tobytes(), band_keys(sample).tobytes()))
            else:
                rows.append((0, 0, 0, None, None))
        cols = [b.column("doc_id").cast(pa.int64()), *(list(c) for c in (zip(*rows) if rows else [[]] * 5))]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _pa(SIGNED))], schema=_pa(SIGNED))


MEETING = "key long, a long, b long"


def _stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (key, doc): the index of each key's first row, for every row; where keys start."""
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, int)
    return np.repeat(first, np.diff(np.append(first, len(key)))), first


def _meet_locally(batches):
    """Band rows of a batch: the smallest document of each key goes on (b null), the others are linked to it."""
    for b in batches:
        docs, keys = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("keys").to_pylist()
        if not keys:
            continue
        key, doc = np.concatenate([np.frombuffer(k, np.int64) for k in keys]), np.repeat(docs, BANDS)
        o = np.lexsort((doc, key))
        key, doc = key[o], doc[o]
        lead, _ = _stars(key, doc)
        own = lead == np.arange(len(key))
        keep = own | (doc != doc[lead])
        for i in range(0, len(key), 1 << 18):
            k = slice(i, i + (1 << 18))
            k = np.flatnonzero(keep[k]) + i
            yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(doc[lead[k]]), pa.array(doc[k], mask=own[k])], schema=_pa(MEETING))


def _meet(batches):
    """Rows sorted by (key, a): links pass; the documents that stand for a map batch are linked to the first."""
    last_key = last_doc = None
    for b in batches:
        if not b.num_rows:
            continue
        key, a = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "a"))
        linked = b.column("b").is_valid().to_numpy(zero_copy_only=False)
        other = b.column("b").fill_null(0).to_numpy(zero_copy_only=False)
        k, d = key[~linked], a[~linked]
        if last_key is not None:
            k, d = np.append(last_key, k), np.append(last_doc, d)
        lead, first = _stars(k, d)
        pair = d != d[lead]
        if len(first):
            last_key, last_doc = k[first[-1]: first[-1] + 1], d[first[-1]: first[-1] + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((key[linked], k[pair]), (a[linked], d[lead[pair]]), (other[linked], d[pair]))], schema=_pa(MEETING))


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among the distinct ``ids``: broadcast up to BROADCAST_IDS, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def _confirm(left, right):
    """Some centres (``right``) and members of theirs (``left``): the pairs linked on the full sets."""
    out = {"a": [], "b": []}
    if right.num_rows and left.num_rows:
        num, den = SIMILARITY
        centres: dict[int, list[np.ndarray]] = {}
        for a, s in zip(right.column("centre").to_pylist(), shingle_sets(right.column("whole").combine_chunks())):
            centres.setdefault(a, []).append(s)
        for a, b, s in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), shingle_sets(left.column("text").combine_chunks())):
            for c in centres.get(a, ()):
                if den * min(len(s), len(c)) < num * max(len(s), len(c)):
                    continue
                both = len(np.intersect1d(s, c, assume_unique=True))
                if both and den * both >= num * (len(s) + len(c) - both):
                    out["a"].append(a)
                    out["b"].append(b)
                    break
    return pa.table(out, schema=_pa("a long, b long"))


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity. About GROUP pairs share a confirming group; a centre with
    many members is dealt to several: members by hash, the centre's text to each of them."""
    pairs = staged(pairs, "pairs")
    groups = max(1, -(-pairs.count() // GROUP))
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    group = F.pmod(F.xxhash64("a", "part"), F.lit(groups)).cast("int")
    dealt = pairs.join(hot, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", group.alias("g"))
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = staged(only(docs, ids, "doc_id"), "texts")
    members = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("g", "a", "b", "text")
    centres = hot.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("a", group.alias("g")).distinct()
    centres = centres.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "g", "text").toDF("centre", "slot", "whole")
    return members.groupBy("g").cogroup(centres.groupBy("slot")).applyInArrow(_confirm, "a long, b long").distinct()


def _screened(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    num, den = SIMILARITY
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (np.bitwise_count(sa ^ sb).sum(-1, dtype=np.int64) <= furthest(np.minimum(na, nb)))


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def _screen(batches):
    for b in batches:
        if b.num_rows:
            n = [b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")]
            yield b.select(["a", "b"]).filter(pa.array(_screened(_sketches(b.column("sa")), _sketches(b.column("sb")), *n)))


_ASKS = "doc_id long, comp long, size long"


def _across(t: pa.Table) -> pa.Table:
    """Some keys, each one block of asking documents and one of components (``doc_id`` null): which of them must be
    compared. The document of the smaller component asks; a component of one document is screened by its sketch."""
    get = lambda c: t.column(c).to_numpy()
    key, x, y = get("key"), get("x"), get("y")
    o = np.lexsort((y, x, key))
    new = np.append(True, (key[o][1:] != key[o][:-1]) | (x[o][1:] != x[o][:-1]) | (y[o][1:] != y[o][:-1]))
    asks_itself = t.column("doc_id").is_valid().to_numpy()[o]
    doc = t.column("doc_id").fill_null(0).to_numpy()[o]
    n = t.column("n_shingles").fill_null(0).to_numpy()[o]
    sketch = _sketches(t.column("sketch").fill_null(bytes(SKETCH_BITS // 8)))[o]
    comp, size = get("comp")[o], get("size")[o]
    asks = []
    bounds = np.append(np.flatnonzero(new), len(o))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        rows = np.arange(lo, hi)
        targets = rows[~asks_itself[lo:hi]]
        for i in rows[asks_itself[lo:hi]]:
            to = targets[(size[targets] > size[i]) | ((size[targets] == size[i]) & (comp[targets] > comp[i]))]
            near = size[to] > 1
            near[~near] = _screened(sketch[i], sketch[to[~near]], np.full((~near).sum(), n[i]), n[to[~near]])
            to = to[near]
            asks.append(np.stack([np.full(len(to), doc[i]), comp[to], size[to]]))
    found = np.concatenate(asks, 1) if asks else np.zeros((3, 0), np.int64)
    found = found[:, np.lexsort(found)]
    found = found[:, np.append(True, (found[:, 1:] != found[:, :-1]).any(0))] if found.shape[1] else found
    return pa.table(list(found), schema=_pa(_ASKS))


def _rest(members: DataFrame, shape: DataFrame, groups: int) -> DataFrame:
    """``(doc_id, comp, part)`` to compare, from ``(key, doc_id, comp, size)`` rows; ``shape``: doc_id, n_shingles, sketch.
    A key's components take one row each, and its documents outside of its largest component ask. Keys of one
    component, and of two documents (which have met), end here. A key beyond BLOCK components is cut into blocks,
    each pair of blocks on its own; small keys share one of ``groups`` groups."""
    per = members.groupBy("key", "comp").agg(F.max("size").alias("size"), F.count("*").alias("docs"))
    keys = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("docs").alias("docs"), F.max(F.struct("size", "comp")).alias("top")).where("comps > 1 AND docs > 2")
    keys = keys.select("key", F.ceil(F.col("comps") / BLOCK).cast("int").alias("blocks"), F.col("top.comp").alias("top"), F.ceil(F.col("top.size") / BLOCK).alias("deals"))
    keys = keys.withColumn("lane", F.xxhash64("top", F.pmod(F.xxhash64("key"), F.col("deals")))).drop("deals")
    askers = members.join(keys.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("comp") != F.col("top")))
    askers = askers.select("key", "blocks", "lane", "doc_id", "comp", "size", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("x"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("y"))
    targets = per.join(keys, "key").select("key", "blocks", "lane", F.lit(None).cast("long").alias("doc_id"), "comp", "size", F.explode(F.expr("sequence(0, blocks - 1)")).alias("x"), F.pmod(F.xxhash64("comp"), F.col("blocks")).cast("int").alias("y"))
    rows = askers.unionByName(targets).withColumn("id", F.when(F.col("doc_id").isNotNull() | (F.col("size") == 1), F.coalesce("doc_id", "comp")))
    rows = rows.join(shape.withColumnRenamed("doc_id", "id"), "id", "left").drop("id", "blocks")
    # Keys with the same largest component share a lane (several if it is large): most of their asks are the same.
    asks = rows.groupBy(F.pmod(F.xxhash64("lane", "x", "y"), F.lit(groups)).alias("g")).applyInArrow(_across, _ASKS).distinct()
    return asks.select("doc_id", "comp", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / PART).cast("int") - 1)).alias("part"))


def _answer(left, right):
    """Documents that ask (``left``) and parts of components (``right``) of one group: links found, one for each ask."""
    out = {"a": [], "b": []}
    if left.num_rows and right.num_rows:
        num, den = SIMILARITY
        parts: dict[tuple, list] = {}
        rows = zip(*(right.column(c).to_pylist() for c in ("to", "to_part", "member")), _sketches(right.column("to_sketch")), shingle_sets(right.column("whole").combine_chunks()))
        for comp, part, *member in rows:
            parts.setdefault((comp, part), []).append(member)
        own: dict[int, np.ndarray] = {}
        asks = zip(*(left.column(c).to_pylist() for c in ("doc_id", "comp", "part")), _sketches(left.column("sketch")), shingle_sets(left.column("text").combine_chunks()))
        for doc, comp, part, sketch, s in asks:
            members = parts.get((comp, part), [])
            near = _screened(sketch, np.array([m[1] for m in members]), np.full(len(members), len(s)), np.array([len(m[2]) for m in members])) if members else []
            for k in np.flatnonzero(near):
                other = members[k][2]
                both = len(np.intersect1d(s, other, assume_unique=True))
                if both and den * both >= num * (len(s) + len(other) - both):
                    out["a"].append(doc)
                    out["b"].append(members[k][0])
                    break
    return pa.table(out, schema=_pa("a long, b long"))


def _answered(docs: DataFrame, asks: DataFrame, members: DataFrame) -> DataFrame:
    """Links between asking documents and parts of components, on the full sets; ``members``: doc_id, comp, part, sketch.
    Every text goes to each group that needs it once."""
    asks = staged(asks, "asks")
    wanted = asks.select("comp", "part").distinct()
    groups = max(1, -(-asks.count() // GROUP))
    group = lambda c, p: F.pmod(F.xxhash64(c, p), F.lit(groups)).cast("int").alias("g")
    targets = members.join(wanted, ["comp", "part"])
    ids = staged(asks.select("doc_id").unionByName(targets.select("doc_id")).distinct(), "ids")
    texts = staged(only(docs, ids, "doc_id"), "texts")
    sketches = members.select("doc_id", "sketch")
    left = asks.join(sketches, "doc_id").join(texts, "doc_id").select(group("comp", "part"), "doc_id", "comp", "part", "sketch", "text")
    right = targets.join(texts.toDF("member", "whole"), F.col("doc_id") == F.col("member")).select(group("comp", "part").alias("slot"), F.col("comp").alias("to"), F.col("part").alias("to_part"), "member", F.col("sketch").alias("to_sketch"), "whole")
    return left.groupBy("g").cogroup(right.groupBy("slot")).applyInArrow(_answer, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document.

    ``docs`` needs ``doc_id`` (an integer) and ``text``; other columns are ignored. Null, empty or blank
    texts have an empty set and stay alone. Rows that repeat a ``doc_id`` are one node and share its
    component. A row without ``doc_id`` cannot be linked: its component is null and it is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(docs.mapInArrow(_sign, SIGNED), "signed")
    nodes = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    met = nodes.select("doc_id", "keys").mapInArrow(_meet_locally, MEETING)
    met = met.repartition(F.col("key")).sortWithinPartitions("key", "a").mapInArrow(_meet, MEETING)
    met = staged(met, "met")

    about = nodes.select("doc_id", "n_shingles", "f1", "f2", "sketch")
    side = lambda s: about.select(F.col("doc_id").alias(s), F.col("n_shingles").alias("n" + s), F.col("f1").alias("f1" + s), F.col("f2").alias("f2" + s), F.col("sketch").alias("s" + s))
    star = met.select("a", "b").distinct()
    star = staged(star.join(side("a"), "a").join(side("b"), "b").withColumn("same", F.expr("f1a = f1b AND f2a = f2b AND na = nb")), "star")
    same = star.where("same").select("a", "b")
    tried = star.where("NOT same").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_screen, "a long, b long").distinct()
    tried = staged(tried, "tried")
    links = staged(same.unionByName(_confirmed(docs, tried)), "links")
    comps = components(links, "a", "b")

    # Documents of the candidates with their component, its size, and the part of it that they are in.
    met_docs = met.select("key", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    size = comps.groupBy("component").agg(F.count("*").alias("size"))
    place = met_docs.select("doc_id").distinct().join(comps.join(size, "component").withColumnRenamed("node", "doc_id"), "doc_id", "left")
    place = place.select("doc_id", F.coalesce("component", "doc_id").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    place = place.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / PART)).cast("int"))
    place = staged(place.join(about.dropDuplicates(["doc_id", "f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", "sketch"), "doc_id"), "place")
    asks = _rest(met_docs.join(place.select("doc_id", "comp", "size"), "doc_id"), place.select("doc_id", "n_shingles", "sketch"), max(1, met.count() // BLOCK))
    # A failed try settles an ask only if the component is that one document; the others of a larger one are still open.
    alone = place.where("size = 1").select("doc_id")
    failed = tried.join(alone.toDF("a"), "a", "left_semi").join(alone.toDF("b"), "b", "left_semi")
    asks = asks.join(failed.select("a", "b").unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("doc_id", "comp"), ["doc_id", "comp"], "left_anti")
    more = staged(_answered(docs, asks, place.select("doc_id", "comp", "part", "sketch")), "links")
    comps = merged(comps, more)
    out = signed.select("doc_id", "n_shingles").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
