"""DuckDB SQL of the queries that SQL can express, on the whole tables."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents
), shingles AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM docs
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
    SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach AS r JOIN ways AS w ON w.a = r.b
), low AS (
    SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM docs AS d LEFT JOIN sizes AS s ON s.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

_RATE = """
    SELECT CASE WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 1e-3), size) ELSE size END AS weight, m FROM (
        SELECT m, v - m * (1 - m) * inv AS spread, size FROM (
            SELECT least(greatest(avg({f} / n), 1e-6), 1 - 1e-6) AS m, coalesce(var_samp({f} / n), 0) AS v, avg(1 / n) AS inv, avg(n) AS size FROM hosts))
"""


def host_rules(rules: dict, base_failed: str) -> str:
    priors = ", ".join(f"prior_{k} AS ({_RATE.format(f='fail_' + k)})" for k in rules)
    bad = " OR ".join(f"(({rule}) AND (fail_{k} + prior_{k}.m * prior_{k}.weight) / (n + prior_{k}.weight) > {limit})" for k, (rule, limit) in rules.items())
    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT r, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') AS w FROM docs
), lines AS (
    SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs
), dup_lines AS (
    SELECT r, sum(c - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line) GROUP BY r
), windows AS (
    SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1
), repeated AS (
    SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r
), measured AS (
    SELECT d.r, doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM docs AS d JOIN words AS w ON w.r = d.r LEFT JOIN dup_lines AS l ON l.r = d.r LEFT JOIN repeated AS p ON p.r = d.r
), hosts AS (
    SELECT source, count(*)::DOUBLE AS n, {", ".join(f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END)::DOUBLE AS fail_{k}" for k, (rule, _) in rules.items())} FROM measured GROUP BY source
), {priors}
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base_failed}) AS base_failed, NOT (({base_failed}) OR {bad}) AS kept
FROM measured AS m JOIN hosts AS h ON h.source IS NOT DISTINCT FROM m.source, {", ".join(f"prior_{k}" for k in rules)}
"""

TOP_K = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM whole AS q JOIN whole AS x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

HARD_NEGATIVES = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS alike, coalesce(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM whole AS a JOIN whole AS x ON a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE alike) WHERE place <= 5
), ranked AS (
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives AS p JOIN scored AS s ON s.anchor_id = p.anchor_id AND NOT alike WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


def clusters(k: int, rounds: int) -> str:
    """Plain rounds of all distances, one after the other."""
    def assign(r):
        return f"""assigned{r} AS MATERIALIZED (
    SELECT row, vec_id, v, c AS cluster, d AS distance FROM (
        SELECT row, vec_id, v, c, d, row_number() OVER (PARTITION BY row ORDER BY d, c) AS place FROM (
            SELECT row, vec_id, v, c, list_sum(list_transform(list_zip(v, mid), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, centroids{r})) WHERE place = 1
)"""

    def move(r):
        return f"""sums{r} AS (
    SELECT cluster, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS place FROM assigned{r}) GROUP BY cluster, place
), moved{r} AS (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS mid FROM sums{r} GROUP BY cluster
), centroids{r + 1} AS MATERIALIZED (
    SELECT c.c, coalesce(m.mid, c.mid) AS mid FROM centroids{r} AS c LEFT JOIN moved{r} AS m ON m.cluster = c.c
)"""

    steps = ", ".join(f"{assign(r)}, {move(r)}" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), centroids0 AS MATERIALIZED (
    SELECT place - 1 AS c, v AS mid FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) AS place FROM kept) WHERE place <= {k}
), {steps}, {assign(rounds)}, named AS (
    SELECT c, sha256(array_to_string(mid, ',')) AS centroid_sha256 FROM centroids{rounds}
)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM assigned{rounds} JOIN named ON c = cluster
"""


_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BREAK}'), lambda x: x <> '') AS w FROM documents
), items AS (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BREAK}'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM items WHERE len(w) > 0
), lengths AS (
    SELECT DISTINCT n FROM windows
), spots AS (
    SELECT row, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM docs, lengths WHERE len(w) >= n
), found AS (
    SELECT row, i, s.n, item_id FROM spots AS s JOIN windows AS x ON x.n = s.n AND x.s = s.s
), hits AS (
    SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS word FROM (SELECT DISTINCT row, i, n FROM found)) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT row, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs AS d LEFT JOIN hits AS h ON h.row = d.row LEFT JOIN named AS x ON x.row = d.row
"""
