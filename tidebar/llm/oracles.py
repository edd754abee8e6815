"""DuckDB SQL of the training-data queries that SQL can express, written from what they promise and not from how they work.

Pairs are compared directly, components are closures of the links, and byte strings are grouped as they are; nothing of
the operators' candidate search, hashing or planning is repeated. Only parameters (rules, levels, shard count) are shared.
"""

from __future__ import annotations

from . import quality, sharding

#: Words as the queries take them; the expression ``{0}`` is a text.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: 256 remainders of the reflected CRC-32 polynomial, one per byte value.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b))"


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text that isn't null; the table is the column ``crc``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def embedding_neardup(threshold: float) -> str:
    return f"""
    WITH RECURSIVE v AS MATERIALIZED (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {threshold}),
    reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(w.component_id, e.vec_id) AS component_id,
           e.vec_id IS NOT DISTINCT FROM coalesce(w.component_id, e.vec_id) AS kept
    FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN degree d ON e.vec_id = d.a LEFT JOIN low w ON e.vec_id = w.a"""


def shingle_neardup(k: int, percent: int) -> str:
    return f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    sets AS MATERIALIZED (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) END AS s FROM w),
    flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM flat a JOIN flat b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    one AS (SELECT a, b FROM common WHERE 100 * c >= {percent} * (na + nb - c)),
    links AS MATERIALIZED (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
    reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, low.component_id, s.doc_id IS NOT DISTINCT FROM low.component_id AS kept
    FROM sets s LEFT JOIN low ON s.doc_id = low.a"""


def jump_shards(n_shards: int) -> str:
    return f"""
    WITH RECURSIVE tab AS (SELECT {_CRC_TABLE} AS crc),
    ids AS MATERIALIZED (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents),
    jumps(id, s, b, j) AS (
        SELECT id, (CASE WHEN id < 0 THEN id::HUGEINT + 18446744073709551616 ELSE id::HUGEINT END)::UHUGEINT, -1::BIGINT, 0::BIGINT FROM ids
        UNION ALL
        SELECT id, s, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((s // 8589934592::UHUGEINT)::BIGINT + 1)::DOUBLE))::BIGINT
        FROM (SELECT id, (s * {sharding.MULTIPLIER}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS s, j FROM jumps WHERE j <= {n_shards})),
    shards AS (SELECT id, max(b) FILTER (WHERE b < {n_shards})::INTEGER AS shard, max(b)::INTEGER AS grown_shard FROM jumps GROUP BY id),
    rows AS (
        SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size, {_crc32("coalesce(text, '')")} AS text_crc32, shard, grown_shard
        FROM documents JOIN shards ON coalesce(doc_id, 0) = id, tab)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 2), doc_id, text_crc32, size) - 1 AS slot, grown_shard
    FROM rows"""


def repeated_bytes(length: int) -> str:
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    starts AS (SELECT r, h, unnest(range(length(h) // 2 - {length - 1})) AS p FROM d WHERE length(h) >= {2 * length}),
    strings AS MATERIALIZED (SELECT r, p, md5_number(substr(h, 2 * p + 1, {2 * length})) AS m FROM starts),
    twice AS (SELECT r, p FROM strings JOIN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1) USING (m)),
    marked AS (SELECT r, p, p > lag(p) OVER (PARTITION BY r ORDER BY p) + {length} AS fresh FROM twice),
    numbered AS (SELECT r, p, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
    runs AS MATERIALIZED (SELECT r, run, min(p) AS lo, max(p) + {length} AS hi FROM numbered GROUP BY r, run),
    edges AS (
        SELECT r, hi AS a, lead(lo) OVER (PARTITION BY r ORDER BY lo) AS z FROM runs UNION ALL SELECT r, 0, min(lo) FROM runs GROUP BY r),
    kept AS (
        SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, length(h) // 2) - a)), '' ORDER BY a) AS k FROM edges JOIN d USING (r) GROUP BY r),
    sums AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(k, h))) AS kept_sha256
    FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)"""


def quality_rules() -> str:
    rules = ", ".join(f"({i}, {stat.replace(' div ', ' // ')}, {cuts})" for i, (stat, cuts) in enumerate(quality.RULES.values()))
    p, cost = quality.ALPHA, quality.COST
    return rf"""
    WITH tab AS (SELECT {_CRC_TABLE} AS crc),
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    triples AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
    again AS (SELECT r, unnest(places) AS i FROM (SELECT r, w[i:i + 2] AS x, list(i) AS places FROM triples GROUP BY r, x HAVING count(*) > 1)),
    covered AS (SELECT r, count(DISTINCT i + o) AS n FROM again, range(3) u(o) GROUP BY r),
    lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    f AS MATERIALIZED (
        SELECT r, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
               len(l)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
        FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)),
    g AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
    stats AS MATERIALIZED (SELECT r, v.rule, v.stat, v.cuts FROM g, LATERAL (VALUES {rules}) v(rule, stat, cuts)),
    labelled AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality) AND min(quality) IN (0, 1)),
    own AS MATERIALIZED (SELECT r, lang, good, {_crc32("doc_id::VARCHAR")} % 2 AS half FROM g JOIN labelled USING (doc_id), tab WHERE NOT base_failed),
    gains AS (
        SELECT lang, rule, cut, sum(CASE WHEN good = 1 THEN -{cost} ELSE 1 END) FILTER (WHERE stat > cut) AS gain
        FROM (SELECT lang, good, rule, stat, unnest(cuts) AS cut FROM own JOIN stats USING (r) WHERE half = 0) GROUP BY ALL),
    best AS (SELECT lang, rule, max(gain) AS gain, arg_max(cut, gain * 1000000 + cut) AS cut FROM gains WHERE gain > 0 GROUP BY lang, rule),
    path AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, rule) AS place FROM best),
    firsts AS (
        SELECT o.r, o.lang, min(place) FILTER (WHERE stat > cut) AS first
        FROM own o JOIN path p ON o.lang IS NOT DISTINCT FROM p.lang JOIN stats s ON s.r = o.r AND s.rule = p.rule WHERE half = 1 AND good = 1 GROUP BY ALL),
    joint AS (
        SELECT p.lang, p.rule, p.cut, p.place, count(*) AS n, count(*) FILTER (WHERE first <= p.place) AS k
        FROM path p JOIN firsts f ON p.lang IS NOT DISTINCT FROM f.lang GROUP BY ALL),
    tails AS (
        SELECT *, list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) AS tail FROM joint),
    certified AS (
        SELECT * FROM (SELECT *, bool_and(tail <= {quality.DELTA} / (SELECT count(DISTINCT coalesce('s' || lang, 'null')) FROM path)) OVER (PARTITION BY lang ORDER BY place) AS ok FROM tails) WHERE ok),
    rejected AS (SELECT DISTINCT g.r FROM g JOIN certified c ON g.lang IS NOT DISTINCT FROM c.lang JOIN stats s ON s.r = g.r AND s.rule = c.rule WHERE stat > cut)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM rejected) AS kept FROM g"""
