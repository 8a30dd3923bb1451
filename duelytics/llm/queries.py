"""The registered queries of this package, each over the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duelytics.llm import (
    anchors, bpe, dart_minhash, divergence, isolation, licenses, line_runs, mixing, repeats, templates, turn_repair,
    voronoi, weak_labels,
)
from duelytics.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    """The byte-level vocabulary; TOKENIZER_FILE names another one."""
    import public_tokenizers

    return os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.dedup(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.rule_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.audit(table(spark, sf_dir, "conversations"))


def op12_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.near_copies(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_mix": op2_mix,
    "op3_lines": op3_lines,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_licenses": op5_licenses,
    "op6_top_k": op6_top_k,
    "op7_rules": op7_rules,
    "op8_repeats": op8_repeats,
    "op9_html": op9_html,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair,
    "op12_anchors": op12_anchors,
    "op13_divergence": op13_divergence,
}

# The same rows by DuckDB. The mix is dealt quotient by quotient instead of by a divisor.
OP2 = f"""
WITH sizes AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        md5('mix|' || coalesce(doc_id::VARCHAR, '\\N') || '|' || coalesce(text, '\\N')) AS tag
    FROM documents
), summed AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS rows FROM sizes GROUP BY source),
weighed AS (
    SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place,
        [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight
    FROM summed
), levels AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER filled, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER filled, 0.0)) AS level
    FROM weighed
    WINDOW filled AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT *, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM levels
), quotients AS (
    SELECT source, place, target / (2 * k + 1) AS quotient
    FROM targets, unnest(range(0, ceil(2 * source_size / {mixing.BLOCK})::BIGINT + 1)) AS t(k)
), ranked AS (
    SELECT place, row_number() OVER (ORDER BY quotient DESC, place) AS at FROM quotients WHERE quotient > 0
), quotas AS (
    SELECT t.source, t.place, t.source_size, t.target, (
        SELECT count(*) FROM ranked r WHERE r.place = t.place
            AND r.at <= (SELECT floor(1.5::DOUBLE * sum(source_size) / {mixing.BLOCK} + 0.5) FROM targets)) AS quota,
        greatest(1, ceil(t.source_size / {mixing.SHARD}), ceil(t.rows / {mixing.SHARD_ROWS}))::BIGINT AS shards
    FROM targets t
), dealt AS (
    SELECT s.doc_id, s.size, s.tag, q.*, ('0x' || substr(s.tag, 1, 8))::BIGINT % q.shards AS shard
    FROM sizes s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), shard_sizes AS (
    SELECT place, shard, sum(size)::BIGINT AS shard_size, max(quota) AS quota FROM dealt GROUP BY place, shard
), shard_ranks AS (
    SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY shard_size / (2 * k + 1) DESC, shard) AS at
    FROM shard_sizes, unnest(range(0, ceil(2 * shard_size / {mixing.BLOCK})::BIGINT + 2)) AS t(k)
), shard_quotas AS (
    SELECT s.place, s.shard, s.shard_size, (
        SELECT count(*) FROM shard_ranks r WHERE r.place = s.place AND r.shard = s.shard AND r.at <= s.quota) AS quota
    FROM shard_sizes s
), laid AS (
    SELECT d.doc_id, d.size, d.source, d.source_size, d.target, d.shard, q.shard_size, q.quota,
        greatest(1, ceil(q.shard_size / {mixing.BLOCK}))::BIGINT AS blocks,
        sum(d.size) OVER (PARTITION BY d.place, d.shard ORDER BY ('0x' || substr(d.tag, 9, 15))::BIGINT,
            d.doc_id::VARCHAR, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
    FROM dealt d JOIN shard_quotas q ON d.place = q.place AND d.shard = q.shard
), asked AS (
    SELECT *, stop - size AS start, least(quota * {mixing.BLOCK}, 2 * shard_size)::BIGINT AS words,
        {mixing.BLOCK} * (('0x' || substr(md5('mix|first|' || coalesce(source, '\\N') || '|' || shard), 1, 8))::BIGINT
            % blocks) AS first
    FROM laid
), placed AS (
    SELECT *, words // greatest(1, shard_size) AS passes, words % greatest(1, shard_size) AS rest FROM asked
)
SELECT doc_id, size, source_size, target, (passes * size
    + greatest(0, least(stop, first + rest) - greatest(start, first))
    + greatest(0, least(stop, first + rest - shard_size) - greatest(start, 0)))::BIGINT AS taken
FROM placed
"""

OP3 = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= {line_runs.MIN_CHARS}
    GROUP BY key HAVING count(DISTINCT doc_id) >= {line_runs.MIN_DOCS}
), marked AS (
    SELECT k.*, s.key IS NOT NULL AND s.top <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6 = f"""
WITH whole AS (
    SELECT vec_id, [floor({voronoi.SCALE} * x::DOUBLE) for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
    FROM whole q JOIN whole d ON q.vec_id % {voronoi.EVERY} = 0 AND q.vec_id <> d.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {voronoi.K}
"""

# The checksum is computed bit by bit; the path keeps the letters themselves instead of numbers.
OP11 = """
WITH RECURSIVE damaged AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(
        [4294967295::BIGINT] || flatten(list_transform(
            range(1, length(key) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(key[i]) >> b) & 1))),
        lambda crc, bit: xor(crc >> 1, 3988292384 * ((xor(crc, bit)) & 1))) AS crc
    FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)
), fates AS (SELECT *, xor(crc, 4294967295) % 20 AS fate FROM damaged),
rows_left AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM fates WHERE fate <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS place,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
    FROM rows_left
), faulty AS (
    SELECT conv_id, turn, role, text, place, substr(role, 1, 1) AS initial, CASE
        WHEN trimmed = '' THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
        WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS previous
    FROM placed
), reports AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM faulty GROUP BY conv_id
), steps(state, written, behind) AS (
    VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')
), insertions AS (
    SELECT DISTINCT state AS here, state AS there, '' AS letters, 0 AS cost, []::VARCHAR[] AS added FROM (
        SELECT state FROM steps UNION SELECT behind FROM steps)
    UNION ALL
    SELECT state, behind, 'I', 3, [CASE written WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM steps WHERE written <> 's'
), moves AS (
    SELECT f.conv_id, f.place, i.here, i.there AS behind, i.letters || 'D' AS letters, i.cost + 4 AS cost, i.added
    FROM faulty f, insertions i
    UNION ALL
    SELECT f.conv_id, f.place, i.here, s.behind, i.letters || 'K', i.cost + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END,
        list_append(i.added, f.role || ':' || f.text)
    FROM faulty f, insertions i JOIN steps s ON s.state = i.there
    WHERE f.fault NOT IN ('blank', 'duplicate') AND s.written = f.initial
    UNION ALL
    SELECT f.conv_id, f.place, i.here, s.behind, i.letters || 'R', i.cost + 3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END,
        list_append(i.added, CASE s.written WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text)
    FROM faulty f, insertions i JOIN steps s ON s.state = i.there
    WHERE f.fault NOT IN ('blank', 'duplicate') AND s.written <> 's'
), walk AS (
    SELECT conv_id, 0::BIGINT AS place, '' AS state, 0 AS cost, '' AS letters, []::VARCHAR[] AS lines FROM reports
    UNION ALL
    SELECT conv_id, place, state, cost, letters, lines FROM (
        SELECT w.conv_id, m.place, m.behind AS state, w.cost + m.cost AS cost, w.letters || m.letters AS letters,
            w.lines || m.added AS lines, row_number() OVER (
                PARTITION BY w.conv_id, m.behind ORDER BY w.cost + m.cost, w.letters || m.letters) AS best
        FROM walk w JOIN moves m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.place = w.place + 1 AND m.here = w.state
    ) WHERE best = 1
), ended AS (
    SELECT w.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, w.cost + i.cost AS cost,
        w.letters || i.letters AS audit, w.lines || i.added AS lines, row_number() OVER (
            PARTITION BY w.conv_id ORDER BY w.cost + i.cost, w.letters || i.letters) AS best
    FROM walk w JOIN reports r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.place = r.n
    JOIN insertions i ON i.here = w.state WHERE i.there IN ('', 'a')
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND best = 1
"""

OP13 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents
), words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (
    SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL),
cells AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n
    FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY lang, source),
priced AS (
    SELECT c.lang, c.source, c.term, c.n, 1 + ({divergence.SCALE}::HUGEINT * (c.n + 5)) // (t.total + 5 * l.v) AS p,
        1 + ({divergence.SCALE}::HUGEINT * (c.lang_n + 5)) // (l.total + 5 * l.v) AS q
    FROM cells c JOIN totals t ON c.lang = t.lang AND c.source = t.source JOIN langs l ON c.lang = l.lang
), pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (
        SELECT coalesce(sum(abs(x.p - y.p)), 0)::BIGINT FROM priced x JOIN priced y
            ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), term AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM priced WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
    FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
) WHERE part = 'pair' OR rank <= {divergence.SHOWN}
"""

ORACLES: dict[str, str] = {"op2_mix": OP2, "op3_lines": OP3, "op6_top_k": OP6, "op11_repair": OP11, "op13_divergence": OP13}
