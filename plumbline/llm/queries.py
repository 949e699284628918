"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, conversations, hard_negatives, html_extract, license_scan, mixing, near_dedup, pii, quality, sharding, token_counts, topk, toxicity
from plumbline.llm.common import table


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer())


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_with_edits(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_of_table(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_table(table(spark, sf_dir, "embeddings"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(table(spark, sf_dir, "conversations"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_near_dedup": op3_near_dedup,
    "op4_pii": op4_pii,
    "op5_token_counts": op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_html": op9_html,
    "op10_topk": op10_topk,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversations": op12_conversations,
    "op13_sharding": op13_sharding,
}

_RULES = " AND ".join([f"{name} >= {least}" for name, least, _ in quality.THRESHOLDS if least is not None] + [f"{name} <= {most}" for name, _, most in quality.THRESHOLDS if most is not None])

_USER, _OTHER = "chr(10) || 'user:'", "chr(10) || 'assistant:'"


def _step(state: str, cost: int | str, edit: str, row: str) -> str:
    """SQL of a state, a list of padded cost with audit and repaired text, after one more edit."""
    return f"list_transform([{state}], lambda z: CASE WHEN z IS NOT NULL THEN [lpad(CAST(CAST(z[1][1:6] AS BIGINT) + {cost} AS VARCHAR), 6, '0') || z[1][7:] || '{edit}', z[2] || {row}] END)[1]"


ORACLES: dict[str, str] = {
    "op7_quality": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 3)) AS k FROM r) GROUP BY doc_id),
        m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                     CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS lines,
                     len(list_filter(w, lambda x: list_contains({quality.STOP_WORDS}, lower(x)))) AS stops,
                     length(t) - length(replace(t, '|', '')) AS pipes, (length(t) - length(replace(t, '!!', ''))) / 2 AS shouts
              FROM w LEFT JOIN c USING (doc_id)),
        x AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
                     CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
                     CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio,
                     CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_ratio,
                     CASE WHEN lines > 0 THEN n_dup_lines / lines ELSE 0.0 END AS dup_line_ratio,
                     CASE WHEN n_words > 0 THEN stops / n_words ELSE 0.0 END AS stop_ratio,
                     CASE WHEN n_words > 0 THEN pipes / n_words ELSE 0.0 END AS pipe_ratio,
                     CASE WHEN n_words > 0 THEN shouts / n_words ELSE 0.0 END AS shout_ratio,
                     n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
              FROM m)
        SELECT *, NOT base_failed AND {_RULES} AS kept FROM x
    """,
    "op10_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS "rank", vec_id, score FROM r WHERE k <= 10
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS k
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM n WHERE k <= 5
    """,
    # crc32 by its shift register over the bytes of the key; then one step a row, keeping for each state the best that leads to it
    "op12_conversations": rf"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        b AS (SELECT *, flatten(list_transform(string_split(k, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS b FROM c),
        h AS (SELECT *, xor(list_reduce(b, lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS d FROM b),
        d AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM (SELECT *, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) FROM h WHERE d <> 0)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM d),
        f AS (SELECT *, substring(role, 1, 1) AS x, chr(10) || role || ':' || text AS line, chr(10) || 'user:' || text AS user_line, chr(10) || 'assistant:' || text AS other_line,
                     CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault FROM o),
        n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                     count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM f GROUP BY conv_id),
        g AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS p FROM f) WHERE p NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
        -- a state is [cost and audit, repaired rows], or null; e: nothing stays yet; s, u, a: the initial that stays last
        w AS (
            SELECT conv_id, 0::BIGINT AS i, ['000000', ''] AS e, NULL::VARCHAR[] AS s, ['000002I', {_USER}] AS u, ['000004II', {_USER} || {_OTHER}] AS a FROM n
            UNION ALL
            SELECT conv_id, i, e, s, list_min([u, {_step('a', 2, 'I', _USER)}]), list_min([a, {_step('u', 2, 'I', _OTHER)}])
            FROM (SELECT conv_id, i, e, s, list_min([u, {_step('s', 2, 'I', _USER)}, {_step('e', 2, 'I', _USER)}]) AS u, a
                  FROM (SELECT f.conv_id, f.i, {_step('e', 3, 'D', "''")} AS e,
                               list_min([{_step('s', 3, 'D', "''")}, CASE WHEN stays AND x = 's' THEN {_step('e', 'cut', 'K', 'line')} END]) AS s,
                               list_min([{_step('u', 3, 'D', "''")}, CASE WHEN stays AND x = 'u' THEN {_step('list_min([e, s, a])', 'cut', 'K', 'line')} END,
                                         CASE WHEN stays THEN {_step('list_min([e, s, a])', '2 + cut', 'R', 'user_line')} END]) AS u,
                               list_min([{_step('a', 3, 'D', "''")}, CASE WHEN stays AND x = 'a' THEN {_step('u', 'cut', 'K', 'line')} END, CASE WHEN stays THEN {_step('u', '2 + cut', 'R', 'other_line')} END]) AS a
                        FROM w JOIN (SELECT *, fault IN ('o', 't') AS stays, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut FROM f) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
        l AS (SELECT n.*, list_min([w.e, w.a]) AS best FROM n JOIN w ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.n)
        SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(CAST(best[1][1:6] AS BIGINT), 0) AS cost, coalesce(best[1][7:], '') AS audit, sha256(coalesce(substring(best[2], 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM t.conv_id
    """,
}
