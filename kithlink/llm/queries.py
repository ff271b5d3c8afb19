"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm import chat, jaccard_join, labelled, line_dedup, mixing, nn_descent, packing, prefix_trie, quality, repair, substring_dedup, threshold_topk, toxicity, url_rules
from kithlink.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
THRESHOLD = 0.3
# fixed values: the listed rules that come before the mined ones
LISTED = [url_rules.Listed("block", "net", "/"), url_rules.Listed("allow", "example.net", "/en/"),
          url_rules.Listed("block", "example.com", "/de/"), url_rules.Listed("allow", "org", "/fr/")]


def _scored(scores: DataFrame, parts: int, held: int) -> DataFrame:
    return scores.select("doc_id", (labelled.remainder("doc_id", parts) == held).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = quality.fit(docs, labels, "quality", labelled.remainder("doc_id", 5) != 0)
    return _scored(quality.score(docs, network), 5, 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, RANKS)


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic", labelled.remainder("doc_id", 4) != 2)
    return _scored(toxicity.score(docs, model), 4, 2)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_targets(table(spark, sf_dir, "documents"), "source")
    return mixed.select("doc_id", "tokens", F.round("rate", 9).alias("rate"), "copies")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", "n_partners", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), LISTED).withColumn("confidence", F.round("confidence", 9))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_nn_descent": op5_nn_descent,
    "op6_threshold_topk": op6_threshold_topk,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_url_rules": op11_url_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op6_threshold_topk": """
        WITH z AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score
          FROM z q JOIN z c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op7_chat": """
        WITH said AS (
          SELECT conv_id, CAST(turn AS BIGINT) AS turn,
                 CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker, coalesce(text, '') AS said
          FROM conversations),
        people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
        rows_ AS (
          SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.said,
                 CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user' END AS shown_as
          FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
        heads AS (
          SELECT *, '<|' || shown_as || CASE WHEN shown_as = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head,
                 said || '<|end|>' || chr(10) AS body
          FROM rows_),
        placed AS (
          SELECT *, length(head || body) AS n,
                 row_number() OVER w - 1 AS seq,
                 coalesce(sum(length(head || body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars_before
          FROM heads WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, said))
        SELECT conv_id, perspective, turn, CAST(seq AS BIGINT) AS seq, shown_as, speaker, head || body AS segment,
               CAST(chars_before AS BIGINT) AS start, CAST(n AS BIGINT) AS length, CAST(chars_before + length(head) AS BIGINT) AS mask_start,
               CAST(CASE WHEN speaker = perspective THEN length(body) ELSE 0 END AS BIGINT) AS mask_length
        FROM placed""",
    "op11_url_rules": """
        WITH rest AS (
          SELECT page_id, url, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS r FROM pages),
        cut AS (
          SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*[?]([^#]*)', 1) AS query
          FROM rest),
        listed(verdict, host, path) AS (
          VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        judged AS (
          SELECT row_number() OVER () AS n, c.*, list_distinct(
                   list_transform(list_filter(string_split(c.host, '.'), lambda t: t <> ''), lambda t: 'host:' || t) ||
                   list_transform(list_filter(string_split(c.path, '/'), lambda t: t <> ''), lambda t: 'path:' || t) ||
                   list_transform(list_filter(list_transform(string_split(c.query, '&'), lambda t: string_split(t, '=')[1]),
                                              lambda t: t <> ''), lambda t: 'query:' || t)) AS tokens
          FROM cut c),
        ruled AS (
          SELECT j.*, best.rule, best.verdict AS said FROM judged j LEFT JOIN (
            SELECT k.n, arg_max(l.host || l.path, length(l.host || l.path)) AS rule, arg_max(l.verdict, length(l.host || l.path)) AS verdict
            FROM judged k JOIN listed l ON (k.host = l.host OR ends_with(k.host, '.' || l.host)) AND starts_with(k.path, l.path)
            GROUP BY k.n) best ON j.n = best.n),
        labelled AS (SELECT n, said, tokens FROM ruled WHERE said IS NOT NULL AND url IS NOT NULL),
        bar AS (SELECT count(*) AS total, ceil(0.01 * count(*)) AS least FROM labelled),
        often AS (
          SELECT t, count(*) AS freq FROM (SELECT unnest(tokens) AS t FROM labelled) GROUP BY t
          HAVING count(*) >= (SELECT least FROM bar)),
        items AS (
          SELECT n, said, list_sort(list(t)) AS held FROM (SELECT n, said, unnest(tokens) AS t FROM labelled) JOIN often USING (t)
          GROUP BY n, said),
        subsets AS (
          SELECT n, said, list_filter(held, lambda t, i: (m >> (i - 1)) & 1 = 1) AS combination
          FROM (SELECT n, said, held, unnest(range(1, 1 << len(held))) AS m FROM items)),
        counted AS (
          SELECT combination, count(*) AS held, count(*) FILTER (said = 'block') AS blocked, count(*) FILTER (said = 'allow') AS allowed
          FROM subsets GROUP BY combination),
        rules AS (
          SELECT combination, verdict, both_ / held AS confidence, both_ / total AS support
          FROM (SELECT combination, held, 'block' AS verdict, blocked AS both_ FROM counted
                UNION ALL SELECT combination, held, 'allow', allowed FROM counted), bar
          WHERE both_ >= least AND both_ > 0 AND both_ / held >= 0.8),
        kept AS (
          SELECT * FROM rules r WHERE NOT EXISTS (
            SELECT 1 FROM rules p WHERE p.verdict = r.verdict AND p.confidence >= r.confidence
              AND len(p.combination) < len(r.combination) AND list_has_all(r.combination, p.combination))),
        met AS (
          SELECT r.n, max(row(k.confidence, k.support, -len(k.combination), k.verdict = 'block', array_to_string(k.combination, ' '))) AS best
          FROM ruled r JOIN kept k ON list_has_all(r.tokens, k.combination) WHERE r.rule IS NULL GROUP BY r.n)
        SELECT page_id, r.host, r.path, r.rule,
               coalesce(r.said, CASE WHEN m.best[4] THEN 'block' ELSE 'allow' END) AS verdict,
               m.best[5] AS combination, round(m.best[1], 9) AS confidence
        FROM ruled r LEFT JOIN met m ON r.n = m.n""",
    "op12_prefix_trie": """
        WITH said AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
          SELECT conv_id, conv_id - conv_id % 5 AS source, count(*) AS own
          FROM said GROUP BY conv_id),
        -- crc32 of short texts, byte by byte and bit by bit
        bits AS (
          WITH RECURSIVE r(conv_id, chars, i, crc) AS (
            SELECT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM convs
            UNION ALL
            SELECT conv_id, chars, i + 1,
                   CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
            FROM (SELECT conv_id, chars, i, CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substr(chars, i // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS x
                  FROM r WHERE i < 8 * length(chars)))
          SELECT conv_id, xor(crc, CAST(4294967295 AS BIGINT)) % 9 AS h FROM r WHERE i = 8 * length(chars)),
        heads AS (
          SELECT c.conv_id, c.own, b.h, c.source, least(b.h, coalesce(s.own, 0)) AS borrowed
          FROM convs c JOIN bits b USING (conv_id) LEFT JOIN convs s ON s.conv_id = c.source),
        steps AS (
          SELECT h.conv_id, s.pos AS depth, s.role, s.text FROM heads h JOIN said s ON s.conv_id = h.source AND s.pos <= h.h
          UNION ALL
          SELECT h.conv_id, h.borrowed + s.pos - h.h, s.role, s.text FROM heads h JOIN said s ON s.conv_id = h.conv_id AND s.pos > h.h),
        paths AS (
          SELECT conv_id, 0 AS depth, '' AS name, 0 AS bytes FROM convs
          UNION ALL
          SELECT conv_id, depth, string_agg(sha256(role) || sha256(text), '') OVER (
                   PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), strlen(text) FROM steps),
        sizes AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY conv_id),
        nodes AS (
          SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                 string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = size) AS ends
          FROM paths JOIN sizes USING (conv_id) GROUP BY depth, name),
        kids AS (
          SELECT n.depth, n.name, count(k.name) AS n_children
          FROM nodes n LEFT JOIN nodes k ON k.depth = n.depth + 1 AND k.name[1:128 * n.depth] = n.name GROUP BY n.depth, n.name),
        sums AS (
          SELECT n.depth, n.name, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
          FROM nodes n JOIN nodes b ON b.depth >= n.depth AND b.name[1:128 * n.depth] = n.name
          JOIN kids k ON k.name = b.name GROUP BY n.depth, n.name)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves,
               CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM nodes n JOIN kids k ON k.name = n.name JOIN sums s ON s.name = n.name
        LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.name = n.name[1:128 * (n.depth - 1)]""",
    "op13_repair": """
        WITH RECURSIVE said AS (
          SELECT row_number() OVER () AS n, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
          FROM conversations),
        -- crc32 of short texts, byte by byte and bit by bit
        bits(key, i, crc) AS (
          SELECT DISTINCT key, 0, CAST(4294967295 AS BIGINT) FROM said
          UNION ALL
          SELECT key, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
          FROM (SELECT key, i, CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substr(key, i // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS x
                FROM bits WHERE i < 8 * length(key))),
        kinds AS (SELECT key, xor(crc, CAST(4294967295 AS BIGINT)) % 20 AS kind FROM bits WHERE i = 8 * length(key)),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM said JOIN kinds USING (key), (VALUES (1), (2)) AS copies(copy)
          WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
        placed AS (
          SELECT *, row_number() OVER w AS pos, left(role, 1) AS initial, lead(left(role, 1)) OVER w AS follower,
                 right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
          FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        faults AS (
          SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM placed)),
        moves(here, role, into_) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        inserts(here, into_, roles) AS (
          VALUES (0, 0, []), (0, 2, ['user:']), (0, 3, ['user:', 'assistant:']), (1, 1, []), (1, 2, ['user:']), (1, 3, ['user:', 'assistant:']),
                 (2, 2, []), (2, 3, ['assistant:']), (3, 3, []), (3, 2, ['user:'])),
        choices AS (
          SELECT conv_id, pos, m AS here, m AS into_, 'D' AS letter, 2 AS cost, CAST([] AS VARCHAR[]) AS line FROM faults, (VALUES (0), (1), (2), (3)) AS t(m)
          UNION ALL
          SELECT conv_id, pos, here, into_, 'K', CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, [f.role || ':' || text]
          FROM faults f JOIN moves m ON f.initial = m.role WHERE fault NOT IN ('blank', 'duplicate')
          UNION ALL
          SELECT conv_id, pos, here, into_, 'R', CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END,
                 [CASE WHEN m.role = 'u' THEN 'user:' ELSE 'assistant:' END || text]
          FROM faults f JOIN moves m ON f.initial <> m.role AND m.role <> 's' WHERE fault NOT IN ('blank', 'duplicate')),
        ways(conv_id, pos, state, cost, audit, lines) AS (
          SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', CAST([] AS VARCHAR[]) FROM faults
          UNION ALL
          SELECT conv_id, pos, state, (best).cost, (best).audit, (best).lines FROM (
            SELECT w.conv_id, c.pos, c.into_ AS state,
                   min({'cost': w.cost + 5 * len(i.roles) + c.cost, 'audit': w.audit || repeat('I', len(i.roles)) || c.letter,
                        'lines': w.lines || i.roles || c.line}) AS best
            FROM ways w JOIN inserts i ON i.here = w.state
            JOIN choices c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.pos = w.pos + 1 AND c.here = i.into_
            GROUP BY w.conv_id, c.pos, c.into_)),
        sizes AS (SELECT conv_id, max(pos) AS size FROM faults GROUP BY conv_id),
        done AS (
          SELECT w.conv_id, min({'cost': w.cost + 5 * len(i.roles), 'audit': w.audit || repeat('I', len(i.roles)), 'lines': w.lines || i.roles}) AS best
          FROM ways w JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.size = w.pos JOIN inserts i ON i.here = w.state AND i.into_ IN (0, 3)
          GROUP BY w.conv_id),
        counts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (follower IS NOT NULL AND initial || follower NOT IN ('su', 'ua', 'au')) AS illegal
          FROM faults GROUP BY conv_id)
        SELECT s.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce((d.best).cost, 0) AS BIGINT) AS cost,
               coalesce((d.best).audit, '') AS audit, sha256(coalesce(array_to_string((d.best).lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) s
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM s.conv_id""",
}
