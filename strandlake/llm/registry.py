"""Queries on the corpus tables: one per operator, with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import alignment, chat, conversation_repair, decontaminate, fingerprints, language_id, ngram_join, quality, substring_dedup, token_counts, topk, warc, word_bpe
from strandlake.llm.shared import table


def op1_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs)).drop("proportions")


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(table(spark, sf_dir, "documents"))


def op6_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_digests(rows.unionByName(probe))


def op11_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_fm_dedup": op1_fm_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_bradley_terry": op3_bradley_terry,
    "op4_language_mixture": op4_language_mixture,
    "op5_word_bpe": op5_word_bpe,
    "op6_dual_tree_top_k": op6_dual_tree_top_k,
    "op7_warc": op7_warc,
    "op8_jaccard_components": op8_jaccard_components,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_format": op10_chat_format,
    "op11_weighted_fingerprints": op11_weighted_fingerprints,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}
#: floor(256 x) as doubles are whole numbers, and their sums are exact.
_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
      FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b)) AS keep FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (j // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - j % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM d
"""
_DECONTAMINATE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS t FROM (
  SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS t FROM (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM w, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, s, dw.size FROM dw JOIN iw ON dw.size = iw.size AND dw.t = iw.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
_JACCARD = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, o) AS (SELECT x, x FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.o),
m AS (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.o, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
_REPEATS = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS o FROM x) WHERE o < doc_id),
c AS (SELECT doc_id, list_distinct(list(j)) AS js FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM f) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS j FROM w) b
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(js) AS j FROM c) d WHERE d.doc_id = b.doc_id AND d.j = b.j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
_CHAT = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(20 + length(role || text) + len(regexp_extract_all(role || text, '[\\\\<\\[]'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
#: The programme over explicit edit lists: at most four of them a turn, each the cheapest and ASCII-least of its state (0 nothing, 1 system, 2 user, 3 assistant last).
_REPAIR = """
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
crc AS (SELECT c.conv_id, c.turn, coalesce(c.role, ' ') AS role, coalesce(c.text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(c.turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda h, b: xor(h >> 8, tab.tab[1 + (xor(h, b) & 255)])), 4294967295) % 20 AS way FROM conversations c, tab),
dam AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(0, CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE way <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM dam),
d AS (SELECT conv_id, pos, turn, role, text, role[1] AS i, last AS l, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS two
  FROM (SELECT *, regexp_extract(text, '(?s)([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM ord)),
runs(state, code, after, put) AS (VALUES (0, '', 0, []), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']), (1, '', 1, []), (1, 'I', 2, ['user:']), (1, 'II', 3, ['user:', 'assistant:']),
  (2, '', 2, []), (2, 'I', 3, ['assistant:']), (2, 'II', 2, ['assistant:', 'user:']), (3, '', 3, []), (3, 'I', 2, ['user:']), (3, 'II', 3, ['user:', 'assistant:'])),
edits(code, cost) AS (VALUES ('D', 3), ('K', 0), ('R', 2)),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, 0::BIGINT AS cost, '' AS list, CAST([] AS VARCHAR[]) AS made FROM d
  UNION ALL SELECT conv_id, pos, state, cost, list, made FROM (
    SELECT d.conv_id, d.pos, CASE WHEN e.code = 'D' THEN runs.after WHEN e.code = 'K' THEN CASE WHEN i = 's' THEN 1 WHEN i = 'u' THEN 2 ELSE 3 END WHEN runs.after = 2 THEN 3 ELSE 2 END AS state,
      r.cost + 2 * length(runs.code) + e.cost + CASE WHEN fault = 3 AND e.code <> 'D' THEN 1 ELSE 0 END AS cost, r.list || runs.code || e.code AS list,
      list_concat(list_concat(r.made, runs.put), CASE e.code WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN runs.after = 2 THEN 'assistant:' ELSE 'user:' END || text] END) AS made
    FROM r JOIN d ON d.conv_id = r.conv_id AND d.pos = r.pos + 1 JOIN runs ON runs.state = r.state CROSS JOIN edits e
    WHERE e.code = 'D' OR (fault NOT IN (1, 2) AND (e.code = 'R' OR (i = 's' AND runs.after = 0) OR (i = 'u' AND runs.after <> 2) OR (i = 'a' AND runs.after = 2))))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, list) = 1),
n AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id),
z AS (SELECT r.conv_id, r.cost + 2 * length(runs.code) AS cost, r.list || runs.code AS list, list_concat(r.made, runs.put) AS made FROM r JOIN n ON r.conv_id = n.conv_id AND r.pos = n.n JOIN runs ON runs.state = r.state AND runs.after IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY r.conv_id ORDER BY r.cost + 2 * length(runs.code), r.list || runs.code) = 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(list, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id) LEFT JOIN z USING (conv_id)
"""
ORACLES: dict[str, str] = {"op1_fm_dedup": _REPEATS, "op6_dual_tree_top_k": _TOP_K, "op7_warc": _WARC, "op8_jaccard_components": _JACCARD, "op9_decontaminate": _DECONTAMINATE, "op10_chat_format": _CHAT, "op13_conversation_repair": _REPAIR}
