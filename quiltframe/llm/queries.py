"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, exact_dedup, lexical, lines, minhash, mixing, packing, quality, repeats, sharding, simhash, tokens
from .common import table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    shared = repeats.held(F.col("shared")).alias("n_shared"), F.size("shared").cast("long").alias("n_passages")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *shared)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), width=2)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.preference_pairs(chat.off_topic_pairs(table(spark, sf_dir, "conversations")))
    span = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return pairs.select(
        "conv_id",
        F.size("chosen").cast("long").alias("chosen_turns"),
        F.size("rejected").cast("long").alias("rejected_turns"),
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        F.length("prompt").cast("long").alias("prompt_chars"),
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen_completion", 256).alias("chosen_sha256"),
        F.sha2("rejected_completion", 256).alias("rejected_sha256"),
        span("chosen_spans").alias("chosen_spans"),
        span("rejected_spans").alias("rejected_spans"),
    )


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id, max(i) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS last FROM t GROUP BY conv_id
), reply AS (
  SELECT xor(l.conv_id, 1) AS conv_id, t.role, t.text FROM last l JOIN t ON t.conv_id = l.conv_id AND t.i = l.last
), rejected AS (
  SELECT t.conv_id, t.i, t.role, t.text FROM t JOIN last l USING (conv_id) WHERE l.last IS NULL OR t.i < l.last
  UNION ALL
  SELECT l.conv_id, l.last, r.role, r.text FROM last l JOIN reply r USING (conv_id) WHERE l.last IS NOT NULL
), same AS (
  SELECT l.conv_id, coalesce(min(CASE WHEN c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN coalesce(c.i, r.i) END) - 1, max(coalesce(c.i, r.i))) AS prompt_turns
  FROM t c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.i = r.i
  JOIN last l ON l.conv_id = coalesce(c.conv_id, r.conv_id) GROUP BY l.conv_id
), sides AS (
  SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r' AS side, * FROM rejected
), pieces AS (
  SELECT side, conv_id, i, i > prompt_turns AS tail, role,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece, length(role) + 13 AS head,
         length(role) + length(text) + 24 AS whole
  FROM sides JOIN same USING (conv_id)
), placed AS (
  SELECT *, sum(whole) OVER (PARTITION BY side, conv_id, tail ORDER BY i) - whole AS pos FROM pieces
), done AS (
  SELECT side, conv_id, count(*) AS turns,
         coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE NOT tail), '') AS prompt,
         coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE tail), '') AS completion,
         coalesce(string_agg((pos + head)::BIGINT || '-' || (pos + whole - 1)::BIGINT, ',' ORDER BY i) FILTER (WHERE tail AND role = 'assistant'), '') AS spans
  FROM placed GROUP BY side, conv_id
)
SELECT c.conv_id, c.turns AS chosen_turns, coalesce(r.turns, 0) AS rejected_turns, s.prompt_turns,
       length(c.prompt) AS prompt_chars, sha256(c.prompt) AS prompt_sha256, sha256(c.completion) AS chosen_sha256,
       sha256(coalesce(r.completion, '')) AS rejected_sha256, c.spans AS chosen_spans, coalesce(r.spans, '') AS rejected_spans
FROM done c JOIN same s USING (conv_id) LEFT JOIN done r ON r.conv_id = c.conv_id AND r.side = 'r' WHERE c.side = 'c'
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS m FROM s UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.m) AS component_id, s.doc_id = min(r.m) AS kept
FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), c AS (
  SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS words FROM d
), t AS (
  SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d
), f AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY r, doc_id, n, term
), g AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, docs
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words)))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN g USING (term), c GROUP BY item_id, r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""

OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source FROM d GROUP BY lang, source
), m AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(m.total, 0)::HUGEINT + 5 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN m USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), l AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // ((SELECT sum(total) FROM m WHERE m.lang = c.lang)::HUGEINT + 5 * any_value(v.v)) AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - l.q)::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q
), a AS (
  SELECT * FROM pairs UNION ALL SELECT * FROM terms
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM a QUALIFY part = 'pair' OR rank <= 50
"""

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {LOWER}) AS key FROM l
), common AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (common.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common ON common.key = k.key GROUP BY r, doc_id
"""

QUERIES = {f.__name__: f for f in (op1_repeats, op2_mix, op3_quality, op4_packing, op5_simhash, op6_tokens, op7_near_dedup, op8_exact_dedup, op9_sharding, op10_chat, op11_search, op12_divergence, op13_lines)}
ORACLES = {"op7_near_dedup": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op10_chat": OP10_SQL, "op11_search": OP11_SQL, "op12_divergence": OP12_SQL, "op13_lines": OP13_SQL}
