"""One query for each operator of this subpackage, over its whole table with production parameters, and its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholargraph.llm import collocations, conversation_trie, decontaminate, host_rules, licences, line_spread, packing, quality_fm, run_index, sharding, simhash, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op4_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(_table(spark, sf_dir, "documents"))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove_spread_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.remove_matches(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines
  FROM base
), win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), stats AS (
  SELECT words.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN rep ON rep.doc_id = words.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source
), overall AS (
  SELECT sum(n) AS n, count(*) AS h, sum(f) / sum(n) AS m FROM hosts
), between_hosts AS (
  SELECT any_value(o.m) AS m, sum(hosts.n * (f / hosts.n - o.m) * (f / hosts.n - o.m)) / any_value(o.n)
         - any_value(o.m) * (1 - any_value(o.m)) * any_value(o.h) / any_value(o.n) AS v FROM hosts, overall o
), prior AS (
  SELECT m, CASE WHEN m > 0 AND m < 1 AND v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1e6) ELSE 1e6 END AS s FROM between_hosts
), rates AS (
  SELECT source, (f + s * m) / (n + s) AS host_rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_rate, 0) <= 0.5 AS kept, round(host_rate, 6) AS host_rate
FROM judged LEFT JOIN rates ON rates.source = judged.source
"""

OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, pos, raw, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
               unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)
), boiler AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines
  WHERE len(string_split(line, ' ')) >= 3 GROUP BY line HAVING count(DISTINCT source) >= 8
), marked AS (
  SELECT l.doc_id, l.pos, l.raw, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone
  FROM lines l LEFT JOIN boiler b ON b.line = l.line
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), phrases AS (
  SELECT lang, m, w[i : i + m - 1] AS p, count(*) AS f FROM places, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), cuts AS (
  SELECT q.lang, q.m, q.p, q.f AS a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * q.f // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM phrases) q JOIN phrases x ON x.lang = q.lang AND x.p = q.p[1:k] JOIN phrases y ON y.lang = q.lang AND y.p = q.p[k + 1:q.m]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inside AS (
  SELECT lang, p[s : s + k - 1] AS p, max(f) AS most FROM (SELECT lang, m, p, f, k, unnest(range(1, m - k + 2)) AS s FROM phrases, (SELECT unnest([2, 3]) AS k) WHERE k < m) GROUP BY ALL
), left_over AS (
  SELECT c.*, array_to_string(c.p, ' ') AS phrase FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.p = c.p WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over
)
SELECT r.lang, r.rank, phrase, a, l, r.r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), keyed AS (
  SELECT c, turn, substr(sha256(strlen(r) || ':' || r || x), 1, 32) AS k,
         CAST(len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS w FROM t
), ordered AS (
  SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS i FROM keyed
), h AS (  -- crc32, bit by bit
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
         lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
           lambda v, u: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM keyed)
), rebuilt AS (
  SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d FROM (
    SELECT h.c, k, w, 0 AS own, i FROM h JOIN ordered o ON o.c = h.c - h.c % 20 AND i <= h
    UNION ALL SELECT h.c, k, w, 1, i FROM h JOIN ordered o ON o.c = h.c AND i > h)
), paths AS (
  SELECT c, d, w, string_agg(k, '/') OVER (PARTITION BY c ORDER BY d) AS p FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM h
), lengths AS (
  SELECT c, max(d) AS len FROM paths GROUP BY c
), nodes AS (
  SELECT p, d, min(paths.c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(paths.c::VARCHAR, ',' ORDER BY paths.c) FILTER (WHERE len = d), '')) AS ends_sha256
  FROM paths JOIN lengths ON lengths.c = paths.c GROUP BY p, d
), families AS (
  SELECT n.*, left(p, greatest(33 * (d - 1) - 1, 0)) AS up, EXISTS (SELECT 1 FROM nodes m WHERE m.d = n.d + 1 AND left(m.p, greatest(33 * n.d - 1, 0)) = n.p) AS inner_node FROM nodes n
), children AS (
  SELECT up, d - 1 AS d, count(*) AS n FROM families WHERE d > 0 GROUP BY ALL
), under AS (
  SELECT a AS d, left(p, greatest(33 * a - 1, 0)) AS p, count(*) FILTER (WHERE NOT inner_node) AS n_leaves, sum((n_convs - 1) * w) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM families) GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM families f LEFT JOIN nodes q ON q.d = f.d - 1 AND q.p = f.up LEFT JOIN children c ON c.d = f.d AND c.up = f.p JOIN under u ON u.d = f.d AND u.p = f.p
"""


def queries() -> dict:
    return {
        "op1_quality_fm": op1_quality_fm,
        "op2_toxicity": op2_toxicity,
        "op3_suffix_decontamination": op3_suffix_decontamination,
        "op4_simhash_gph": op4_simhash_gph,
        "op5_host_rules": op5_host_rules,
        "op6_line_spread": op6_line_spread,
        "op7_prefix_shards": op7_prefix_shards,
        "op8_genetic_packing": op8_genetic_packing,
        "op9_phrase_automata": op9_phrase_automata,
        "op10_licence_scan": op10_licence_scan,
        "op11_collocations": op11_collocations,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_run_index": op13_run_index,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_host_rules": OP5_SQL, "op6_line_spread": OP6_SQL, "op11_collocations": OP11_SQL, "op12_conversation_trie": OP12_SQL}
