"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, bytebpe, embeddings, html, minhash, mixing, quality, sharding, suffixdedup, tokencount
from .scratch import Scratch

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores: a table too small to give each core a task's bytes is dealt out first, as its file may be one row group."""
    spark = rows.sparkSession
    cores, task = spark.sparkContext.defaultParallelism, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows if size >= cores * task else rows.repartition(cores)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html.main_texts(spark, table(spark, sf_dir, "pages"))
    return made.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = tokencount.with_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return made.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = automaton.remove_repeated_words(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc.doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffixdedup.remove_repeated_bytes(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc.doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.document_shards(spark, table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.quality_weight(F.col("text")).alias("quality"))
    narrow = Scratch(spark, "mix-sizes").save(narrow, "documents")
    made = mixing.mix(spark, narrow, F.col("size"), F.col("quality"))
    return made.select("doc.doc_id", "size", "source_size", "target", "taken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(spark, table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_html_text, op10_minhash_near_dedup, op5_substring_dedup, op6_suffix_array_dedup, op3_token_counts, op4_quality_rules, op7_hilbert_shards, op8_source_mix, op9_byte_bpe)}


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(ws, lambda x: list_contains([{stops}], x))) AS DOUBLE) AS n_stop,
    CAST(len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) AS DOUBLE) AS n_alpha,
    CAST(greatest(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]'))), 1) AS DOUBLE) AS n_lines,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS DOUBLE) AS n_bullets,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[ \t]*$'))) AS DOUBLE) AS n_dots
  FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS t(i) WHERE len(ws) >= 3),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
j AS (
  SELECT m.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST((SELECT len(ls) - len(list_distinct(ls)) FROM l WHERE l.doc_id = m.doc_id) AS BIGINT) AS n_dup_lines
  FROM m LEFT JOIN c ON m.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars / n_words BETWEEN 2 AND 12
    AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.02 AND n_alpha / n_words >= 0.7
    AND n_dup_lines / n_lines <= 0.5 AND n_bullets / n_lines <= 0.9 AND n_dots / n_lines <= 0.3 AS kept
FROM j
"""



OP1_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
c AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.y AS component_id, v.vec_id = c.y AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 11, 1))) AS t(i) WHERE len(ws) >= 13),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
r AS (SELECT DISTINCT doc_id, p FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 13)) AS p FROM w JOIN m ON w.g = m.g WHERE m.least < w.doc_id)),
x AS (SELECT doc_id, i, ws[i] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(i)),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.i = r.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substring(h, CAST(2 * i - 1 AS BIGINT), 400)) AS k FROM d, unnest(range(1, greatest(n - 198, 1))) AS t(i) WHERE n >= 200),
dup AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM dup),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
sp AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS from_ FROM sp),
k AS (
  SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    string_agg(substring(d.h, CAST(2 * from_ - 1 AS BIGINT), CAST(2 * (a - from_) AS BIGINT)), '' ORDER BY a) || substring(any_value(d.h), CAST(2 * max(b) - 1 AS BIGINT)) AS kept
  FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


OP7_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
b AS (
  SELECT doc_id, lang, source, CAST(strlen(t) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda a, x: xor(a >> 8, ([{crc}]::BIGINT[])[1 + (xor(a, x) & 255)])), 4294967295::BIGINT) AS text_crc32 FROM d),
l AS (SELECT lang AS v, (row_number() OVER (ORDER BY lang) - 1) * 16 // count(*) OVER () AS p FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
s AS (SELECT source AS v, (row_number() OVER (ORDER BY source) - 1) * 16 // count(*) OVER () AS p FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
c AS (
  SELECT doc_id, size, text_crc32, ([{curve}])[1 + (coalesce(l.p, 0) * 16 + coalesce(s.p, 0)) * 16 + least(length(bin(size + 1)) - 1, 15)] AS cell, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS number
  FROM b LEFT JOIN l ON b.lang = l.v LEFT JOIN s ON b.source = s.v),
n AS (SELECT *, count(*) OVER (PARTITION BY cell) AS in_cell, count(*) OVER () // 16 AS small, count(*) OVER () % 16 AS more FROM c),
o AS (SELECT *, more * (small + 1) AS head, row_number() OVER (ORDER BY cell, number % greatest(16, CAST(ceil(in_cell / 1048576.0) AS BIGINT)), doc_id, text_crc32, size) - 1 AS pos FROM n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(CASE WHEN pos < head THEN pos // (small + 1) ELSE more + (pos - head) // greatest(small, 1) END AS INTEGER) AS shard,
  CAST(CASE WHEN pos < head THEN pos % (small + 1) ELSE (pos - head) % greatest(small, 1) END AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM o
"""


def crc_table() -> list[int]:
    """CRC-32 of each byte, by its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


def op7_sql() -> str:
    """The places along the curve by SQL, with tables made by rule."""
    curve = (sharding.hilbert_index([c >> 8, c >> 4 & 15, c & 15], 4) for c in range(4096))
    return OP7_SQL.replace("{crc}", ", ".join(map(str, crc_table()))).replace("{curve}", ", ".join(map(str, curve)))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('0/' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
q AS (SELECT *, CASE WHEN length(text) > 0 THEN CAST(length(translate(text, '#*$%&|<>', '')) AS DOUBLE) / CAST(length(text) AS DOUBLE) ELSE 1.0::DOUBLE END AS plain FROM d),
k AS (SELECT doc_id, source, size, -ln(u) / greatest(plain * plain, 0.1::DOUBLE) AS key FROM q),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
r AS (
  SELECT *, cap / weight AS ratio, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS rate FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT rate FROM r WHERE ratio > rate ORDER BY ratio, source NULLS LAST LIMIT 1) * weight, cap)) AS target FROM r),
e AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS BIGINT) AS epochs FROM t),
o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * (epochs + CAST(epochs < 3 AND before + size / 2.0::DOUBLE <= target - epochs * source_size AS BIGINT)) END AS BIGINT) AS taken FROM o
"""


def oracle_sql() -> dict[str, str]:
    """Queries by other means than SQL's are tested against brute force instead."""
    stops = ", ".join(f"'{x}'" for x in sorted({y for s in quality.STOP_WORDS for y in (s, s.capitalize())}))
    return {"op1_embedding_near_dedup": OP1_SQL, "op4_quality_rules": OP4_SQL.replace("{stops}", stops), "op5_substring_dedup": OP5_SQL, "op6_suffix_array_dedup": OP6_SQL, "op7_hilbert_shards": op7_sql(), "op8_source_mix": OP8_SQL}
