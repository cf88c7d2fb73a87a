"""Query of the importance resampling towards the benchmark over all documents."""

from __future__ import annotations

from pelage.llm import batch_resample
from pelage.llm.registry import query, table

SEED, PERCENT, MIN_WORDS = 2024, 10, 20

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# crc32 by the table of its 256 byte steps.
SQL = f"""
WITH steps AS (SELECT list(list_reduce(range(0, 8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, b) ORDER BY b) AS step
  FROM range(0, 256) AS t(b)),
words AS (SELECT 0 AS kind, doc_id, unnest({_WORDS}) AS word FROM documents UNION ALL SELECT 1, NULL, unnest({_WORDS}) FROM benchmark),
buckets AS (SELECT word, xor(list_reduce(
    list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
    lambda a, x: xor(a // 256, step[xor(a % 256, x) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), steps),
counts AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM words JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM words JOIN buckets USING (word) JOIN gains USING (bucket)
  WHERE kind = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM documents LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place,
  {PERCENT} * count(*) OVER () // 100 AS wanted FROM scored WHERE n_features >= {MIN_WORDS})
SELECT s.doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= wanted THEN place END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""


@query("op13_batch_resample", SQL)
def op13(spark, sf_dir):
    weighted = batch_resample.weights(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")
    rows = batch_resample.drawn(batch_resample.scored(weighted, SEED), PERCENT, MIN_WORDS)
    return rows.withColumnRenamed("id", "doc_id").select("doc_id", "n_features", "weight", "score", "rank")
