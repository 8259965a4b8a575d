"""op13: a tenth of the documents, drawn towards the benchmark's words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionloom.llm.base import query, table
from ionloom.llm.resample import Options, resample

OPTIONS = Options(longest=1, buckets=10_000, least_words=20, draw=10, seed=2024, scale=1000)

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

#: CRC-32 from its polynomial, once for every distinct word.
SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step
), rows AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), used AS (SELECT r, unnest(w) AS word FROM rows
), wanted AS (SELECT unnest({_WORDS}) AS word FROM benchmark
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(word), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT % {OPTIONS.buckets} AS bucket
  FROM (SELECT word FROM used UNION SELECT word FROM wanted) CROSS JOIN crc
), have AS (SELECT bucket, count(*) AS s FROM used JOIN buckets USING (word) GROUP BY bucket
), want AS (SELECT bucket, count(*) AS t FROM wanted JOIN buckets USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor({OPTIONS.scale} * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM used) + {OPTIONS.buckets})::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {OPTIONS.buckets})::DOUBLE)))::BIGINT AS g
  FROM have LEFT JOIN want USING (bucket)
), sums AS (SELECT r, sum(g) AS total FROM used JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY r
), weighed AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(total::DOUBLE / len(w)) END::BIGINT AS weight,
    ('0x' || substr(sha256('{OPTIONS.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM rows LEFT JOIN sums USING (r)
), scores AS (SELECT *, weight + floor(-{OPTIONS.scale} * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
), placed AS (
  SELECT *, n_features >= {OPTIONS.least_words} AS able, row_number() OVER (PARTITION BY n_features >= {OPTIONS.least_words} ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (WHERE n_features >= {OPTIONS.least_words}) OVER () AS n FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {OPTIONS.draw} * n // 100 THEN place END AS rank FROM placed
"""


@query("op13_radix_importance_resampling", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), OPTIONS)
