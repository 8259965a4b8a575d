"""op4: exact near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionloom.llm.base import query, table
from ionloom.llm.jaccard import jaccard_join

SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM words
), classes AS (SELECT min(doc_id) AS c, len(g) AS n, g FROM (SELECT doc_id, list_sort(g) AS g FROM sets) GROUP BY g HAVING len(g) > 0),
members AS (SELECT c, n, unnest(g) AS x FROM classes),
rare AS (SELECT x FROM members GROUP BY x HAVING count(*) > 1),
kept AS (SELECT members.* FROM members SEMI JOIN rare USING (x)),
links AS (
  SELECT a.c AS a, b.c AS b FROM kept a JOIN kept b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(c, d) AS (SELECT c, c FROM classes UNION SELECT r.c, e.b FROM r JOIN edges e ON r.d = e.a)
  SELECT c, min(d) AS component_id FROM r GROUP BY c
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(r.component_id, s.doc_id) AS component_id
FROM (SELECT doc_id, list_sort(g) AS g FROM sets) s LEFT JOIN classes k ON s.g = k.g LEFT JOIN reach r ON r.c = k.c
"""


@query("op4_universe_partition_jaccard", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
