"""op12: fill-in-middle examples of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionloom.llm.base import query, table
from ionloom.llm.frames import Rules, digests

#: Seed 7, every document, half of them suffix first.
RULES = Rules(seed=7, rate=100, suffix_first=50)

SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{RULES.seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS d FROM documents
), units AS (
  SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines, list_transform(range(4), lambda i: ('0x' || substr(d, 8 * i + 1, 8))::BIGINT) AS h FROM base
), drawn AS (
  SELECT *, len(lines)::BIGINT AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {RULES.rate} THEN 'plain'
    WHEN h[4] % 100 < {RULES.suffix_first} THEN 'spm' ELSE 'psm' END AS form,
    least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS low, greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS high FROM units
), parts AS (
  SELECT *, array_to_string(lines[1:low], '') AS p, array_to_string(lines[low + 1:high], '') AS m, array_to_string(lines[high + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query("op12_seekable_fill_in_middle", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), RULES)
