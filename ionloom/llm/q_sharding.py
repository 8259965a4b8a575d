"""op1: all documents into 40 shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.base import query, table
from ionloom.llm.sharding import number_slots, place

SHARDS = 40
OVERHEAD = 16


#: The same draws, and CRC-32 from its polynomial; slots follow the order of the table.
SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step
), rows AS (
  SELECT doc_id, coalesce(text, '') AS text, list_sort(list_transform(range({SHARDS + 1}), lambda s: {{'score':
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(16**13)!r}), 'shard': s}})) AS drawn FROM documents
), placed AS (
  SELECT doc_id, text, list_filter(drawn, lambda d: d.shard < {SHARDS})[1].shard AS shard, drawn[1].shard AS grown_shard FROM rows
)
SELECT doc_id, (strlen(text) + {OVERHEAD})::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM placed CROSS JOIN crc
"""


@query("op1_rendezvous_sharding", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(narrow, "doc_id", [1.0] * SHARDS, grown="grown_shard")
    return number_slots(placed).select(
        "doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard")
    )
