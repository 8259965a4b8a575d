"""op9: secrets in all documents with their ownership verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.base import query, sha, table
from ionloom.llm.secrets import BASE, scan_rows, verdicts


def _spelled(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op9_secret_ownership")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_rows(table(spark, sf_dir, "documents"))
    judged = verdicts(found.where(F.size("spans") > 0), "rid", "source")
    per_row = judged.groupBy("rid").agg(
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("example", "live", "weak")],
        F.max("owners").alias("most_owners"),
    )
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def many(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    out = found.select("rid", "doc_id", *[many(k) for k in BASE], sha(_spelled(base)).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"))
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_example", "n_live", "n_weak", "most_owners")]
    return out.join(per_row, "rid", "left").select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", *counts)
