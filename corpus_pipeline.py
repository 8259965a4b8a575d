"""Cleaning and packing of a document collection, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as
the documents of the next. All but the last return the columns of ``documents``. A stage may be entered by itself and
sets the runtime options it relies on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.base import held_out
from ionloom.llm.decontam import contaminated
from ionloom.llm.jaccard import jaccard_join
from ionloom.llm.langid import fit, predict, rejected
from ionloom.llm.packing import pack
from ionloom.llm.q_packing import bpe_path
from ionloom.llm.secrets import redact, scan, verdicts
from ionloom.session import let_go, materialise, shared_folder, tune


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``docs`` has, in either case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the column ``lang`` keeps what it said.

    Null and empty texts, and texts without a letter, are not recognised and go. Very long texts are read whole, each of
    equal rows is judged alike, an empty table stays empty, and other columns are carried whatever their names are.
    """
    tune(spark)
    pred, score = _free(docs, "__lang", "__score")
    model = fit(docs.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "text", "lang"))
    judged = predict(docs, model, pred=pred, score=score)
    return judged.where(~rejected(F.col(pred), F.col(score))).select(*docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a key, under a free name, that tells rows apart by identifier, null or not, and text; equal rows share it."""
    (key,) = _free(docs, "__key")
    return docs.withColumn(key, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest identifier, null last.

    Rows are told apart by identifier and text, so a row never goes for its namesake; of equal rows one stays.
    Documents without a word are in no group and stay; of such rows with equal identifiers and texts one stays, but
    all without an identifier do. Very long texts are read whole; an empty table stays empty; other columns are carried
    whatever their names are, and equal rows may differ in them.
    """
    tune(spark)
    keyed, key = _keyed(docs)
    told = F.col("doc_id").isNotNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # Stored once: steps that go by keys alone do not read whole texts again.
    rows = materialise(keyed.select(F.col(key).alias("key"), "doc_id", told.alias("told")))
    found = materialise(jaccard_join(keyed.select(F.col(key).alias("key"), "text"), doc="key").where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct())
    let_go(spark)
    named = found.join(rows.select("key", "doc_id").distinct(), "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("first")
    keepers = named.groupBy("component_id").agg(first).select("first.key")
    gone = materialise(found.select("key").join(keepers, "key", "left_anti"))
    let_go(spark)
    twice = rows.where("told").groupBy("key").count().where("count > 1").select("key")
    twice = materialise(twice.join(gone, "key", "left_anti").withColumnRenamed("key", key))
    kept = keyed.join(gone.withColumnRenamed("key", key), key, "left_anti")
    single = kept.join(twice, key, "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(twice, key, "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; rows are told apart by identifier and text.

    Null and empty texts hold no item and stay; very long texts are read whole; equal rows stay or go together; an
    empty table stays empty; other columns are carried whatever their names are.
    """
    tune(spark)
    keyed, key = _keyed(docs)
    found = contaminated(keyed.select(F.col(key).alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc="key")
    # Stored first: whole texts are then neither shuffled nor held while the search runs, and a short list is broadcast.
    gone = materialise(found.select(F.col("key").alias(key)).distinct())
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; credentials that look live are blotted out and ``n_chars`` counted again.

    Spans move by row, not texts: rows are told apart by identifier and text checksum, and equal rows share
    their spans. Null and empty texts stay as they are; very long texts are scanned whole; an empty table stays empty;
    other columns are carried whatever their names are.
    """
    tune(spark)
    id_, crc, ranges_, new = _free(docs, "__id", "__crc", "__ranges", "__new")
    row_key = [F.coalesce(F.col("doc_id"), F.lit(-1)), F.xxhash64("text")]
    spans = scan(docs.select("doc_id", "source", "text"), "text")
    found = materialise(spans.where(F.size("spans") > 0).select(*[k.alias(n) for k, n in zip(row_key, ("id", "crc"))], "source", "spans"))
    live = verdicts(found.select(F.struct("id", "crc").alias("row"), "source", "spans"), "row", "source").where(F.col("verdict") == "live")
    whole = F.struct(F.col("span.value_start").alias("start"), F.col("span.end").alias("end"))
    ranges = materialise(live.groupBy(F.col("row.id").alias(id_), F.col("row.crc").alias(crc)).agg(F.collect_set(whole).alias(ranges_)))
    marked = docs.select("*", *[k.alias(n) for k, n in zip(row_key, (id_, crc))]).join(ranges, [id_, crc], "left")
    text = F.when(F.col(ranges_).isNotNull(), redact(F.col("text"), F.col(ranges_))).otherwise(F.col("text"))
    out = marked.withColumn(new, text)
    chars = F.when(F.col(ranges_).isNotNull(), F.length(new).cast("long")).otherwise(F.col("n_chars"))
    changed = {"text": F.col(new), "n_chars": chars}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null or empty text is its end mark alone; very long texts are cut into pieces; equal rows are packed one by one; an
    empty table gives no piece; columns other than the identifier and the text are not read.
    """
    tune(spark)
    return pack(docs, bpe_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

#: Learned models, components and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder before the next one reads it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
