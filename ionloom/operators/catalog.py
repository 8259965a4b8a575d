"""Task catalogs, shard completion, corpus manifests, settings documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.constants import BUILD_ONLY_PREFIXES, PATH_KEYS, RENAMED_KEYS
from ionloom.functions.sequence import dataset_name, metadata_name
from ionloom.functions.spectra import finite
from ionloom.operators.joins import require_empty, require_unique, settings_difference
from ionloom.operators.ordering import with_position
from ionloom.session import materialise


def glob_pattern(pattern: str) -> str:
    """Shell-style pattern as an anchored regular expression: ``*``, ``?`` and ``[..]``."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_any(name: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.regexp_like(name, F.lit("|".join(glob_pattern(p) for p in patterns)))


def expand_sources(
    archives: DataFrame,
    record: str,
    include: list[str],
    exclude: list[str],
    strip_prefix: str = "",
    strip_number_suffix: bool = True,
    meta_suffix: str = "_meta_data.parquet",
    dataset_prefix: str | None = None,
) -> DataFrame:
    """Archives of one record that a group rule selects, with their derived names."""
    name = F.col("archive")
    return archives.where(matches_any(name, include) & ~matches_any(name, exclude)).select(
        F.concat(F.lit(f"{record}_"), name).alias("source_id"),
        dataset_name(name, dataset_prefix or record, strip_prefix, strip_number_suffix).alias("dataset"),
        metadata_name(name, meta_suffix, strip_number_suffix).alias("meta"),
        "*",
    )


def expand_tasks(sources: DataFrame, shards: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """One numbered task per selected shard.

    ``shards`` is ``(archive, shard_index, shard_name, bytes)``. ``picks`` names explicit
    ``(source_id, shard_index)``; a pick outside the source's shards is an error. Ordinals follow
    source id and shard index.
    """
    require_unique(sources, ["source_id"], "source ids")
    tasks = sources.join(shards, "archive")
    if picks is not None:
        absent = picks.join(tasks.select("source_id", "shard_index"), ["source_id", "shard_index"], "left_anti")
        require_empty(absent, "shard picks outside their source")
        chosen = picks.select("source_id").distinct()
        tasks = tasks.join(chosen, "source_id", "left_anti").unionByName(
            tasks.join(picks, ["source_id", "shard_index"], "left_semi"), allowMissingColumns=True
        )
    return with_position(tasks, [F.col("source_id").asc(), F.col("shard_index").asc()], "ordinal")


def select_range(tasks: DataFrame, start: int, stop: int, total: int) -> DataFrame:
    """Tasks with an ordinal in ``[start, stop)``."""
    if not 0 <= start <= stop <= total:
        raise ValueError(f"range {start}:{stop} outside catalog of {total} tasks")
    return tasks.where((F.col("ordinal") >= start) & (F.col("ordinal") < stop))


def completion(tasks: DataFrame, manifests: DataFrame, config_fingerprint: str, prefix: str) -> DataFrame:
    """Every task with whether a valid manifest exists for it.

    Valid means the right version, the expected data location and the current fingerprint.
    """
    valid = manifests.where(
        (F.col("version") == 1) & (F.col("task.config_fingerprint") == config_fingerprint)
    ).select("data_uri", F.lit(True).alias("complete"))
    expected = F.concat_ws(
        "/", F.lit(prefix.rstrip("/")), F.lit("shards"), "source_id", F.lpad(F.col("shard_index").cast("string"), 6, "0"), F.lit("data.parquet")
    )
    return (
        tasks.withColumn("data_uri", expected)
        .join(valid.distinct(), "data_uri", "left")
        .withColumn("complete", F.coalesce("complete", F.lit(False)))
    )


def completion_counts(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if("complete").alias("complete"),
        F.count_if(~F.col("complete")).alias("missing"),
        F.count(F.lit(1)).alias("total"),
    )


def split_rows(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def split_datasets(prepared: DataFrame) -> DataFrame:
    """Splits each dataset occurs in; a dataset has at most the three splits."""
    return prepared.groupBy("dataset").agg(F.array_sort(F.collect_set("split")).alias("splits"))


def dataset_ids(chunks: DataFrame) -> DataFrame:
    """Datasets numbered from one in name order."""
    placed = with_position(chunks.select("dataset").distinct(), [F.col("dataset").asc()], "place")
    return placed.select("dataset", (F.col("place") + 1).alias("dataset_id"))


def corpus_facts(prepared: DataFrame) -> DataFrame:
    """What a manifest's header says of the rows: ``(split_rows, split_datasets, irt_stats)``, additive, one row.

    Maps have an entry per split or dataset. The chunk list is a table of its own (``sinks.manifest_log``).
    """
    one = F.lit(0).alias("__one")
    train = prepared.where((F.col("split") == "train") & finite(F.col("irt")))
    stats = train.agg(
        F.array(
            F.count(F.lit(1)).cast("double"),
            F.coalesce(F.sum("irt"), F.lit(0.0)),
            F.coalesce(F.sum(F.col("irt") * F.col("irt")), F.lit(0.0)),
        ).alias("irt_stats"),
        one,
    )
    as_map = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    rows = split_rows(prepared).agg(as_map("split", "rows").alias("split_rows"), one)
    datasets = split_datasets(prepared).agg(as_map("dataset", "splits").alias("split_datasets"), one)
    return rows.join(datasets, "__one").join(stats, "__one").drop("__one")


def flatten_document(df: DataFrame, key: list[str], json_column: str) -> DataFrame:
    """Nested JSON documents as dotted ``(key, value)`` pairs.

    Objects open up level by level, nulls are dropped, arrays stay JSON text. The number of levels
    is found from the data; each pass opens one level of all documents at once.
    """
    pairs = df.select(*key, F.lit("").alias("key"), F.col(json_column).alias("value"))
    done = None
    while True:
        is_object = F.regexp_like(F.col("value"), F.lit(r"^\s*\{"))
        leaves = pairs.where(~is_object)
        done = leaves if done is None else done.unionByName(leaves)
        # Cut here, so a level reads what the one above made instead of parsing all of them again.
        objects = materialise(pairs.where(is_object))
        if objects.isEmpty():
            return done
        fields = F.explode(F.from_json("value", "map<string,string>"))
        prefix = F.col("key")
        pairs = (
            objects.select(*key, prefix, fields.alias("field", "inner"))
            .where("inner is not null")
            .select(
                *key,
                F.when(prefix == "", F.col("field")).otherwise(F.concat_ws(".", prefix, "field")).alias("key"),
                F.col("inner").alias("value"),
            )
        )


def comparable_settings(pairs: DataFrame) -> DataFrame:
    """Pairs two builds can disagree about: old keys renamed, build facts and paths left out."""
    key = F.col("key")
    renamed = key
    for old, new in RENAMED_KEYS.items():
        renamed = F.when(key == old, F.lit(new)).otherwise(renamed)
    others = [c for c in pairs.columns if c not in ("key", "value")]
    legacy = (
        pairs.where(key == "inputs.fasta_blake2b_256")
        .select(*others, F.lit("inputs.sequence.kind").alias("key"), F.lit("fasta").alias("value"))
    )
    out = pairs.select(*others, renamed.alias("key"), "value").unionByName(legacy)
    head = F.substring_index("key", ".", 1)
    return out.where(~head.isin(*BUILD_ONLY_PREFIXES) & ~F.col("key").isin(*PATH_KEYS))


def check_settings(library: DataFrame, expected: DataFrame) -> DataFrame:
    """Verdict of a library against settings: one row ``(verdict, differences)``.

    ``unknown`` when the library recorded nothing, else ``same`` or ``different``.
    """
    mine = comparable_settings(library)
    diff = settings_difference(mine, comparable_settings(expected))
    known = library.agg(F.count(F.lit(1)).alias("known"), F.lit(0).alias("__one"))
    differences = diff.agg(F.count(F.lit(1)).alias("differences"), F.lit(0).alias("__one"))
    return known.join(differences, "__one").select(
        F.when(F.col("known") == 0, "unknown")
        .when(F.col("differences") == 0, "same")
        .otherwise("different")
        .alias("verdict"),
        F.when(F.col("known") == 0, F.lit(0)).otherwise(F.col("differences")).alias("differences"),
    )
