"""The corpus manifest as a log of versions.

A version is a table of chunks (JSON lines, one row per chunk, written by as many tasks as it has) and one small header,
put in place last. The header names the chunk folder, says how many rows it has, and holds the facts of the corpus up
to this version. Readers go by headers alone: what a writer left behind without one is never read. A version that is
a base replaces all before it; other versions add chunks.

    manifest/chunks/<version>-<unique>/part-*.json
    manifest/commits/<version>/part-*.txt
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators.joins import require_empty
from ionloom.schemas import MANIFEST_CHUNK

FORMAT = 1


@dataclass(frozen=True)
class Header:
    """One version: where its chunks lie, and the facts of the corpus so far. Maps have an entry per dataset or split."""

    version: int
    folder: str
    base: bool
    added: int  # rows of the chunk folder
    chunks: int  # of the corpus
    split_rows: dict[str, int] = field(default_factory=dict)
    split_datasets: dict[str, list[str]] = field(default_factory=dict)
    irt_stats: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    val_winners_uri: str = ""
    source: dict = field(default_factory=dict)
    transaction: str = ""
    format: int = FORMAT

    @property
    def datasets(self) -> dict[str, int]:
        """Datasets numbered from one in name order."""
        return {name: i for i, name in enumerate(sorted(self.split_datasets), start=1)}

    def total(self) -> int:
        return sum(self.split_rows.values())


class ManifestLog:
    """Versions of a corpus manifest below a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def headers(self) -> list[Header]:
        """All complete versions in order: a small row each."""
        known = self.spark.read.option("wholetext", True).option("pathGlobFilter", "part-*")
        try:
            rows = known.text(f"{self.folder}/commits/*").collect()
        except Exception as error:  # noqa: BLE001 - no commit yet
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise
        found = []
        for row in rows:
            body = json.loads(row["value"])
            if body.get("format") != FORMAT:
                raise ValueError(f"unsupported manifest format {body.get('format')}")
            found.append(Header(**body))
        found.sort(key=lambda h: h.version)
        if len({h.version for h in found}) != len(found):
            raise ValueError("two writers have committed one version")
        return found

    def newest(self, version: int | None = None) -> Header:
        """The header of a version, by default the newest complete one."""
        for header in reversed(self.headers()):
            if version is None or header.version == version:
                return header
        raise ValueError(f"no complete version{'' if version is None else f' {version}'} in {self.folder}")

    def chunks(self, version: int | None = None) -> DataFrame:
        """``(uri, dataset, rows, source_shard)`` of a version; a chunk folder that lost rows is an error."""
        newest = self.newest(version)
        live = [h for h in self.headers() if h.version <= newest.version]
        live = live[max(i for i, h in enumerate(live) if h.base) :]
        parts = self.spark.read.schema(MANIFEST_CHUNK).option("mode", "FAILFAST").json([f"{self.folder}/chunks/{h.folder}" for h in live])
        held = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        have = {r["folder"]: r["n"] for r in parts.groupBy(held.alias("folder")).agg(F.count("uri").alias("n")).collect()}  # a row per version
        for header in live:
            if have.get(header.folder, 0) != header.added:
                raise ValueError(f"version {header.version} has {have.get(header.folder, 0)} of {header.added} chunks")
        return parts

    def append(self, chunks: DataFrame, facts: DataFrame, winners_uri: str, source: dict, transaction: str = "", base: bool = False) -> Header:
        """Add chunks as the next version. ``facts`` is the one row of :func:`corpus_facts` over what is added.

        ``base`` starts the corpus anew, as changed settings ask for. A ``transaction`` that is committed already changes
        nothing, so a step that runs twice adds its chunks once. Chunks are immutable: one that is there is an error.
        """
        headers = self.headers()
        for header in headers:
            if transaction and header.transaction == transaction:
                return header
        before = headers[-1] if headers else None
        base = base or before is None
        version = before.version + 1 if before else 1
        rows = chunks.select(*MANIFEST_CHUNK.names)
        name = f"{version:020d}-{uuid.uuid4().hex}"
        rows.write.mode("error").json(f"{self.folder}/chunks/{name}")
        stored = self.spark.read.schema(MANIFEST_CHUNK).json(f"{self.folder}/chunks/{name}")
        every = stored if base else self.chunks(before.version).unionByName(stored)
        require_empty(every.where("uri is null or dataset is null").select("uri"), "chunks without a place or dataset")
        require_empty(every.groupBy("uri").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "chunks that are there already")
        added = stored.count()
        if base and not added:
            raise ValueError("manifest has no chunks")
        own = facts.first().asDict(recursive=True)
        known = None if base else before
        split_rows = dict(known.split_rows) if known else {}
        for split, n in own["split_rows"].items():
            split_rows[split] = split_rows.get(split, 0) + n
        split_datasets = {k: list(v) for k, v in known.split_datasets.items()} if known else {}
        for dataset, splits in own["split_datasets"].items():
            split_datasets[dataset] = sorted({*split_datasets.get(dataset, []), *splits})
        for row in stored.select("dataset").distinct().collect():  # a row per dataset
            split_datasets.setdefault(row["dataset"], [])
        stats = [a + b for a, b in zip(known.irt_stats, own["irt_stats"])] if known else own["irt_stats"]
        header = Header(
            version, name, base, added, added + (known.chunks if known else 0), split_rows, split_datasets, stats, winners_uri, source, transaction
        )
        self.commit(header)
        return header

    def commit(self, header: Header) -> None:
        """Put the header in place; a version that is taken is an error."""
        body = self.spark.createDataFrame([(json.dumps(asdict(header), sort_keys=True),)], "value string")
        body.coalesce(1).write.mode("error").text(f"{self.folder}/commits/{header.version:020d}")

    def stale(self, fingerprint: str) -> bool:
        """Whether the newest version was made under other settings, or there is none."""
        headers = self.headers()
        return not headers or headers[-1].source.get("config_fingerprint") != fingerprint
