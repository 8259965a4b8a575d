"""Batch predictors: the user's own, and a deterministic built-in one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.constants import (
    DRIFT_GAS_MASS,
    HYDROPATHY,
    ION_COLUMNS,
    MOBILITY_COEFFICIENT,
    PROTON,
    RESIDUE_MASS,
    WATER,
)
from ionloom.functions.binding import let
from ionloom.functions.chemistry import hydropathy_sum, prefix_sums
from ionloom.functions.spectra import base_peak
from ionloom.session import spread_rows

#: Peptidoforms of one length that go into one call of a predictor.
CALL_ROWS = 8192

LABEL_SCHEMA = "ms2 array<float>, rt double, ccs double"


def label_batches(
    precursors: DataFrame,
    factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    keys: list[str],
    batch_rows: int = 10_000,
) -> DataFrame:
    """Label precursors with a user's predictor.

    ``factory`` runs once per task and returns ``predict(frame) -> frame`` with ``ms2, rt, ccs``
    aligned by row; rows whose ``ms2`` is None are dropped. Rows come sorted by peptide length
    within a task, so batches hold similar lengths and need little padding. Batches reach Python
    through Arrow; no group is gathered in one task.
    """
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in precursors.schema.fields if f.name in keys
    )
    wanted = [*keys]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = factory()
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                part = frame.iloc[start : start + batch_rows].reset_index(drop=True)
                labels = predict(part)
                if len(labels) != len(part):
                    raise ValueError("a predictor must return one label per precursor")
                out = pd.concat([part[wanted], labels[["ms2", "rt", "ccs"]].reset_index(drop=True)], axis=1)
                yield out[out["ms2"].notna()]

    by_length = precursors.sortWithinPartitions(F.length("peptide"))
    return by_length.mapInPandas(run, f"{schema}, {LABEL_SCHEMA}")


def smooth_labels(peptide: Column, masses: Column, neutral: Column, charge: Column) -> Column:
    """Deterministic labels as columns: ``struct<ms2, rt, ccs>``.

    Intensities are a sine of the fragment's residue mass, scaled to a base peak of one; retention
    follows hydropathy and mass, cross section mass over charge. ``masses`` are the per-position
    residue masses, modifications included.
    """

    def waves(prefix: Column) -> Column:
        last = F.element_at(prefix, -1)
        return F.flatten(
            F.transform(
                F.slice(prefix, F.lit(1), F.size(prefix) - 1),
                lambda b: F.array(
                    *[
                        0.5 * (1 + F.sin((b if ion == "b" else last - b) / F.lit(37.0 * z) + charge))
                        for ion, z in ION_COLUMNS
                    ]
                ),
            )
        )

    def scaled(raw: Column) -> Column:
        return let(base_peak(raw), lambda top: F.transform(raw, lambda x: x / top))

    return F.struct(
        let(let(prefix_sums(masses), waves), scaled).alias("ms2"),
        (hydropathy_sum(peptide) + 0.02 * neutral).alias("rt"),
        (0.9 * neutral / charge + 30.0 * charge).alias("ccs"),
    )


def smooth_predictor():
    """The same labels as a vectorised predictor: a factory for :func:`label_batches`.

    Needs ``peptide, charge, neutral_mass, rt_index, mod_masses``; one numpy pass per length.
    """
    table = np.zeros(128)
    for residue, mass in RESIDUE_MASS.items():
        table[ord(residue)] = mass

    def predict(frame: pd.DataFrame) -> pd.DataFrame:
        ms2: list = [None] * len(frame)
        lengths = frame["peptide"].str.len().to_numpy()
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            letters = np.frombuffer("".join(frame["peptide"].iloc[rows]).encode(), dtype=np.uint8)
            masses = table[letters.reshape(len(rows), n)]
            if "mod_masses" in frame:
                masses = masses + np.stack(frame["mod_masses"].iloc[rows].to_numpy())
            charge = frame["charge"].to_numpy()[rows][:, None]
            prefix = np.cumsum(masses, axis=1)
            b = prefix[:, :-1]
            y = prefix[:, -1:] - b
            grid = np.stack(
                [0.5 * (1 + np.sin((b if ion == "b" else y) / (37.0 * z) + charge)) for ion, z in ION_COLUMNS],
                axis=2,
            ).reshape(len(rows), -1)
            top = grid.max(axis=1, keepdims=True)
            grid = np.where(top > 0, grid / np.where(top > 0, top, 1.0), grid).astype(np.float32)
            for i, row in enumerate(rows):
                ms2[row] = grid[i]
        mass = frame["neutral_mass"]
        return pd.DataFrame(
            {
                "ms2": pd.Series(ms2, dtype=object),
                "rt": frame["rt_index"] + 0.02 * mass,
                "ccs": 0.9 * mass / frame["charge"] + 30.0 * frame["charge"],
            }
        )

    return predict


@dataclass(frozen=True)
class LengthBatch:
    """Peptidoforms of one length at one charge, as arrays: rows by residues."""

    residues: np.ndarray  # uint8 letters
    masses: np.ndarray  # residue masses, modifications included
    charge: int

    @property
    def neutral(self) -> np.ndarray:
        return self.masses.sum(axis=1) + WATER


def smooth_arrays():
    """The built-in labels under the array contract: a factory for :func:`library_batches`.

    Returns per batch ``ms2`` (rows x sites x 4, float32), ``rt`` and ``ccs``.
    """
    hydropathy = np.zeros(128)
    for residue, value in HYDROPATHY.items():
        hydropathy[ord(residue)] = value

    def predict(batch: LengthBatch):
        prefix = np.cumsum(batch.masses, axis=1)
        b = prefix[:, :-1]
        y = prefix[:, -1:] - b
        waves = [0.5 * (1 + np.sin((b if ion == "b" else y) / (37.0 * z) + batch.charge)) for ion, z in ION_COLUMNS]
        ms2 = np.stack(waves, axis=2)
        top = ms2.max(axis=(1, 2), keepdims=True)
        ms2 = (ms2 / np.where(top > 0, top, 1.0)).astype(np.float32)
        mass = batch.neutral
        rt = hydropathy[batch.residues].sum(axis=1) + 0.02 * mass
        return ms2, rt, 0.9 * mass / batch.charge + 30.0 * batch.charge

    return predict


def library_batches(
    peptidoforms: DataFrame,
    factory: Callable[[], Callable[[LengthBatch], tuple]],
    keys: list[str],
    charges: list[int] | str,
    min_intensity: float = 0.0,
    max_fragments: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Predict and assemble library rows in one Arrow pass, one row per peptidoform and charge.

    ``peptidoforms`` has ``peptide, mod_pos, mod_delta`` (modification positions and masses) and
    the ``keys`` to carry; ``charges`` are those of every peptidoform, or the column that has its own. Rows are gathered by
    length within a task, so nothing is padded and calls are large; they are
    encoded once and predicted for all charges. Only the kept peaks go back to the JVM, field by field as lists of numbers;
    ``peaks`` puts them together where it is read, ``n_peaks`` is their number. Every peak
    is checked before the cap; a faulty one stops the job. Rows that are ``dealt`` over several tasks a core already stay where they are.
    """
    carried = [f for f in peptidoforms.schema.fields if f.name in keys]
    schema = T.StructType([*carried, *_ROW_FIELDS[:-1], *[T.StructField(f"__peak_{f.name}", T.ArrayType(f.dataType, False)) for f in _PEAK if f.name != "ion"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in predicted_rows(batches, factory, keys, charges, min_intensity, max_fragments):
            peaks = batch.column("peaks")
            mz, intensity, ion, ordinal, charge = peaks.flatten().flatten()
            signed = pc.if_else(pc.equal(ion, "b"), ordinal, pc.negate(ordinal))  # ordinals start at one
            # Declared free of nulls, so that the JVM does not ask for each number.
            lists = [pa.ListArray.from_arrays(peaks.offsets, x, type=pa.list_(pa.field("element", x.type, nullable=False))) for x in (mz, intensity, signed, charge)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=schema.names)

    rows = (peptidoforms if dealt else spread_rows(peptidoforms, "peptide")).mapInArrow(run, schema)
    fields = F.arrays_zip(*[F.col(f"__peak_{f.name}").alias(f.name) for f in _PEAK if f.name != "ion"])
    ion = lambda p: F.when(p["ordinal"] > 0, "b").otherwise("y")
    peak = lambda p: F.struct(p["mz"], p["intensity"], ion(p).alias("ion"), F.abs(p["ordinal"]).alias("ordinal"), p["charge"])
    plain = [c for c in schema.names if not c.startswith("__peak_")]
    return rows.select(*plain, F.transform(fields, peak).alias("peaks"), F.size("__peak_mz").alias("n_peaks"))


def predicted_rows(
    batches: Iterator[pa.RecordBatch],
    factory: Callable[[], Callable[[LengthBatch], tuple]],
    keys: list[str],
    charges: list[int] | str,
    min_intensity: float = 0.0,
    max_fragments: int | None = None,
    call_rows: int = CALL_ROWS,
) -> Iterator[pa.RecordBatch]:
    """Library rows of one task's peptidoforms, a predictor call per length and charge.

    Peptidoforms of one length (and charge, if each has its own) are held across Arrow batches until there are ``call_rows`` of
    them, so calls are large whatever the mix of lengths; at most ``16 * call_rows`` rows are held in all.
    """
    predict = factory()
    table = np.full(128, np.nan)
    for residue, mass in RESIDUE_MASS.items():
        table[ord(residue)] = mass

    def flush(kind: tuple[int, int | None]) -> Iterator[pa.RecordBatch]:
        n, own = kind
        whole = pa.Table.from_batches(held.pop(kind)).combine_chunks().to_batches()
        for batch in whole:
            residues, masses = _encoded(batch, n, table)
            carried = batch.select(keys)
            for z in charges if own is None else [own]:
                part = LengthBatch(residues, masses, z)
                columns = _assemble(part, predict(part), min_intensity, max_fragments)
                yield pa.RecordBatch.from_arrays([*carried.columns, *columns], names=[*keys, *[f.name for f in _ROW_FIELDS]])

    def kinds(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int | None], pa.RecordBatch]]:
        for n, part in _by_length(batch):
            if not isinstance(charges, str):
                yield (n, None), part
                continue
            for z in pc.unique(part.column(charges)).drop_null().to_pylist():
                yield (n, z), part.filter(pc.equal(part.column(charges), z))

    held: dict[tuple, list[pa.RecordBatch]] = {}
    rows: dict[tuple, int] = {}
    for batch in batches:
        for kind, part in kinds(batch):
            held.setdefault(kind, []).append(part)
            rows[kind] = rows.get(kind, 0) + part.num_rows
            if rows[kind] >= call_rows:
                rows.pop(kind)
                yield from flush(kind)
        while sum(rows.values()) > 16 * call_rows:
            kind = max(rows, key=rows.get)
            rows.pop(kind)
            yield from flush(kind)
    for kind in sorted(held):
        yield from flush(kind)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of one Arrow batch by peptide length."""
    lengths = pc.utf8_length(batch.column("peptide")).to_numpy(zero_copy_only=False)
    order = np.argsort(lengths, kind="stable")
    lengths = lengths[order]
    ordered = batch.take(pa.array(order))
    cut = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]]) if len(lengths) else lengths
    for low, high in zip(cut, np.r_[cut[1:], len(lengths)]):
        yield int(lengths[low]), ordered.slice(low, high - low)


def _encoded(batch: pa.RecordBatch, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and residue masses, modifications included, of peptidoforms of length ``n``."""
    residues = np.frombuffer("".join(batch.column("peptide").to_pylist()).encode(), dtype=np.uint8).reshape(-1, n)
    masses = table[residues]
    positions, deltas = batch.column("mod_pos"), batch.column("mod_delta")
    row = np.repeat(np.arange(batch.num_rows), np.diff(positions.offsets.to_numpy()))
    np.add.at(masses, (row, positions.flatten().to_numpy(zero_copy_only=False)), deltas.flatten().to_numpy(zero_copy_only=False))
    return residues, masses


def _assemble(batch: LengthBatch, labels: tuple, min_intensity: float, max_fragments: int | None) -> list[pa.Array]:
    """Library columns of one batch: masses, retention, mobility and the kept peaks."""
    ms2, rt, ccs = labels
    count, sites = len(ms2), ms2.shape[1]
    prefix = np.cumsum(batch.masses, axis=1)
    b = prefix[:, :-1]
    y = prefix[:, -1:] - b + WATER
    mz = np.stack([((b if ion == "b" else y) + z * PROTON) / z for ion, z in ION_COLUMNS], axis=2).reshape(count, -1)
    grid = ms2.reshape(count, -1)
    top = grid.max(axis=1, keepdims=True)
    share = (grid / np.where(top > 0, top, 1.0).astype(grid.dtype)).astype(np.float64)
    neutral = batch.neutral
    precursor = (neutral + batch.charge * PROTON) / batch.charge
    mass = precursor * batch.charge
    mobility = ccs * np.sqrt(mass * DRIFT_GAS_MASS / (mass + DRIFT_GAS_MASS)) / batch.charge / MOBILITY_COEFFICIENT
    for name, value in (("precursor_mz", precursor), ("ccs", ccs), ("mobility", mobility)):
        if not (np.isfinite(value) & (value > 0)).all():
            raise ValueError(f"non-physical {name} at charge {batch.charge}")
    kept = share >= min_intensity
    fine = np.isfinite(mz) & (mz > 0) & np.isfinite(share) & (share <= 1.0) & (share >= 0.0)
    if not np.isfinite(rt).all() or not (fine | ~kept).all():
        raise ValueError(f"invalid retention or fragment at charge {batch.charge}")
    if max_fragments is not None and max_fragments < share.shape[1]:
        order = np.argsort(np.where(kept, -share, np.inf), axis=1, kind="stable")
        strongest = np.zeros_like(kept)
        np.put_along_axis(strongest, order[:, :max_fragments], True, axis=1)
        kept &= strongest
    row, cell = np.nonzero(kept)
    site, column = np.divmod(cell, len(ION_COLUMNS))
    is_b = np.array([ion == "b" for ion, _ in ION_COLUMNS])[column]
    charge = np.array([z for _, z in ION_COLUMNS], dtype=np.int32)[column]
    ordinal = np.where(is_b, site + 1, sites - site).astype(np.int32)
    peaks = pa.StructArray.from_arrays(
        [
            pa.array(mz[row, cell]),
            pa.array(share[row, cell]),
            pa.array(["y", "b"]).take(pa.array(is_b.astype(np.int8))),
            pa.array(ordinal),
            pa.array(charge),
        ],
        names=["mz", "intensity", "ion", "ordinal", "charge"],
    )
    offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
    return [
        pa.array(np.full(count, batch.charge, dtype=np.int32)),
        pa.array(neutral),
        pa.array(precursor),
        pa.array(rt),
        pa.array(ccs),
        pa.array(mobility),
        pa.ListArray.from_arrays(pa.array(offsets), peaks),
    ]


_PEAK = T.StructType(
    [
        T.StructField("mz", T.DoubleType()),
        T.StructField("intensity", T.DoubleType()),
        T.StructField("ion", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("charge", T.IntegerType()),
    ]
)
_ROW_FIELDS = [
    T.StructField("charge", T.IntegerType()),
    T.StructField("neutral_mass", T.DoubleType()),
    T.StructField("precursor_mz", T.DoubleType()),
    T.StructField("rt", T.DoubleType()),
    T.StructField("ccs", T.DoubleType()),
    T.StructField("mobility", T.DoubleType()),
    T.StructField("peaks", T.ArrayType(_PEAK)),
]


def labels_tables(labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Precursor-grain and fragment-grain tables of labels: ``(key, rt, ccs)`` and one row per site."""
    rows = labels.select(key, "ms2", F.explode(F.sequence(F.lit(0), (F.size("ms2") / 4).cast("int") - 1)).alias("position"))
    cells = [
        F.element_at("ms2", (F.col("position") * 4 + i + 1).cast("int")).cast("double").alias(f"{ion}_z{z}")
        for i, (ion, z) in enumerate(ION_COLUMNS)
    ]
    return labels.select(key, "rt", "ccs"), rows.select(key, "position", *cells)


def labels_from_tables(precursors: DataFrame, fragments: DataFrame, key: str) -> DataFrame:
    """Inverse of :func:`labels_tables`; a precursor without fragment rows has an empty grid."""
    names = [f"{ion}_z{z}" for ion, z in ION_COLUMNS]
    grids = fragments.groupBy(key).agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", F.array(*names).alias("cells")))),
                lambda r: r["cells"],
            )
        ).alias("ms2")
    )
    return precursors.join(grids, key, "left").withColumn(
        "ms2", F.coalesce("ms2", F.array().cast("array<double>"))
    )
