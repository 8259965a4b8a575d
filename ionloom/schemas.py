"""Table contracts and strict enforcement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


LONG, DOUBLE, FLOAT, TEXT, FLAG = (
    T.LongType(),
    T.DoubleType(),
    T.FloatType(),
    T.StringType(),
    T.BooleanType(),
)
IDENTIFIER = T.DecimalType(20, 0)


def struct(**fields: T.DataType) -> T.StructType:
    """A schema from column names and types, in the order given."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PSM_METADATA = struct(
    raw_file=TEXT,
    scan_number=LONG,
    modified_sequence=TEXT,
    precursor_charge=LONG,
    retention_time=DOUBLE,
    indexed_retention_time=DOUBLE,
    aligned_collision_energy=DOUBLE,
    mass_analyzer=TEXT,
    fragmentation=TEXT,
    andromeda_score=DOUBLE,
    precursor_intensity=DOUBLE,
)
REQUIRED_METADATA = ("raw_file", "scan_number", "modified_sequence", "precursor_charge")

FRAGMENTS = struct(
    raw_file=TEXT,
    scan_number=LONG,
    ion_type=TEXT,
    no=LONG,
    charge=LONG,
    intensity=FLOAT,
    neutral_loss=TEXT,
)

PREPARED = struct(
    spectrum_id=IDENTIFIER,
    dataset=TEXT,
    raw_file=TEXT,
    scan_number=LONG,
    proforma=TEXT,
    charge=LONG,
    split=TEXT,
    irt=DOUBLE,
    raw_rt=DOUBLE,
    instrument=TEXT,
    detector=TEXT,
    fragmentation=TEXT,
    energy=DOUBLE,
    andromeda_score=DOUBLE,
    ms2=T.ArrayType(FLOAT),
)

CURATION_INPUT = T.StructType([*PREPARED.fields, T.StructField("precursor_intensity", DOUBLE)])

CURATION_ANNOTATION = struct(
    spectrum_id=IDENTIFIER,
    precursor_intensity=DOUBLE,
    intensity_ratio=DOUBLE,
    supports_half_max=FLAG,
    apex_rt=DOUBLE,
    run_width_minutes=DOUBLE,
    apex_window_start=DOUBLE,
    apex_window_end=DOUBLE,
    within_apex_window=FLAG,
    peptidoform_window_psms=LONG,
    context_window_psms=LONG,
    selection_rank=LONG,
    selected=FLAG,
    selection_reason=TEXT,
)

WINNERS = struct(spectrum_id=IDENTIFIER)

SHARD_MANIFEST = struct(
    version=LONG,
    data_uri=TEXT,
    rows=LONG,
    source_shard=TEXT,
    task=struct(
        ordinal=LONG,
        source_id=TEXT,
        dataset=TEXT,
        shard_index=LONG,
        config_fingerprint=TEXT,
        policy_version=LONG,
    ),
    curation=struct(
        policy=TEXT,
        rows=LONG,
        missing_intensity_rows=LONG,
        peptidoform_groups=LONG,
        selected_rows=LONG,
        rejected_peptidoforms=LONG,
        runs=LONG,
        clamped_runs=LONG,
        ceiling=T.MapType(TEXT, T.ArrayType(LONG)),
    ),
)

MANIFEST_CHUNK = struct(uri=TEXT, dataset=TEXT, rows=LONG, source_shard=TEXT)

CORPUS_MANIFEST = struct(
    version=LONG,
    datasets=T.MapType(TEXT, LONG),
    chunks=T.ArrayType(MANIFEST_CHUNK),
    val_winners=T.ArrayType(IDENTIFIER),
    val_winners_uri=TEXT,
    irt_stats=T.ArrayType(DOUBLE),
    split_rows=T.MapType(TEXT, LONG),
    split_datasets=T.MapType(TEXT, T.ArrayType(TEXT)),
    source=struct(config_fingerprint=TEXT, policy_version=LONG, shards=LONG),
)


def missing_columns(present: list[str], required: list[str] | tuple[str, ...]) -> list[str]:
    return [name for name in required if name not in present]


def enforce_schema(df: DataFrame, schema: T.StructType, *, id_column: str = "spectrum_id") -> DataFrame:
    """Rows under exactly ``schema``: same columns in the same order, strict types.

    Only the identifier may arrive in another integral type; anything else is an error rather
    than a cast. ANSI casts make an identifier that does not fit fail as well.
    """
    if df.columns != schema.names:
        raise ValueError(f"columns differ: {df.columns} != {schema.names}")
    for have, want in zip(df.schema.fields, schema.fields):
        if have.name == id_column:
            if not isinstance(have.dataType, (T.IntegralType, T.DecimalType)):
                raise ValueError(f"{id_column} must be integral, got {have.dataType}")
        elif _plain(have.dataType) != _plain(want.dataType):
            raise ValueError(f"{have.name}: {have.dataType} is not {want.dataType}")
    return df.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name) if f.name == id_column else F.col(f.name)
            for f in schema.fields
        ]
    )


def _plain(data_type: T.DataType) -> str:
    """Type text without nullability, which differs between readers."""
    return data_type.simpleString()
