"""Stable hashes: split assignment, spectrum identifiers and seeded uniform numbers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.constants import SPLIT_FRACTIONS, SPLIT_SALT

_HEX_DIGITS = 13  # 52 bits: exact in a double


def _unit_from_hex(digest: Column) -> Column:
    head = F.substring(digest, 1, _HEX_DIGITS)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**_HEX_DIGITS))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only.

    Unlike ``rand`` it is the same in a retried task and whatever the partitioning is.
    """
    return _unit_from_hex(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])))


def sha_unit(sequence: Column, salt: str = SPLIT_SALT) -> Column:
    """Uniform number from a JVM-side hash, for splits that need no agreement with old ones."""
    return _unit_from_hex(F.sha2(F.concat(F.lit(f"{salt}:"), sequence), 256))


def blake_unit(salt: str = SPLIT_SALT):
    """Arrow UDF: the 8-byte blake2b of ``salt:sequence``, big-endian, over 2^64."""

    @F.pandas_udf("double")
    def unit(sequence: pd.Series) -> pd.Series:
        prefix = f"{salt}:"
        return sequence.map(
            lambda s: int.from_bytes(
                hashlib.blake2b((prefix + s).encode(), digest_size=8).digest(), "big"
            )
            / 2.0**64,
            na_action="ignore",
        ).astype("float64")

    return unit


def split_label(unit: Column, fractions: tuple[float, float, float] = SPLIT_FRACTIONS) -> Column:
    """``train``/``val``/``test`` from a uniform number; the fractions must sum to one."""
    if abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError(f"split fractions must sum to 1.0, got {sum(fractions)}")
    train, val, _ = fractions
    return F.when(unit < train, "train").when(unit < train + val, "val").otherwise("test")


def spectrum_id():
    """Arrow UDF: blake2b-8 of dataset, raw file and scan joined by NUL, as signed bits.

    The value uses all 64 bits, so it is held as ``bigint`` with the same bits;
    :func:`unsigned` gives the decimal form.
    """

    @F.pandas_udf("bigint")
    def identifier(dataset: pd.Series, raw_file: pd.Series, scan: pd.Series) -> pd.Series:
        return pd.Series(
            [
                int.from_bytes(
                    hashlib.blake2b(f"{d}\0{r}\0{s}".encode(), digest_size=8).digest(),
                    "big",
                    signed=True,
                )
                for d, r, s in zip(dataset, raw_file, scan)
            ],
            dtype="int64",
        )

    return identifier


def unsigned(bits: Column) -> Column:
    """Signed 64-bit pattern as the unsigned number, ``decimal(20,0)``."""
    wide = bits.cast("decimal(20,0)")
    return F.when(bits < 0, wide + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide).cast(
        "decimal(20,0)"
    )


def signed(number: Column) -> Column:
    """Inverse of :func:`unsigned`."""
    wide = number.cast("decimal(20,0)")
    half = F.lit(str(2**63)).cast("decimal(20,0)")
    return (
        F.when(wide >= half, wide - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide).cast("bigint")
    )


def fingerprint(canonical_json: Column) -> Column:
    """sha256 of a canonical settings document."""
    return F.sha2(canonical_json, 256)
