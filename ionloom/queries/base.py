"""What a query is, and helpers the query modules share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal, localcontext
from math import inf, isfinite

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.queries import views
from ionloom.session import shared_folder, tune
from ionloom.sinks.library_writer import decimals

DIGITS = 6


@dataclass(frozen=True)
class Query:
    """A named Spark query, the survey items it shows, and the equivalent SQL when there is one."""

    name: str
    items: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Book:
    """Collects the queries of one module."""

    def __init__(self) -> None:
        self.queries: list[Query] = []

    def add(self, name: str, *items: str, needs: tuple[str, ...] = (), sql: str | None = None):
        """Register the decorated function. ``needs`` names the stand-in views the SQL uses."""
        text = None if sql is None else views.with_views(needs, sql)

        def register(build):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return tidy(build(tune(spark), sf_dir))

            self.queries.append(Query(name, items, run, text))
            return build

        return register


def tidy(df: DataFrame) -> DataFrame:
    """Result types that read the same in every engine: bigint, rounded double, text, boolean."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            column = F.round(column.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(kind, T.DecimalType):
            column = column.cast("string")
        out.append(column.alias(field.name))
    return df.select(*out)


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run's files, below the shared folder."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def half_even(value: float, places: int) -> str:
    """A number with fixed decimals as :func:`ionloom.sinks.libraries.fixed` writes it: an exact half goes to the even digit."""
    if not isfinite(value):
        return {inf: "Infinity", -inf: "-Infinity"}.get(value, "NaN")
    with localcontext() as context:
        context.prec = 400
        text = f"{Decimal(repr(value)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN):f}"
    return text if text.strip("-0.") else text.lstrip("-")


def joined(values, digits: int = DIGITS):
    """An array of numbers as text with fixed decimals, for results without array columns; one Arrow pass."""

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        missing = lists.is_null().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        numbers = lists.flatten()
        written = decimals(numbers.fill_null(0.0).to_numpy(zero_copy_only=False), digits, half_even).cast(pa.string())
        written = pc.if_else(numbers.is_valid(), written, "null"[:digits])  # as a format with that precision writes it
        ends = np.concatenate([[0], np.cumsum(np.where(missing, 0, sizes))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, mask=np.concatenate([missing, [False]])), written), ";")

    return text(values.cast("array<double>") if isinstance(values, Column) else F.col(values).cast("array<double>"))
