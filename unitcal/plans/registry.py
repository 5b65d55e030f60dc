"""Registration of named queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Entry(run, sql)
        return run

    return register


def round_scaled(c: Column, digits: int) -> Column:
    """Rounds the scaled double, half away from zero, as the SQL does.

    Spark's own ``round`` goes by the decimal digits instead, and a value a few units in the last place below a tie
    falls on the other side of it.
    """
    scaled = c * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(c)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: round_scaled(F.col(c), special.get(c, digits)) for c in doubles})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
