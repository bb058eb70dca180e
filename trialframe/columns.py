"""Column helpers: quoting of dotted names, type classes, NaN handling."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def q(name: str) -> str:
    """Back-tick a column name, so that ``WOMAC.Pain.0`` is one name and not a path."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def num(name: str) -> Column:
    """The column as a double (all numeric work is done on doubles)."""
    return col(name).cast("double")


def _keys(id_col: str | list[str] | tuple[str, ...] | None) -> set[str]:
    if id_col is None:
        return set()
    return {id_col} if isinstance(id_col, str) else set(id_col)


def split_columns(df: DataFrame, id_col=None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names from the schema; id columns are in neither."""
    skip = _keys(id_col)
    numeric, categorical = [], []
    for field in df.schema.fields:
        if field.name in skip:
            continue
        if isinstance(field.dataType, T.NumericType):
            numeric.append(field.name)
        elif isinstance(field.dataType, (T.StringType, T.BooleanType)):
            categorical.append(field.name)
    return numeric, categorical


def resolve_columns(df: DataFrame, cols=None, id_col=None) -> list[str]:
    """Numeric columns of a user list, in the user's order; no list means all numeric columns."""
    numeric, _ = split_columns(df, id_col)
    if not cols:
        return numeric
    kept = [c for c in cols if c in numeric]
    ignored = [c for c in cols if c not in numeric]
    if ignored:
        log.warning("ignored, absent or not numeric: %s", ignored)
    return kept


def keep_existing(df: DataFrame, cols) -> DataFrame:
    """Projection on those names of a list that the table still has."""
    return df.select(*[col(c) for c in cols if c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is the same as missing for a cohort table; Spark tells them apart, so make them null."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def preview(df: DataFrame, cols=None, n: int = 5) -> DataFrame:
    """The first ``n`` rows of chosen columns."""
    return keep_existing(df, cols or df.columns).limit(n)


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """Rows with a value in every listed column."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & col(c).isNotNull()
    return df.filter(keep)
