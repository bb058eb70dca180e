"""Preparation and exploration of cohort tables on Spark.

Every operator takes DataFrames and returns DataFrames.  ``id_col`` names the key of a
participant; nothing is matched by position.
"""

from trialframe.columns import (
    complete_cases,
    keep_existing,
    nan_to_null,
    preview,
    resolve_columns,
    split_columns,
)
from trialframe.plans.pipeline import Discovery, PrepConfig, discover, prepare

__all__ = [
    "Discovery",
    "PrepConfig",
    "complete_cases",
    "discover",
    "keep_existing",
    "nan_to_null",
    "prepare",
    "preview",
    "resolve_columns",
    "split_columns",
]
