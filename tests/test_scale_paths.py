"""Quantiles and joins with null keys, empty variables and without broadcasts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import explore
from trialframe.plans import joins
from trialframe.plans.quantiles import exact_quantiles


def test_join_keyed_matches_null_keys(spark):
    big = spark.range(1_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"), F.col("id").alias("v"))
    keyed = spark.createDataFrame([("hot", 1), (None, 2)], "k string, w int")
    got = joins.join_keyed(big, keyed, ["k"]).collect()
    assert len(got) == 1_000 and all(r.w == (2 if r.k is None else 1) for r in got)


def test_quantiles_without_broadcast(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", None], 900), "x": rng.normal(size=900)})
    df = spark.createDataFrame(pdf).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = exact_quantiles(df, ["x"], [0.2, 0.5], ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = {r["g"]: r["q"] for r in rows}
    for g in ("a", None):
        part = pdf[pdf["g"].isna()] if g is None else pdf[pdf["g"] == g]
        assert got[g] == pytest.approx(np.percentile(part["x"], [20, 50]))


def test_quantiles_of_a_variable_without_values_are_null(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, None)],
                               "g string, x double, y double")
    got = {(r["g"], r["variable"]): r["q"]
           for r in exact_quantiles(df, ["x", "y"], [0.5], ["g"]).collect()}
    assert {k: v and v[0] for k, v in got.items()} == {
        ("a", "x"): 2.0, ("a", "y"): None, ("b", "x"): None, ("b", "y"): None}


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0)], "g string, x double")
    got = {r["g"]: r["median"] for r in explore.summarize(df, ["x"], ["g"]).collect()}
    assert got == {"a": 1.5, None: 5.0}
    assert explore.box_stats(df, ["x"], ["g"]).count() == 2
