import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from flowlens.functions.quantiles import exact_quantiles

PROBS = (0.0, 0.25, 1 / 3, 0.5, 0.95, 1.0)


def frame(spark, columns, parts=4):
    n = len(next(iter(columns.values())))
    rows = [tuple(None if columns[c][i] is None else float(columns[c][i]) for c in columns) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(parts)


@pytest.mark.parametrize("options", [{}, {"sketch_size": 64, "ranked_rows": 20}, {"sketch_size": 200, "ranked_rows": 100}])
def test_matches_numpy(spark, options):
    """Small sketches and brackets force the repeated narrowing a large table would see."""
    rng = np.random.default_rng(3)
    cols = {
        "wide": rng.normal(size=3000),
        "skewed": rng.exponential(size=3000) ** 4,
        "third_hot": np.where(rng.random(3000) < 0.34, 7.0, rng.normal(7, 5, 3000)),
        "two_hot": np.where(rng.random(3000) < 0.5, 0.0, 1.0),
        "ends_hot": np.concatenate([np.zeros(1499), [0.3, 0.4], np.ones(1499)]),
        "constant": np.full(3000, 2.5),
        "ints": rng.integers(0, 40, 3000),
    }
    df = frame(spark, cols)
    got = exact_quantiles(df, {c: F.col(c) for c in cols}, PROBS, **options)
    for c, v in cols.items():
        assert np.allclose(got[c], np.quantile(v, PROBS), rtol=0, atol=1e-12), c


def test_groups_nulls_and_empty(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("a", 2.0, None), ("a", None, None), ("b", 10.0, None), ("c", 5.0, None),
         ("b", float("nan"), None)],
        "g string, x double, e double",
    )
    got = exact_quantiles(df, {"x": F.col("x"), "e": F.col("e")}, (0.5,), F.col("g"), ["a", "b", "z"])
    assert got == {
        ("a", "x"): [1.5], ("a", "e"): [None], ("b", "x"): [10.0], ("b", "e"): [None],
        ("z", "x"): [None], ("z", "e"): [None],
    }


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1.0, -3.5, 2.25, 1e9, 7.0, 8.0]) | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_any_values(spark, values):
    got = exact_quantiles(
        frame(spark, {"v": values}, 3), {"v": F.col("v")}, PROBS, sketch_size=8, ranked_rows=2
    )
    assert np.allclose(got["v"], np.quantile(np.array(values), PROBS), rtol=1e-12, atol=1e-9)


def test_two_scans_of_the_source(spark):
    """Values without a frequent one: the sketch and one count read the rows, the rest what was written."""
    rng, n = np.random.default_rng(8), 20_000
    values, groups = rng.normal(size=n), rng.integers(0, 3, size=n)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def read(v):
        seen.add(1)
        return v

    df = spark.createDataFrame([(float(v), int(g)) for v, g in zip(values, groups)], "v double, k int").repartition(4)
    got = exact_quantiles(df, {"v": read("v")}, PROBS, sketch_size=200, ranked_rows=50)
    assert np.allclose(got["v"], np.quantile(values, PROBS), rtol=0, atol=1e-12) and seen.value == 2 * n
    by = exact_quantiles(df, {"v": read("v")}, PROBS, F.col("k"), [0, 1, 2], sketch_size=200, ranked_rows=50)
    for k in range(3):
        assert np.allclose(by[k, "v"], np.quantile(values[groups == k], PROBS), rtol=0, atol=1e-12)
    assert seen.value == 4 * n
