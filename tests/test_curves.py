import numpy as np
import pandas as pd
import pytest

from urbangrid.operators.curves import fit_power


def _table(spark, a, b, c, noise, n=3000, seed=1, low=0.001, high=5.0):
    rng = np.random.default_rng(seed)
    x = np.exp(rng.uniform(np.log(low), np.log(high), n))
    return spark.createDataFrame(pd.DataFrame({"x": x, "y": a * x**b + c + rng.normal(0, noise, n)})), x


def _dense(x, y, bound=100.0, lo=-10.0, hi=10.0):
    """The least sum of squares over a dense grid of b, with the best a and c of the box for each (active bounds by trying them)."""
    best = (np.inf, None)
    mid = np.exp(np.log(x).mean())
    for b in np.linspace(lo, hi, 4001):
        if abs(b) < 1e-9:
            continue
        z, top = (x / mid) ** b, bound * mid**b
        tries = []
        m = np.stack([z, np.ones_like(z)], 1)
        tries.append(np.linalg.lstsq(m, y, rcond=None)[0])
        tries += [(a, np.clip((y - a * z).mean(), -bound, bound)) for a in (-top, top)]
        tries += [(np.clip((z * (y - c)).sum() / (z * z).sum(), -top, top), c) for c in (-bound, bound)]
        for a, c in tries:
            if abs(a) <= top * (1 + 1e-12) and abs(c) <= bound:
                best = min(best, (float(((y - a * z - c) ** 2).sum()), float(b)))
    return best


@pytest.mark.parametrize("a, b, c, noise", [(-2.0, 0.4, 3.0, 0.3), (4.0, -0.7, -20.0, 1.0), (150.0, 1.5, 0.0, 5.0), (3.0, 0.5, 180.0, 0.5), (-160.0, 0.8, -140.0, 1.0), (2.0, 2.5, 1.0, 0.0)])
def test_fit_is_no_worse_than_a_dense_grid(spark, a, b, c, noise):
    df, x = _table(spark, a, b, c, noise)
    y = df.toPandas()["y"].to_numpy()
    p = fit_power(df, "x", "y")
    assert abs(p["a"]) <= 100 * (1 + 1e-9) and abs(p["c"]) <= 100 * (1 + 1e-9) and abs(p["b"]) <= 10
    sse = float(((y - p["a"] * x ** p["b"] - p["c"]) ** 2).sum())
    least, at = _dense(x, y)
    assert sse <= least * (1 + 1e-9) + 1e-6
    assert abs(p["b"] - at) < 0.006 or sse < least * (1 - 1e-12)


def test_rows_without_a_curve_take_no_part(spark):
    rows = [(float(k), 2.0 * k**0.5 + 1) for k in range(1, 60)] + [(0.0, 5.0), (-1.0, 5.0), (None, 1.0), (1.0, None), (float("nan"), 1.0), (2.0, float("inf"))]
    p = fit_power(spark.createDataFrame(rows, "x double, y double"), "x", "y")
    assert [round(p[k], 5) for k in "abc"] == [2.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        fit_power(spark.createDataFrame([(0.0, 1.0)], "x double, y double"), "x", "y")


def test_equal_x_and_a_single_row(spark):
    p = fit_power(spark.createDataFrame([(2.0, 3.0), (2.0, 5.0)], "x double, y double"), "x", "y")
    assert abs(p["a"] * 2.0 ** p["b"] + p["c"] - 4.0) < 1e-6
    p = fit_power(spark.createDataFrame([(2.0, 3.0)], "x double, y double"), "x", "y")
    assert abs(p["a"] * 2.0 ** p["b"] + p["c"] - 3.0) < 1e-6
