"""Fitted curves at places of their own."""

import numpy as np
import pytest

from undula.operators import smoothing


@pytest.mark.parametrize("terms", [4, 5, 11])
def test_splines_at_any_place_equal_the_design(spark, terms):
    r = np.random.default_rng(terms)
    x = np.concatenate(([0, 1, 0.5, 1 / 3], np.linspace(0, 1, terms - 2), r.uniform(size=40)))
    c = r.normal(size=terms)
    coefs = spark.createDataFrame([(1, 0, c.tolist())], "sample_id long, feature int, c array<double>")
    places = spark.createDataFrame([(1, 0, float(v), k) for k, v in enumerate(x)] + [(1, 0, -0.1, 900), (1, 0, 1.1, 901), (2, 0, 0.5, 902), (1, 0, None, 903)], "sample_id long, feature int, x double, n int")
    got = {q.n: q.fit for q in smoothing.fits_at(coefs, places).collect()}
    assert np.allclose([got[k] for k in range(len(x))], smoothing.bspline_design(x, terms) @ c, atol=1e-12)
    assert [got[k] for k in range(900, 904)] == [None] * 4


def test_series_at_any_place_equal_the_design(spark):
    r = np.random.default_rng(2)
    x, c = r.uniform(-2, 2, 30), r.normal(size=7)
    df = spark.createDataFrame([(float(v), k, c.tolist()) for k, v in enumerate(x)], "x double, n int, c array<double>")
    got = [q.y for q in df.withColumn("y", smoothing.series_at("c", "x")).orderBy("n").collect()]
    assert np.allclose(got, smoothing.fourier_design(x, 3) @ c)
