"""Bases at all of their places."""

import numpy as np
import pytest

from undula.plans import catalog


@pytest.mark.parametrize("name, terms", [("bspline_basis", 9), ("fourier_basis_cos_sin", 9), ("fourier_basis_sin_cos", 9), ("legendre_basis", 7)])
def test_bases_hold_all_places(spark, sf, name, terms):
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert sorted((r.t, r.k) for r in rows) == [(t, k) for t in range(40) for k in range(terms)]


def test_places_reach_over_the_curves(spark, sf):
    assert np.allclose(catalog._places_of(spark, sf), np.linspace(0, 1, 40), atol=1e-15)
