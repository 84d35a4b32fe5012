"""The length-of-stay regressors are fitted at the operator's own size."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from cohortlab.operators import ml
from conftest import SF_SMALL


@pytest.mark.parametrize("key", ["fit_los_random_forest", "fit_los_gbt"])
def test_los_regressors_have_100_trees(spark, monkeypatch, key):
    fitted, fit = [], ml.fit_tree_model
    monkeypatch.setattr(ml, "fit_tree_model", lambda *a, **kw: fitted.append(fit(*a, **kw)) or fitted[-1])
    E.queries()[key](spark, SF_SMALL)
    assert [m.stages[-1].getNumTrees for m in fitted] == [100]
