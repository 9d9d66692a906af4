"""Every query with SQL gives the same rows on DuckDB (smallest tables)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles  # noqa: E402
from basketwise.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SF)


# minutes of model fits each: tools/check_oracles.py compares them, test_pipeline.py tests their functions on small data
LONG = {"model_spot_check", "model_nested_cv", "model_resume", "model_grouped_run", "model_oof_scores"}


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - LONG))
def test_same_rows(spark, con, name):
    status, note, _ = check_oracles.compare(spark, con, name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
    assert status in ("ok", "EMPTY"), note


def test_registry_is_consistent():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 120
