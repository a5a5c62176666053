"""Every registered query against its DuckDB oracle on the smallest tables (sf0.001)."""

import os
import sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

from tonegauge.plans import registry

SF = "/root/testdata/sf0.001"
registry.load_all()
NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    import oracle_harness as H
    return H.duck(SF)


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import oracle_harness as H
    r = H.compare(spark, con, name, registry.QUERIES[name], registry.ORACLE.get(name), SF)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry_runs(spark):
    import importlib.util
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() == 3
    assert set(mod.oracle_sql()) <= set(mod.queries())
