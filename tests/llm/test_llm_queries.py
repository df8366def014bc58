"""Every query over training data against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from utterlake.llm import registry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="test tables aren't here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(name, compare):
    compare(registry.queries()[name], registry.oracle_sql()[name], ROOT)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(name, spark):
    registry.queries()[name](spark, ROOT).count()
