import pytest

from tests.oracle import same
from tidewright import registry

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    same(registry.queries()[name](spark, sf), ORACLE[name], sf)


@pytest.mark.parametrize("name", ["regime_quadrants", "asof_backward", "asof_forward", "interval_join", "resting_fills", "silence_flags", "ten_level_flow", "volume_roll", "kama_signal"])
def test_matches_sql_at_ten_times_the_size(spark, name):
    folder = "/root/testdata/sf0.01"
    same(registry.queries()[name](spark, folder), ORACLE[name], folder)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_runs_without_sql(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["date", "gross", "turnover", "costs", "net", "exposure", "trades"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
