import os

import pytest

import __spark_entry__ as entry
from compare import check, duck
from volpanel.workload import queries as registered

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_every_query_has_an_oracle():
    own = set(registered.REGISTRY)
    assert own <= set(entry.queries()) and own <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize(
    "name",
    ["bars_daily", "surprise_zscore", "spike_days", "asof_intraday", "asof_release_date", "front_contract_filled", "hp_gap",
     "ablation_credibility", "horizon_sweep", "band_grid_dsr", "source_price_report", "stream_daily_share"],
)
def test_query_equals_its_oracle(spark, con, name):
    assert check(spark, con, SF, name)[0] == "ok"
