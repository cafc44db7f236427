"""Every registered query against its DuckDB twin on the smallest tables, with several chunks per scan."""

import pytest

from orderweave.plans.catalog import forget, load_all
from orderweave.session import CHUNKS_CONF
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module", autouse=True)
def several_chunks(spark):
    forget()
    spark.conf.set(CHUNKS_CONF, "4")
    yield
    spark.conf.unset(CHUNKS_CONF)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query(name, spark, duck):
    assert compare(duck, spark, SF, load_all()[name]) is None
