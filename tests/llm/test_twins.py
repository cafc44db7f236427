from types import SimpleNamespace

import pytest

from orderweave.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, connect
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    assert compare(connect(SF), spark, SF, SimpleNamespace(run=QUERIES[name], oracle=ORACLE_SQL[name])) is None
