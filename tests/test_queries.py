import pytest

from ledgerloom.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same(frame, duck.execute(ORACLE_SQL[name]))
    else:
        assert frame.count() > 0
