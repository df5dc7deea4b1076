import pytest
from compare import same
from conftest import SMALL

from spanlake import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    left, right = same(plans.queries()[name](spark, SMALL), duck, SQL[name])
    assert left == right


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_has_rows(spark, name):
    assert plans.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
