import pytest

from faultline.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name])
