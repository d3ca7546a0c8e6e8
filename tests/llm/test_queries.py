import os

import pytest

from ledgerloom.llm import mixing
from ledgerloom.llm.queries import ORACLE, QUERIES
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, sf, name):
    if name.startswith("p8") and not os.path.exists(mixing.TOKENIZER):
        pytest.skip("no tokenizer file")
    assert agree(spark, sf, QUERIES[name], ORACLE.get(name))
