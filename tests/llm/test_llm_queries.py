"""The registered queries against their SQL, and that all of them are there."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from trawlnet.llm import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = {n.split("_")[0] for n in queries.registered()}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(queries.registered()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_query(spark, name):
    df = queries.registered()[name](spark, SF_DIR)
    if name in oracles.oracles():
        assert difference(connect(SF_DIR), oracles.oracles()[name], df) is None
    else:
        assert df.collect()
