"""The driver contract: entry runs on sf0.001 with a stable schema; every
query key is callable; oracle keys are a subset of query keys."""

from importlib.util import find_spec

import __spark_entry__ as E


def test_entry_and_registry(spark):
    df = E.entry(spark)
    first = df.schema.simpleString()
    assert df.count() > 0
    assert E.entry(spark).schema.simpleString() == first
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70
    # the optional subpackage adds its queries, and only where it is there
    added = {k for k in q if k.startswith("op") or k == "pipeline"}
    assert bool(find_spec("furrow.llm") and find_spec("furrow.llm.queries")) == bool(added)
    assert len(q) - len(added) >= 72
