"""The driver contract of __spark_entry__.py."""

import re

import __spark_entry__ as E


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90
    for name, fn in q.items():
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name), name
        assert callable(fn)
    from churnlytics.plans.oracle import all_oracles
    for name, sql in all_oracles().items():
        assert o[name] == sql
        assert sql.lstrip().upper().startswith("WITH CONTRACTS AS"), name


def test_entry_schema_is_stable(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert a.count() == b.count() > 0
