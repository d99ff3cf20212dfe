"""Every registered q_ query against its SQL."""

import pytest

from lectio.plans import catalog


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return [names[i] for i in order], sorted(repr(tuple(one(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    assert canonical(got.columns, rows) == canonical([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "fused"]
