"""Each core query against its SQL in DuckDB, at the smallest size."""

from __future__ import annotations

import datetime
import math

import pytest

from lodestone.plans import catalog
from tests.conftest import SF


def plain(rows, columns):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None).isoformat()
        return x

    return sorted(repr(tuple(one(r[c]) for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert rows
        return
    result = duck.sql(catalog.oracle_sql()[name])
    assert sorted(result.columns) == columns
    want = [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]
    assert plain(rows, columns) == plain(want, columns)


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() == 200
