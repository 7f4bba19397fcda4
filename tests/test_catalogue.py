"""Every registered query against its SQL, over whole tables."""

import pytest
from oracle import connect, duck_rows, spark_rows

from cohortsift.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    wanted = duck_rows(duck, ORACLES[name])
    found = spark_rows(df)
    assert sum(wanted.values()) > 0
    assert sorted(df.columns) == sorted(d[0] for d in duck.execute(ORACLES[name]).description)
    assert found == wanted, (list((found - wanted).items())[:3], list((wanted - found).items())[:3])
