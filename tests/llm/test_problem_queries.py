"""The problems' queries on the smallest tables, against their SQL where they have one."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from corvane.llm import queries as llm


@pytest.mark.parametrize("name", list(llm.QUERIES))
def test_query(spark, small, name):
    got = llm.QUERIES[name](spark, small).toArrow()
    if name not in llm.ORACLE:
        assert got.num_rows > 0 or name == "p9_mix"  # of a hundred documents no source may be able to give its share
        return
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = con.sql(llm.ORACLE[name]).to_arrow_table()
    names = sorted(want.schema.names)
    assert names == sorted(got.schema.names)
    rows = lambda t: Counter(zip(*(map(repr, t.column(n).to_pylist()) for n in names), strict=True))
    assert rows(got) == rows(want)


def test_mixture_of_a_larger_table(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    assert llm.p9_mix(spark, folder).count() > 0
    assert {(r.within_cap, r.met) for r in llm.p9_bounds(spark, folder).collect()} == {(True, True)}
