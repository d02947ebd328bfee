"""The registered queries run, and agree with their SQL on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as contract
from helixframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    def cell(v):
        if pd.isna(v):
            return None
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
            return v if isinstance(v, str) else bool(v)
        return round(float(v), 6)

    names = sorted(df.columns)
    return names, sorted((tuple(cell(v) for v in row) for row in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert plain(got) == plain(duck.sql(contract.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    df = contract.queries()[name](spark, SF)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and df.columns
    again = sorted(tuple(map(str, r)) for r in contract.queries()[name](spark, SF).collect())
    assert sorted(rows) == again  # the same whenever it is computed


def test_tandems_of_the_whole_part_table(spark):
    part = pd.read_parquet(f"{SF}/part.parquet")
    texts = {str(k): (t[: 1 + k % 4] * (3 + k % 5) + n).lower() for k, t, n in zip(part.p_partkey, part.p_type, part.p_name)}
    want = set()
    for name, t in texts.items():
        for a in range(len(t)):
            for unit in range(1, len(t) - a):
                n = next((i for i in range(len(t) - a - unit) if t[a + i] != t[a + unit + i]), len(t) - a - unit)
                if n >= max(6, unit) and (a == 0 or t[a - 1] != t[a + unit - 1]):
                    want.add((name, a + 1, unit + n, unit))
                    break
    got = catalog.QUERIES["exact_tandems_part"](spark, SF).collect()
    assert {(r.seq_id, r.start, r.extent, r.unit) for r in got} == want and len(got) == len(want)
    assert any(int(r.seq_id) % 10 for r in got)


def test_every_alignment_is_annotated(spark):
    whole = {r.aln_id for r in catalog.QUERIES["overlap_annotation"](spark, SF).collect()}
    assert whole == {r.aln_id for r in catalog._alignments(spark, SF).select("aln_id").collect()}


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
