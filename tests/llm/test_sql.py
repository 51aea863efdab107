"""The queries of this subpackage that SQL expresses, against their SQL; quality rules also where cutoffs are certified."""

import glob
import os

import duckdb
import pytest

from seqforge.llm import queries


def plain(rows):
    return sorted(tuple(repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name, scale", [*((n, "sf0.001") for n in sorted(queries.ORACLES)), ("op8_quality_rules", "sf0.1")])
def test_query_matches_sql(spark, name, scale):
    con = duckdb.connect()
    for path in glob.glob(f"/root/testdata/{scale}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = queries.QUERIES[name](spark, f"/root/testdata/{scale}")
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want) != []
