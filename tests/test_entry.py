import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from collatrix.plans import oracles, queries, reports  # noqa: F401  reports registers queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    plain = frame.map(lambda x: tuple(map(str, x)) if isinstance(x, (list, np.ndarray)) else x)
    return plain.sort_values(list(plain.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_agree_with_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    expected = ordered(con.sql(oracles.ORACLES[name]).df())
    got = ordered(queries.queries()[name](spark, data).toPandas())
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.ORACLES)))
def test_other_queries_run(spark, data, name):
    assert queries.queries()[name](spark, data).columns


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))


def test_mapped_references_keep_first_rows(spark, data, tmp_path):
    # The first file is the smaller one, which Spark reads last.
    con = duckdb.connect(config={"threads": 1})
    os.makedirs(tmp_path / "lineitem.parquet")
    again = "l_orderkey, l_partkey % 90 + 1 AS l_partkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END AS l_returnflag, CASE l_linestatus WHEN 'O' THEN 'F' ELSE 'O' END AS l_linestatus"
    con.execute(f"COPY (SELECT {again} FROM '{data}/lineitem.parquet' WHERE l_orderkey % 3 = 0) TO '{tmp_path}/lineitem.parquet/part-0.parquet'")
    con.execute(f"COPY (SELECT * FROM '{data}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet/part-1.parquet'")
    con.execute(f"COPY (SELECT * FROM '{data}/part.parquet') TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet', union_by_name=true)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    expected = ordered(con.sql(oracles.ORACLES["mapped_references"]).df())
    got = ordered(queries.queries()["mapped_references"](spark, str(tmp_path)).toPandas())
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)
