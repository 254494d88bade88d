"""Registered queries against their SQL on small tables with rows that the given ones lack."""

import datetime
import math

import duckdb
import pytest

from paneloom.plans import registry


def compare(spark, name, folder, tables):
    """The query's rows and its SQL's, sorted; NaN as a string."""
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracles()[name]})").fetchall()

    def plain(rows):
        return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows)

    got = plain(tuple(r[k] for k in columns) for r in got.collect())
    assert got == plain(want)
    return got


@pytest.mark.parametrize("zero", [0.0, -0.0])
def test_a_group_with_the_logarithm_of_zero_has_no_coefficients(spark, tmp_path, zero):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start, i * 7 % 13, "ab"[i % 2], 5 + (i * i) % 11 + i % 7 / 3) for i in range(60)]
    rows.append((60, start, 3, "a", zero))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = compare(spark, "st4_regress_k3", tmp_path, ["events"])
    assert [r.count("nan") for r in got] == [0, 3] or [r.count("nan") for r in got] == [3, 0]


def test_a_distant_key_outweighs_a_cent(spark, tmp_path):
    rows = [(1_000_000, 1, 10.0), (5, 1, 10.01), (7, 2, 3.0), (9, 2, 3.0), (2_000_000, 3, 1.0), (1, 3, 2.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").repartition(2).write.parquet(f"{tmp_path}/orders.parquet")
    assert compare(spark, "w11_unique_first", tmp_path, ["orders"]) == [(1, 5), (2, 7), (3, 2_000_000)]
