"""Ties that the queries' SQL leaves open do not depend on the order of rows; game ids of more than ten digits."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stintforge.functions import scalars as S
from stintforge.plans import registry


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_of_equal_numbers_the_smallest_player(spark, tmp_path, direction):
    """1000 * 1 - 0, 1000 * 2 - 1000 and 1000 * 3 - 2000 are the same number."""
    con = duckdb.connect()
    con.execute(f"copy (select 7::bigint as l_orderkey, 1::bigint as l_partkey, (k * 1000)::bigint as l_suppkey, (k + 1)::int as l_linenumber, (k + 1)::double as l_quantity, 10.0 as l_extendedprice, 0.0 as l_discount, 0.0 as l_tax, 'R' as l_returnflag, 'O' as l_linestatus, timestamp '1996-01-02' as l_shipdate from range(3) t(k) order by k {direction}) to '{tmp_path}/lineitem.parquet'")
    con.execute(f"copy (select 7::bigint as o_orderkey, 3::bigint as o_custkey, 'F' as o_orderstatus, timestamp '1996-01-01' as o_orderdate, 'x' as o_orderpriority) to '{tmp_path}/orders.parquet'")
    found = {q: registry.queries()[q](spark, str(tmp_path)).collect() for q in ("agg22_argmax_minutes", "joi06_top_member_faced", "joi07_faced_top")}
    assert [r.main for r in found["agg22_argmax_minutes"]] == [0]
    assert sorted(r.player for r in found["joi06_top_member_faced"]) == [1000, 2000]
    assert [r.player for r in found["joi07_faced_top"] if r.is_top] == [0]


def test_season_of_long_game_ids(spark):
    ids = [29600001, 71270992081, 999999999999]
    rows = spark.createDataFrame([(x,) for x in ids], "id long").select("id", S.season_of_game(F.col("id")).alias("season")).collect()
    assert {r.id: r.season for r in rows} == {x: (1900 if x // 100000 % 100 >= 90 else 2000) + x // 100000 % 100 + 1 for x in ids}
