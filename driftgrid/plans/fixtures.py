"""Adapters: the driver tables as pairs, cells, observations, matches, ties, acquisitions, points and samples.

Each is SQL that runs alike in Spark and DuckDB; {name} stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "pairs_fx": """SELECT s_suppkey AS pair_id, CAST(s_suppkey % 2 AS INT) AS pass_type,
        CAST(2458849.5 + (s_suppkey * 7) % 180 AS DOUBLE) AS jd1, CAST(6 * (1 + s_suppkey % 4) AS DOUBLE) AS n_days,
        CASE WHEN s_suppkey % 5 <> 0 THEN 1 ELSE 0 END AS cross_flag, CAST(1.0 AS DOUBLE) AS weight,
        CAST(s_suppkey - 3 AS INT) AS i_min, CAST(s_suppkey + 6 AS INT) AS i_max,
        CAST((s_suppkey * 5) % 9 AS INT) AS j_min, CAST((s_suppkey * 5) % 9 + 11 AS INT) AS j_max FROM {supplier}""",
    "cells_fx": """SELECT CAST(floor(p_partkey / 20) AS INT) AS i, CAST(p_partkey % 20 AS INT) AS j, p_retailprice AS z,
        CASE WHEN p_size < 4 THEN 5 WHEN p_size < 8 THEN 1 WHEN p_size < 10 THEN 2 ELSE 0 END AS code FROM {part}""",
    "obs_fx": """SELECT s.s_suppkey AS pair_id, CAST(floor(p.p_partkey / 20) AS INT) AS i, CAST(p.p_partkey % 20 AS INT) AS j,
        CAST((p.p_size - 25) * 4.0 + s.s_suppkey % 10 AS DOUBLE) AS vx, CAST((p.p_partkey % 17) * 3.0 - s.s_suppkey % 7 AS DOUBLE) AS vy,
        CAST(1.0 + (p.p_partkey * 7 + s.s_suppkey * 3) % 5 AS DOUBLE) AS sx, CAST(1.0 + (p.p_partkey * 3 + s.s_suppkey) % 4 AS DOUBLE) AS sy,
        CAST(s.s_suppkey - 3 AS INT) AS i_min, CAST(s.s_suppkey + 6 AS INT) AS i_max,
        CAST((s.s_suppkey * 5) % 9 AS INT) AS j_min, CAST((s.s_suppkey * 5) % 9 + 11 AS INT) AS j_max,
        CAST(0.5 + 0.1 * (s.s_suppkey % 5) AS DOUBLE) AS weight, CAST(s.s_suppkey % 9 - 4 AS DOUBLE) AS dt, CAST(p.p_size * 0.01 AS DOUBLE) AS vz
        FROM {supplier} s JOIN {part} p ON CAST(floor(p.p_partkey / 20) AS INT) BETWEEN s.s_suppkey - 3 AND s.s_suppkey + 5
        WHERE p.p_partkey % 20 >= (s.s_suppkey * 5) % 9 AND p.p_partkey % 20 < (s.s_suppkey * 5) % 9 + 11
        AND (p.p_partkey * 13 + s.s_suppkey * 5) % 11 <> 0""",
    "radar_fx": """SELECT s.s_suppkey AS pair_id, CAST(floor(p.p_partkey / 20) AS INT) AS i, CAST(p.p_partkey % 20 AS INT) AS j,
        CAST((p.p_size - 25) * 0.4 + s.s_suppkey % 10 * 0.1 AS DOUBLE) AS dr, CAST((p.p_partkey % 17) * 0.3 - s.s_suppkey % 7 * 0.2 AS DOUBLE) AS da,
        CAST(0.05 + (p.p_partkey * 7 + s.s_suppkey * 3) % 5 * 0.01 AS DOUBLE) AS sr, CAST(0.1 + (p.p_partkey * 3 + s.s_suppkey) % 4 * 0.02 AS DOUBLE) AS sa,
        CAST(0.5 + p.p_partkey % 9 * 0.01 AS DOUBLE) AS psi, CAST(CASE WHEN s.s_suppkey % 2 = 0 THEN 0.3 ELSE 2.4 END + p.p_partkey % 7 * 0.01 AS DOUBLE) AS heading,
        CAST(p.p_partkey % 11 * 0.02 AS DOUBLE) AS xy, CAST(p.p_retailprice AS DOUBLE) AS z, CAST((p.p_partkey * 7 % 13 - 6) * 0.03 AS DOUBLE) AS dzdx, CAST((p.p_partkey * 5 % 11 - 5) * 0.01 AS DOUBLE) AS dzdy,
        CASE WHEN p.p_size < 4 THEN 5 WHEN p.p_size < 8 THEN 1 WHEN p.p_size < 10 THEN 2 ELSE 0 END AS code, CAST(6 * (1 + s.s_suppkey % 4) AS DOUBLE) AS n_days,
        CAST(0.5 + 0.1 * (s.s_suppkey % 5) AS DOUBLE) AS weight, CAST(s.s_suppkey % 9 - 4 AS DOUBLE) AS dt, CAST(0.3 AS DOUBLE) AS tide_rate, CAST(0.1 AS DOUBLE) AS submergence,
        CAST(s.s_suppkey - 3 AS INT) AS i_min, CAST(s.s_suppkey + 6 AS INT) AS i_max, CAST((s.s_suppkey * 5) % 9 AS INT) AS j_min, CAST((s.s_suppkey * 5) % 9 + 11 AS INT) AS j_max
        FROM {supplier} s JOIN {part} p ON CAST(floor(p.p_partkey / 20) AS INT) BETWEEN s.s_suppkey - 3 AND s.s_suppkey + 5
        WHERE p.p_partkey % 20 >= (s.s_suppkey * 5) % 9 AND p.p_partkey % 20 < (s.s_suppkey * 5) % 9 + 11
        AND (p.p_partkey * 13 + s.s_suppkey * 5) % 11 <> 0""",
    "matches_fx": """SELECT s_suppkey AS match_id, CAST((s_suppkey * 5) % 9 * 100.0 + 30.0 AS DOUBLE) AS x0, CAST((s_suppkey - 3) * 100.0 + 20.0 AS DOUBLE) AS y0,
        CAST(25.0 AS DOUBLE) AS dx, CAST(25.0 AS DOUBLE) AS dy, 8 AS nx, 8 AS ny, 10 AS step_x, 10 AS step_y,
        CAST(2458849.5 + (s_suppkey * 7) % 180 AS DOUBLE) AS jd_early, CAST(2458849.5 + (s_suppkey * 7) % 180 + 6 * (1 + s_suppkey % 4) AS DOUBLE) AS jd_late,
        CAST(0.01 * (s_suppkey % 3) AS DOUBLE) AS px0, CAST(0.000001 * (s_suppkey % 5) AS DOUBLE) AS px1, CAST(-0.000001 * (s_suppkey % 4) AS DOUBLE) AS px2,
        CAST(-0.01 * (s_suppkey % 4) AS DOUBLE) AS py0, CAST(0.000001 * (s_suppkey % 3) AS DOUBLE) AS py1, CAST(0.000001 * (s_suppkey % 2) AS DOUBLE) AS py2,
        CAST(1.5 AS DOUBLE) AS sigma_x_res, CAST(2.0 AS DOUBLE) AS sigma_y_res, CAST(0.04 AS DOUBLE) AS mean_sigma_x, CAST(0.05 AS DOUBLE) AS mean_sigma_y FROM {supplier}""",
    "optical_cells_fx": """SELECT l_suppkey AS match_id, CAST(floor(l_partkey % 64 / 8) AS INT) AS i, CAST(l_partkey % 8 AS INT) AS j,
        CAST((max(l_quantity) - 25) * 0.02 + 0.01 * (l_suppkey % 7) AS DOUBLE) AS dx, CAST(count(*) % 17 * 0.015 - 0.02 * (l_suppkey % 5) AS DOUBLE) AS dy,
        CAST(0.02 + max(l_discount) / 2 AS DOUBLE) AS sx, CAST(0.03 + max(l_tax) / 4 AS DOUBLE) AS sy
        FROM {lineitem} WHERE (l_partkey % 64 * 13 + l_suppkey * 5) % 23 <> 0 GROUP BY l_suppkey, l_partkey % 64, l_partkey % 8""",
    "ties_fx": """SELECT l_suppkey AS pair_id, (l_quantity - 25) / 500 AS theta_d, (l_discount - 0.05) * 10 AS x,
        CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 10.0 END AS DOUBLE) AS weight,
        -12.5 * sin((l_quantity - 25) / 500) - 3.0 * (l_discount - 0.05) * 10 * cos((l_quantity - 25) / 500)
        + 2.0 * (l_discount - 0.05) * 10 * sin((l_quantity - 25) / 500) + 0.75 + (l_tax - 0.04) * 0.1 AS y FROM {lineitem}""",
    "acquisitions_fx": """SELECT o_orderkey AS image_id, CAST(o_orderdate AS DATE) AS image_date, CAST(6 * (1 + o_orderkey % 8) AS DOUBLE) AS n_days,
        o_totalprice / 1000.0 AS value, CAST(o_orderkey % 50 AS INT) AS i, CAST(o_custkey % 20 AS INT) AS j, CAST(o_orderkey % 2 AS INT) AS pass_type FROM {orders}""",
    "points_fx": """SELECT c_custkey AS point_id, CAST(60.0 + (c_custkey % 2900) / 100.0 AS DOUBLE) AS lat, CAST((c_custkey * 37 % 36000) / 100.0 AS DOUBLE) AS lon,
        c_acctbal / 10.0 AS h FROM {customer}""",
    "samples_fx": """SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 10.0 AS dr, (l_discount - 0.05) * 20 AS da, 0.01 + l_tax AS sr, l_tax * 3 - 0.02 AS sa,
        0.3 + l_quantity / 200.0 AS theta, 0.4 + l_quantity / 150.0 AS psi, (l_quantity - 25) / 500 AS theta_d, CAST(6 * (1 + l_suppkey % 4) AS DOUBLE) AS n_days,
        CAST(850000 + (l_partkey % 1000) * 7 AS DOUBLE) AS slant, (l_discount - 0.05) * 2 AS dzdr, l_tax - 0.04 AS dzda,
        CASE l_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 0 END AS code, l_extendedprice / 10 AS z, (l_discount - 0.05) * 10 AS x,
        CAST(l_suppkey % 7 * 20 AS DOUBLE) AS bn, CAST(l_suppkey % 5 * 30 AS DOUBLE) AS bp, CAST(l_partkey % 628 AS DOUBLE) / 100 AS heading,
        CAST(l_suppkey % 314 AS DOUBLE) / 100 AS xy FROM {lineitem}""",
}


#: The join of pairs with the rows of cells in reach: a range in the SQL, for Spark an equi-join on the rows that a pair reaches.
BAND = "FROM {supplier} s JOIN {part} p ON CAST(floor(p.p_partkey / 20) AS INT) BETWEEN s.s_suppkey - 3 AND s.s_suppkey + 5"
EQUAL = "FROM (SELECT s_suppkey, explode(sequence(s_suppkey - 3, s_suppkey + 5)) AS reached FROM {supplier}) s JOIN (SELECT *, floor(p_partkey / 20) AS own FROM {part}) p ON p.own = s.reached"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter over the tables of a folder. Spark compares every pair with every cell in a join on a range, so bands are joined on their rows, by
    sorting: Spark takes the exploded pairs to be as small as their table, and would send all of them to the driver and to every task."""
    sql = SQL[name]
    if BAND in sql:
        sql = sql.replace(BAND, EQUAL).replace("SELECT", "SELECT /*+ MERGE(s) */", 1)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "part", "orders", "customer", "lineitem", "events") if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)


def with_fixtures(*names: str) -> str:
    """The WITH clause of the named adapters, for DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n].format(**{t: t for t in ('supplier', 'part', 'orders', 'customer', 'lineitem', 'events')})})" for n in names)
