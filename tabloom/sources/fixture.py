"""The property table that the registered queries run on.

One row per order, derived by plain SQL from the ``orders``, ``lineitem`` and
``customer`` tables.  The same text runs unchanged in any ANSI engine, so a
query and its check start from identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.session import derive_once, tune_session
from tabloom.sources.tables import read_table

PROPERTY_SQL = """
WITH li AS (
  SELECT l_orderkey, COUNT(*) AS n_lines, SUM(CAST(l_quantity AS BIGINT)) AS qty,
         SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS qty_r,
         SUM(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS qty_o,
         COUNT(DISTINCT l_suppkey) AS n_supp
  FROM lineitem GROUP BY l_orderkey),
b AS (
  SELECT o.o_orderkey AS row_id, o.o_custkey AS ck, YEAR(o.o_orderdate) AS year_sold, MONTH(o.o_orderdate) AS month_sold,
         1930 + MOD(o.o_custkey, 70) AS year_built, o.o_orderpriority AS pr, o.o_orderstatus AS st,
         c.c_mktsegment AS zone, li.n_lines, li.qty, li.qty_r, li.qty_o, li.n_supp
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
f AS (
  SELECT row_id, CAST(year_sold AS INT) AS year_sold, CAST(month_sold AS INT) AS month_sold, CAST(year_built AS INT) AS year_built,
    CAST(CASE WHEN MOD(row_id, 4) = 0 THEN year_built ELSE year_built + MOD(row_id, 80) END AS INT) AS year_remodel,
    CAST(1 + MOD(row_id * 7, 10) AS INT) AS overall_quality, CAST(1 + MOD(row_id * 3 + ck, 10) AS INT) AS overall_condition,
    CASE WHEN MOD(row_id, 29) = 0 THEN 40000.0E0 + 100.0E0 * MOD(ck, 300) WHEN MOD(row_id, 6) = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(4000 + 13 * MOD(row_id, 500) AS DOUBLE) END AS land_area,
    CAST(600 + 4 * qty AS DOUBLE) AS ground_area, CAST(qty_r * 5 AS DOUBLE) AS upper_area,
    CASE WHEN MOD(row_id, 17) = 0 THEN CAST(NULL AS DOUBLE) WHEN MOD(row_id, 211) = 0 THEN 9000.0E0 ELSE CAST(qty_o * 6 AS DOUBLE) END AS basement_area,
    CAST(CASE WHEN MOD(ck, 3) = 0 THEN 0 ELSE MOD(ck, 400) END AS DOUBLE) AS terrace_area,
    CAST(CASE WHEN MOD(row_id, 50) = 0 THEN 300 ELSE 0 END AS DOUBLE) AS pool_area,
    CAST(n_lines AS INT) AS total_rooms, CAST(n_supp AS INT) AS full_baths, CAST(MOD(row_id, 3) AS INT) AS half_baths,
    CASE pr WHEN '1-URGENT' THEN 'Ex' WHEN '2-HIGH' THEN 'Gd' WHEN '3-MEDIUM' THEN 'TA' WHEN '4-NOT SPECIFIED' THEN 'Fa' ELSE NULL END AS kitchen_quality,
    zone, st AS road_type, CASE WHEN MOD(row_id, 40) = 0 THEN 'MnPrv' ELSE NULL END AS fence,
    CASE WHEN MOD(ck, 11) = 0 THEN 'N' ELSE 'Y' END AS central_ac,
    CAST(600 + 4 * qty + 5 * qty_r AS DOUBLE) AS usable_area,
    CAST(CASE WHEN MOD(row_id, 60) = 0 THEN 120 ELSE 0 END AS DOUBLE) AS low_quality_area,
    CASE WHEN MOD(row_id, 17) = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(MOD(row_id, 700) AS DOUBLE) END AS basement_unfinished_area,
    CAST(MOD(ck, 900) AS DOUBLE) AS basement_area1, CAST(CASE WHEN MOD(row_id, 9) = 0 THEN MOD(row_id, 300) ELSE 0 END AS DOUBLE) AS basement_area2,
    CASE WHEN MOD(row_id, 23) = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(MOD(row_id, 90) AS DOUBLE) END AS open_veranda_area,
    CAST(CASE WHEN MOD(row_id, 7) = 0 THEN MOD(ck, 120) ELSE 0 END AS DOUBLE) AS enclosed_veranda_area,
    CAST(CASE WHEN MOD(row_id, 12) = 0 THEN 150 ELSE 0 END AS DOUBLE) AS screen_porch_area,
    CAST(200 * MOD(row_id, 5) + MOD(ck, 60) * (CASE WHEN MOD(row_id, 5) > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS parking_area,
    CAST(MOD(row_id, 5) AS INT) AS parking_capacity,
    CAST(CASE WHEN MOD(row_id, 5) = 0 THEN NULL ELSE year_built + MOD(row_id, 15) END AS INT) AS parking_year,
    CASE WHEN MOD(row_id, 31) = 0 THEN CAST(NULL AS DOUBLE) WHEN MOD(ck, 2) = 0 THEN 0.0E0 ELSE CAST(MOD(row_id, 450) AS DOUBLE) END AS facade_area,
    CASE WHEN MOD(ck, 6) = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(20 + MOD(row_id, 130) AS DOUBLE) END AS road_access_length,
    CAST(CASE WHEN MOD(row_id, 45) = 0 THEN 2500 ELSE 0 END AS DOUBLE) AS extra_value,
    CAST(CASE WHEN MOD(row_id, 41) = 0 THEN NULL ELSE MOD(row_id, 2) END AS INT) AS basement_full_baths,
    CAST(CASE WHEN MOD(row_id, 41) = 0 THEN NULL WHEN MOD(row_id, 16) = 0 THEN 1 ELSE 0 END AS INT) AS basement_half_baths,
    CAST(1 + MOD(row_id, 5) AS INT) AS guest_rooms, CAST(1 + (CASE WHEN MOD(row_id, 25) = 0 THEN 1 ELSE 0 END) AS INT) AS kitchens, CAST(MOD(ck, 3) AS INT) AS lounges,
    CASE WHEN MOD(row_id, 3) = 0 THEN NULL WHEN MOD(row_id, 3) = 1 THEN 'Unf' ELSE 'Rec' END AS basement_type2,
    CASE MOD(ck, 5) WHEN 0 THEN 'Ex' WHEN 1 THEN 'Gd' WHEN 2 THEN 'TA' WHEN 3 THEN 'Po' ELSE NULL END AS basement_height,
    CASE MOD(row_id, 4) WHEN 0 THEN 'Gd' WHEN 1 THEN 'TA' WHEN 2 THEN 'Fa' ELSE 'Zz' END AS exterior_quality,
    CAST(20 + 10 * MOD(ck, 8) AS INT) AS property_class
  FROM b)
SELECT f.*, ROUND((20000 + 9000.0E0 * overall_quality + 45.0E0 * COALESCE(ground_area, 600.0E0) + 30.0E0 * COALESCE(upper_area, 0.0E0)
    + 15.0E0 * COALESCE(basement_area, 0.0E0) - 250.0E0 * (year_sold - year_built)
    + CASE kitchen_quality WHEN 'Ex' THEN 30000 WHEN 'Gd' THEN 12000 ELSE 0 END
    + CASE WHEN zone = 'BUILDING' THEN 15000 ELSE 0 END + MOD(row_id * 7919, 20011))
    * (1.0E0 + 0.15E0 * (overall_quality - 5) * (CASE WHEN overall_quality > 5 THEN 1 ELSE 0 END)), 2) AS target
FROM f
"""

LINE_COLUMNS = ("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
LINES_OF_A_PART = 500_000


def property_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 45-column property table over every order below ``sf_dir``.

    It is derived and written once per application; queries then read the
    columns they need.
    """
    tune_session(spark)
    return derive_once(spark, "property", sf_dir, lambda: derived_property_table(spark, sf_dir))


def derived_property_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan behind `property_table`.

    Lines are dealt by order before they are summed: the distinct suppliers of an order are then
    counted where its lines are, instead of in a map of all (order, supplier) pairs of an input
    split and in two more shuffles.  Orders are dealt alike, so that a join that broadcasts the sums
    still has all its tasks.  The number of parts follows the number of lines, so what a task holds
    does not grow with the tables.
    """
    tables = {name: read_table(spark, sf_dir, name) for name in ("lineitem", "orders", "customer")}
    lines = tables["lineitem"].select(*LINE_COLUMNS)
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_OF_A_PART))
    tables["lineitem"] = lines.repartition(parts, "l_orderkey")
    tables["orders"] = tables["orders"].select(*ORDER_COLUMNS).repartition(parts, "o_orderkey")
    text = PROPERTY_SQL
    for name in tables:
        text = text.replace(f"FROM {name}", "FROM {" + name + "}").replace(f"JOIN {name}", "JOIN {" + name + "}")
    return spark.sql(text, **tables)
