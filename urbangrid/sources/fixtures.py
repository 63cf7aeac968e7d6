"""The given tables as pixels, rasters, patches, boxes, samples, scenes and pairs of collections.

Every fixture is one SELECT; `duck` gives the same SELECT for DuckDB as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SELECTS = {
    # daily scenes of five bands on a grid ten columns wide
    "f1": """SELECT CAST(CAST(ts AS DATE) AS STRING) AS scene_id, event_type AS band, CAST(FLOOR(user_id / CAST(10 AS DOUBLE)) AS BIGINT) AS y,
        CAST(user_id % 10 AS BIGINT) AS x, AVG(value) AS value, MAX(CAST(REGEXP_REPLACE(props, '[^0-9]', '') AS INT)) AS cloud
        FROM {events} GROUP BY 1, 2, 3, 4""",
    # two rasters on one grid
    "f2": """SELECT CAST(l_suppkey AS BIGINT) AS y, CAST(l_partkey % 100 AS BIGINT) AS x, AVG(l_quantity) AS height, AVG(l_discount) * 10 AS footprint, COUNT(*) AS n
        FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1, 2""",
    # a second source on the same grid
    "f2a": """SELECT CAST(l_suppkey AS BIGINT) AS y, CAST(l_partkey % 100 AS BIGINT) AS x, AVG(l_quantity) AS height, AVG(l_discount) * 10 AS footprint, COUNT(*) AS n
        FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1, 2""",
    # patches of 8 x 8 cells, row by row
    "f3": """SELECT CAST(vec_id AS BIGINT) AS patch_id, embedding, label FROM {embeddings}""",
    # building boxes
    "f4": """SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS city,
        (p_partkey * 37 % 1000) / CAST(10 AS DOUBLE) AS x_min, (p_partkey * 91 % 1000) / CAST(10 AS DOUBLE) AS y_min,
        (p_partkey * 37 % 1000) / CAST(10 AS DOUBLE) + p_size / CAST(20 AS DOUBLE) AS x_max,
        (p_partkey * 91 % 1000) / CAST(10 AS DOUBLE) + (p_size % 7 + 1) / CAST(4 AS DOUBLE) AS y_max,
        CASE WHEN p_size % 11 = 0 THEN NULL ELSE (p_partkey % 60) + CAST(0.5 AS DOUBLE) END AS height_raw,
        CASE p_size % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'cm' WHEN 2 THEN 'FLOOR' ELSE 'feet' END AS unit FROM {part}""",
    # labelled samples
    "f5": """SELECT CONCAT_WS('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING)) AS sample_id,
        l_partkey, p_brand || '@' || CAST(p_size % 3 AS STRING) AS grp, l_extendedprice / 1000 AS y_true, l_quantity * p_retailprice / 1000 AS y_pred,
        l_discount * 10 AS f_true, l_tax * 12.5 AS f_pred, l_quantity, l_discount, l_tax, CAST(p_size AS DOUBLE) AS p_size, p_retailprice
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # scenes
    "f6": """SELECT CAST(o_orderkey AS BIGINT) AS scene_id, o_orderdate AS acquired, CAST(c_nationkey AS BIGINT) AS city_id, CAST(c_nationkey * 5 - 60 AS DOUBLE) AS lat, o_totalprice % 100 AS cloudy_pct,
        CASE o_orderstatus WHEN 'F' THEN 'IW' ELSE 'EW' END AS mode, CASE WHEN o_orderkey % 3 = 0 THEN 'VV' ELSE 'VV,VH' END AS pol,
        c_nationkey + (o_orderkey % 10) / CAST(10 AS DOUBLE) AS x_min, c_nationkey + (o_orderkey % 10) / CAST(10 AS DOUBLE) + 1 AS x_max
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


# averages of fractions, whose last digits depend on the order of the sum, by table; sums of whole numbers do not
ORDERED = {"events": "value", "lineitem": "l_discount"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame; a plain projection or aggregate that Catalyst prunes into what uses it.

    Averages of fractions are summed in the order of the file, so that a limit on them is met by the same cells however rows are dealt.
    """
    text = SELECTS[name]
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    for table, c in ORDERED.items():
        if table in used and f"AVG({c})" in text:
            text = text.replace(f"AVG({c})", in_order(c))
            used[table] = used[table].select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("__place"))
    return spark.sql(text, **used)


def in_order(c: str) -> str:
    """AVG(c) with its sum taken in the order of __place; holds the values of a group, a cell's few rows here."""
    rows = f"ARRAY_SORT(COLLECT_LIST(STRUCT(__place, {c} AS v)) FILTER (WHERE {c} IS NOT NULL))"
    return f"TRY_DIVIDE(AGGREGATE({rows}, CAST(0 AS DOUBLE), (a, e) -> a + e.v), COUNT({c}))"


def duck(*names: str) -> str:
    """`name AS (SELECT ...)` for DuckDB, comma-joined."""
    out = []
    for n in names:
        text = SELECTS[n].replace("[^0-9]', '')", "[^0-9]', '', 'g')")
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        out.append(f"{n} AS ({text})")
    return ", ".join(out)
