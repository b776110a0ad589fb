"""Request-shaped input built from the driver's test tables.

This only maps ``lineitem`` x ``orders`` rows to the columns of a ticket
table (no analysis happens here); every report then runs through the
library on the result.  The mapping is the fixed adapter of FIXTURES.md §2,
so the DuckDB oracle can build the same rows from the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed reference instant used by all registered queries.
AS_OF = "2001-06-01 00:00:00"

# --- fixed values: adapter mapping (FIXTURES.md §2).
TYPE_BY_PART_MOD13 = (
    "Pothole repair", "STREETLIGHT OUT", "Traffic Signal down", "Graffiti", "Trash pickup", "Water Leak",
    "Drainage", "Sidewalk damage", "Tree trim", "Street sign", "Trash near Pothole", None, "Noise",
)
PRIORITY_BY_ORDER_PRIORITY = {"1-URGENT": "urgent", "2-HIGH": "1", "3-MEDIUM": "2", "5-LOW": "4"}
METHOD_BY_SUPP_MOD11 = (
    "Phone", "Web portal", "Smartphone app", "Mobile", "Email", "Walk-In", "In-Person", "Fax", "Twitter", None, "Counter",
)


def _case_by_index(idx: Column, labels) -> Column:
    """Label at position ``idx`` (0-based) of a fixed list, by one lookup in
    a literal array rather than a CASE per position."""
    arr = F.array(*[F.lit(lab).cast("string") for lab in labels])
    return F.try_element_at(arr, (idx + 1).cast("int"))


# Read schemas of the two tables (FIXTURES.md §4): no inference pass.
LINEITEM_SCHEMA = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ"
)
ORDERS_SCHEMA = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING"
)


def requests_from_tables(spark: SparkSession, sf_dir: str, emergency_flag: bool = False) -> DataFrame:
    """Ticket table over ``lineitem`` joined to ``orders`` (whole tables).

    With ``emergency_flag`` the table carries an ``IS_EMERGENCY`` yes/no
    column instead of ``SR_PRIORITY`` (to exercise priority inference).
    The join is an equi-join on the order key; Spark picks broadcast or
    shuffle from the table sizes (at scale both are fact tables).
    """
    li = spark.read.schema(LINEITEM_SCHEMA).parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_shipdate"
    )
    od = spark.read.schema(ORDERS_SCHEMA).parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    is_open = (F.col("l_linestatus") == "O") & (F.col("l_orderkey") % 3 == 0)
    prio = None
    for k, v in PRIORITY_BY_ORDER_PRIORITY.items():
        prio = F.when(F.col("o_orderpriority") == k, F.lit(v)) if prio is None else prio.when(F.col("o_orderpriority") == k, F.lit(v))
    cols = [
        F.col("l_orderkey").alias("SR_ID"),
        _case_by_index(F.col("l_partkey") % 13, TYPE_BY_PART_MOD13).alias("SR_TYPE"),
    ]
    if emergency_flag:
        cols.append(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("yes")).otherwise(F.lit("no")).alias("IS_EMERGENCY"))
    else:
        cols.append(prio.cast("string").alias("SR_PRIORITY"))
    cols += [
        _case_by_index(F.col("l_suppkey") % 11, METHOD_BY_SUPP_MOD11).alias("METHOD_RAW"),
        F.when(is_open, F.lit("OPEN")).otherwise(F.lit("CLOSED")).alias("STATUS"),
        F.when(F.col("o_custkey") % 40 == 0, F.lit(None).cast("string"))
        .otherwise((F.lit(33100) + F.col("o_custkey") % 25).cast("string"))
        .alias("ZIP_CODE"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("l_shipdate").cast("timestamp_ntz"))
        .alias("CREATED_DATE"),
        F.when(is_open, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.timestamp_add("HOUR", (F.col("l_quantity") * 6).cast("int"), F.col("l_shipdate").cast("timestamp_ntz")))
        .alias("CLOSED_DATE"),
        F.when(F.col("l_linenumber") == 7, F.lit("bad")).otherwise((F.lit(25.0) + F.col("l_discount") * 20).cast("string")).alias("latitude"),
        (F.lit(-81.0) + F.col("l_tax") * 15).cast("string").alias("longitude"),
    ]
    return j.select(*cols)


# The same adapter as DuckDB SQL (used by the oracle queries).
ADAPTER_SQL = """SELECT l_orderkey AS SR_ID,
  CASE l_partkey % 13 WHEN 0 THEN 'Pothole repair' WHEN 1 THEN 'STREETLIGHT OUT' WHEN 2 THEN 'Traffic Signal down' WHEN 3 THEN 'Graffiti' WHEN 4 THEN 'Trash pickup' WHEN 5 THEN 'Water Leak' WHEN 6 THEN 'Drainage' WHEN 7 THEN 'Sidewalk damage' WHEN 8 THEN 'Tree trim' WHEN 9 THEN 'Street sign' WHEN 10 THEN 'Trash near Pothole' WHEN 11 THEN NULL ELSE 'Noise' END AS SR_TYPE,
  {priority_expr},
  CASE l_suppkey % 11 WHEN 0 THEN 'Phone' WHEN 1 THEN 'Web portal' WHEN 2 THEN 'Smartphone app' WHEN 3 THEN 'Mobile' WHEN 4 THEN 'Email' WHEN 5 THEN 'Walk-In' WHEN 6 THEN 'In-Person' WHEN 7 THEN 'Fax' WHEN 8 THEN 'Twitter' WHEN 9 THEN NULL ELSE 'Counter' END AS METHOD_RAW,
  CASE WHEN l_linestatus = 'O' AND l_orderkey % 3 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS STATUS,
  CASE WHEN o_custkey % 40 = 0 THEN NULL ELSE CAST(33100 + o_custkey % 25 AS VARCHAR) END AS ZIP_CODE,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_shipdate END AS CREATED_DATE,
  CASE WHEN l_linestatus = 'O' AND l_orderkey % 3 = 0 THEN NULL ELSE l_shipdate + CAST(l_quantity * 6 AS INT) * INTERVAL '1' HOUR END AS CLOSED_DATE,
  CASE WHEN l_linenumber = 7 THEN 'bad' ELSE CAST(25.0 + l_discount * 20 AS VARCHAR) END AS latitude,
  CAST(-81.0 + l_tax * 15 AS VARCHAR) AS longitude
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

ADAPTER_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN '1' WHEN '3-MEDIUM' THEN '2' WHEN '5-LOW' THEN '4' ELSE NULL END AS SR_PRIORITY"
ADAPTER_EMERGENCY = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'yes' ELSE 'no' END AS IS_EMERGENCY"


def adapter_sql(emergency_flag: bool = False) -> str:
    return ADAPTER_SQL.format(priority_expr=ADAPTER_EMERGENCY if emergency_flag else ADAPTER_PRIORITY)
