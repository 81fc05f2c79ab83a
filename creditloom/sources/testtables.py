"""Loan rows derived from the order tables, as a Spark plan and as the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SHARED = """
  case when o_orderkey % 11 = 0 then null when o_orderstatus = 'F' then ' Fully Paid '
       when o_orderstatus = 'P' then 'Charged Off' else 'Current' end as loan_status,
  case when o_orderkey % 2 = 0 then ' 36 months' else ' 60 months' end as term,
  o_totalprice as loan_amnt,
  c_acctbal as annual_inc,
  concat(cast(5 + o_custkey % 20 as {text}), '.', cast(o_orderkey % 10 as {text}), '%') as int_rate,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then 'n/a'
       else concat(cast(o_orderkey % 101 as {text}), '%') end as revol_util,
  cast(o_orderkey % 150 as double) as dti,
  cast(600 + (o_orderkey * 7) % 200 as double) as fico_range_low,
  cast(604 + (o_orderkey * 7) % 200 as double) as fico_range_high,
  cast(o_custkey % 3 as double) as delinq_2yrs,
  case when o_orderkey % 19 = 0 then null else cast(o_orderkey % 6 as double) end as inq_last_6mths,
  cast(1 + o_custkey % 30 as double) as open_acc,
  cast(o_orderkey % 2 as double) as pub_rec,
  cast((o_orderkey * 31) % 20000 as double) as revol_bal,
  cast(2 + o_custkey % 40 as double) as total_acc,
  case when o_orderkey % 7 = 0 then null else cast(o_custkey % 5 as double) end as mort_acc,
  case when o_orderkey % 23 = 0 then null else cast(o_orderkey % 9 as double) end as acc_open_past_24mths,
  cast(o_custkey % 2 as double) as pub_rec_bankruptcies,
  substr('ABCDE', cast(substr(o_orderpriority, 1, 1) as int), 1) as grade,
  concat(substr('ABCDE', cast(substr(o_orderpriority, 1, 1) as int), 1), cast(1 + o_custkey % 5 as {text})) as sub_grade,
  case when o_custkey % 9 = 0 then null when o_custkey % 9 < 4 then '10+ years' else '2 years' end as emp_length,
  c_mktsegment as home_ownership,
  case when o_orderkey % 3 = 0 then 'Verified' when o_orderkey % 3 = 1 then 'Source Verified' else 'Not Verified' end as verification_status,
  case when o_orderkey % 4 = 0 then 'credit_card' else 'debt_consolidation' end as purpose,
  n_name as addr_state,
  case when o_orderkey % 12 = 0 then 'Joint App' else 'Individual' end as application_type,
  case when o_orderkey % 5 < 3 then 'w' else 'f' end as initial_list_status,
  round(cast((o_orderkey * 37) % 400 as double) / 1000 + case when o_orderstatus = 'P' then cast(0.2 as double) else cast(0.05 as double) end, 3) as p_raw
"""
_FROM = "from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"

# The same rows for DuckDB.
LOANS_SQL = (
    "select cast(o_orderkey as varchar) as id, strftime(o_orderdate, '%b-%Y') as issue_d,"
    + _SHARED.format(text="varchar") + _FROM
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def loans(spark: SparkSession, folder: str) -> DataFrame:
    """One raw loan row per order, with text where a CSV would have text."""
    orders, customer, nation = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    expressions = [e.strip() for e in _split_list(_SHARED.format(text="string"))]
    return joined.selectExpr(
        "cast(o_orderkey as string) as id", "date_format(o_orderdate, 'MMM-yyyy') as issue_d", *expressions
    )


def _split_list(text: str) -> list[str]:
    """Split the column list at its line ends; each entry ends with ``as name``."""
    parts, current = [], ""
    for line in text.strip().split("\n"):
        current += " " + line.strip()
        if " as " in line and line.rstrip(",").split(" as ")[-1].isidentifier():
            parts.append(current.strip().rstrip(","))
            current = ""
    return parts
