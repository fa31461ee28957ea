"""Loan-shaped view over the provided star-schema tables.

Grain = one order = one loan. Per-order line aggregates are left-joined
(orders without lines keep real NULLs), the customer is inner-joined and
the nation name is looked up through a broadcast of the 25-row nation
table. The line aggregate is computed before the join (partial
aggregation map-side, one shuffle on l_orderkey), so the join is
order-grain on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _r6(c: Column) -> Column:
    # Double sums differ between engines in the last digits: round aggregates.
    return F.round(c, 6)


def loan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    lines = read_table(spark, sf_dir, "lineitem")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")

    agg = lines.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("_qty"),
        F.avg("l_discount").alias("_disc"),
        F.sum("l_extendedprice").alias("_ext"),
        F.avg("l_tax").alias("_tax"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("_ret"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("_paid"),
    )
    # nation has a fixed 25 rows: broadcasting it is size-bounded by construction.
    cust = customer.join(F.broadcast(nation.select("n_nationkey", "n_name")),
                         customer.c_nationkey == nation.n_nationkey, "inner")
    o = orders.join(agg, orders.o_orderkey == agg.l_orderkey, "left").join(
        cust, orders.o_custkey == cust.c_custkey, "inner")

    status = (F.when(F.col("o_orderstatus") == "F", "Charged Off")
              .when(F.col("o_orderstatus") == "O", " Fully Paid ")
              .otherwise("Current"))
    k13 = F.col("o_orderkey") % 13
    emp = (F.when(k13 == 0, F.lit(None).cast("string"))
           .when(k13 == 1, "< 1 year").when(k13 == 2, "1 year")
           .when(k13 <= 10, F.concat((k13 - 1).cast("string"), F.lit(" years")))
           .when(k13 == 11, "10+ years").otherwise("n/a"))
    grade = F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ABCDE")
    odate = F.to_date("o_orderdate")
    charged = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("loan_id"),
        status.alias("loan_status"),
        F.col("o_totalprice").alias("loan_amnt"),
        F.col("o_totalprice").alias("funded_amnt"),
        F.when(F.col("o_orderkey") % 2 == 0, "36 months").otherwise("60 months").alias("term"),
        _r6(F.col("_tax") * 250).alias("int_rate"),
        _r6(F.col("o_totalprice") / 36).alias("installment"),
        grade.alias("grade"),
        F.concat(grade, (F.col("o_custkey") % 5 + 1).cast("string")).alias("sub_grade"),
        emp.alias("emp_length"),
        F.col("c_mktsegment").alias("home_ownership"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 10).alias("annual_inc"),
        F.element_at(F.array(F.lit("Verified"), F.lit("Source Verified"), F.lit("Not Verified")),
                     (F.col("o_custkey") % 3 + 1).cast("int")).alias("verification_status"),
        F.col("n_name").alias("purpose"),
        (F.col("_qty") / 4).alias("dti"),
        F.date_format(odate, "MMM-yyyy").alias("issue_d"),
        F.date_format(F.date_sub(odate, (F.col("o_custkey") % 30 * 365).cast("int")),
                      "MMM-yyyy").alias("earliest_cr_line"),
        _r6(F.col("_disc") * 1500).alias("revol_util"),
        _r6(F.col("_ext") / 10).alias("revol_bal"),
        (F.col("_n") - 1).cast("double").alias("inq_last_6mths"),
        F.col("_ret").cast("double").alias("delinq_2yrs"),
        F.col("_n").cast("double").alias("open_acc"),
        F.when(F.col("o_custkey") % 7 == 0, 1.0).otherwise(0.0).alias("pub_rec"),
        (F.col("_n") + F.col("o_custkey") % 20).cast("double").alias("total_acc"),
        F.when(F.col("_ret") > 0, (F.col("o_custkey") % 48).cast("double"))
         .alias("mths_since_last_delinq"),
        F.when((F.col("o_orderkey") / 2).cast("long") % 2 == 0, "w").otherwise("f")
         .alias("initial_list_status"),
        F.when(F.col("o_custkey") % 10 == 0, "Joint App").otherwise("Individual")
         .alias("application_type"),
        _r6(F.col("_paid")).alias("total_pymnt"),
        F.when(charged, 100.0).otherwise(0.0).alias("recoveries"),
    )


# Same view for the DuckDB oracle (tables are pre-registered views there).
LOANS_SQL = """
loans AS (
  SELECT
    o.o_orderkey AS loan_id,
    CASE o.o_orderstatus WHEN 'F' THEN 'Charged Off' WHEN 'O' THEN ' Fully Paid '
         ELSE 'Current' END AS loan_status,
    o.o_totalprice AS loan_amnt,
    o.o_totalprice AS funded_amnt,
    CASE WHEN o.o_orderkey % 2 = 0 THEN '36 months' ELSE '60 months' END AS term,
    round(a._tax * 250, 6) AS int_rate,
    round(o.o_totalprice / 36, 6) AS installment,
    translate(substr(o.o_orderpriority, 1, 1), '12345', 'ABCDE') AS grade,
    translate(substr(o.o_orderpriority, 1, 1), '12345', 'ABCDE')
      || CAST(o.o_custkey % 5 + 1 AS VARCHAR) AS sub_grade,
    CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
         WHEN o.o_orderkey % 13 = 1 THEN '< 1 year'
         WHEN o.o_orderkey % 13 = 2 THEN '1 year'
         WHEN o.o_orderkey % 13 <= 10 THEN CAST(o.o_orderkey % 13 - 1 AS VARCHAR) || ' years'
         WHEN o.o_orderkey % 13 = 11 THEN '10+ years'
         ELSE 'n/a' END AS emp_length,
    c.c_mktsegment AS home_ownership,
    greatest(c.c_acctbal, 0.0) * 10 AS annual_inc,
    CASE o.o_custkey % 3 WHEN 0 THEN 'Verified' WHEN 1 THEN 'Source Verified'
         ELSE 'Not Verified' END AS verification_status,
    n.n_name AS purpose,
    a._qty / 4 AS dti,
    strftime(CAST(o.o_orderdate AS DATE), '%b-%Y') AS issue_d,
    strftime(CAST(o.o_orderdate AS DATE) - CAST(o.o_custkey % 30 * 365 AS INTEGER), '%b-%Y')
      AS earliest_cr_line,
    round(a._disc * 1500, 6) AS revol_util,
    round(a._ext / 10, 6) AS revol_bal,
    CAST(a._n - 1 AS DOUBLE) AS inq_last_6mths,
    CAST(a._ret AS DOUBLE) AS delinq_2yrs,
    CAST(a._n AS DOUBLE) AS open_acc,
    CASE WHEN o.o_custkey % 7 = 0 THEN 1.0 ELSE 0.0 END AS pub_rec,
    CAST(a._n + o.o_custkey % 20 AS DOUBLE) AS total_acc,
    CASE WHEN a._ret > 0 THEN CAST(o.o_custkey % 48 AS DOUBLE) END AS mths_since_last_delinq,
    CASE WHEN (o.o_orderkey // 2) % 2 = 0 THEN 'w' ELSE 'f' END AS initial_list_status,
    CASE WHEN o.o_custkey % 10 = 0 THEN 'Joint App' ELSE 'Individual' END AS application_type,
    round(a._paid, 6) AS total_pymnt,
    CASE WHEN o.o_orderstatus = 'F' THEN 100.0 ELSE 0.0 END AS recoveries
  FROM orders o
  LEFT JOIN (
    SELECT l_orderkey, sum(l_quantity) AS _qty, avg(l_discount) AS _disc,
           sum(l_extendedprice) AS _ext, avg(l_tax) AS _tax, count(*) AS _n,
           sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS _ret,
           sum(l_extendedprice * (1 - l_discount)) AS _paid
    FROM lineitem GROUP BY l_orderkey) a ON o.o_orderkey = a.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""
