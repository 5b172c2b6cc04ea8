"""Views over the warehouse tables.

``account_balances`` needs only ``orders``; ``accountlevel`` adds the credit score of the
customer. Roll-ups that use no score start from the former, so they never pay for the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accrual and reserve as multiples of the ledger balance.
ACCRUAL_RATE = "0.0035"
RESERVE_RATE = "-0.0026"

ROWS_PER_TASK = 1 << 15


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has cores, or than its rows
    need at ``rows_per_task``: a file may be one split however many rows it packs.

    For plain scans in front of heavy row-wise work; a scan of many splits is left alone. Not
    for inputs with a shuffle in them: asking for their partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // rows_per_task))
    if df.rdd.getNumPartitions() >= wanted:
        return df
    # By row number: even whatever the keys are, and without the sort of a round-robin deal.
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.repartition(wanted, "_row").drop("_row")


def month_end(ts: Column) -> Column:
    return F.last_day(ts.cast("date"))


def _decimal(text: str) -> Column:
    return F.expr(f"{text}BD")


def account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per loan: as-of date, delinquency and balances, no score."""
    ledger = F.col("o_totalprice").cast("decimal(18,2)")
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("loannum"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderdate").alias("booked_at"),
        month_end(F.col("o_orderdate")).alias("asofdate"),
        (F.col("o_orderkey") % 5 - 2).alias("acc_pdue_pplint_qt"),
        ledger.alias("acc_ldgr_bl"),
        (ledger * _decimal(ACCRUAL_RATE)).alias("int_acru_am"),
        (ledger * _decimal(RESERVE_RATE)).alias("intreservebal"),
    )


def customer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.floor((F.col("c_acctbal") + 1000) * 650 / 11000).cast("bigint") + 200
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"),
        score.alias("acc_cb_raw_scr_no"),
        F.col("c_mktsegment").alias("mktsegment"),
    )


def accountlevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances plus the score of the customer; a loan without a customer keeps a null score.

    The join is left-outer on the account side, so adaptive execution may split a customer
    that holds a large share of the accounts.
    """
    return account_balances(spark, sf_dir).join(
        customer_scores(spark, sf_dir), "custkey", "left"
    )


def score_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, delinquency, n): accounts counted before the customer join.

    A customer has at most five delinquency values, so one customer that owns a third of all
    accounts reaches the join as five rows.
    """
    per_customer = (
        account_balances(spark, sf_dir)
        .groupBy("custkey", "acc_pdue_pplint_qt")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_customer.join(customer_scores(spark, sf_dir), "custkey", "left")
        .groupBy("acc_cb_raw_scr_no", "acc_pdue_pplint_qt")
        .agg(F.sum("n").alias("n"))
    )
