"""Roll-up queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from driftmark.functions.scalars import half_down_double, half_down_text, rounded
from driftmark.operators import rollup as R
from driftmark.plans.views import BALANCES, ROLLUP
from driftmark.sources.tables import account_balances

# The six month-ends that are kept.
AS_OF_DATES = tuple(
    dt.date.fromisoformat(d)
    for d in ("1996-03-31", "1996-04-30", "1996-05-31", "1996-06-30", "1996-09-30", "1996-10-31")
)


def _shown(df):
    return df.select(
        "cnt",
        *(
            rounded(F.col(c).cast("double"), 2).alias(c)
            for c in ("acc_ldgr_sum", "int_acru_sum", "intreservebal_sum")
        ),
        "year",
        "month",
        "day",
    )


def asof_rollup(spark, sf_dir):
    return _shown(R.asof_rollup(account_balances(spark, sf_dir)))


def asof_rollup_sorted(spark, sf_dir):
    return R.ordered(asof_rollup(spark, sf_dir))


def asof_sort_within(spark, sf_dir):
    return R.ordered_within_partitions(asof_rollup(spark, sf_dir))


def asof_drop_first(spark, sf_dir):
    return _shown(R.drop_first_date(R.asof_rollup(account_balances(spark, sf_dir))))


def asof_in_filter(spark, sf_dir):
    kept = R.asof_in(account_balances(spark, sf_dir), AS_OF_DATES, booked_at="booked_at")
    return kept.select("loannum", "acc_pdue_pplint_qt", "asofdate")


def asof_sql_scan(spark, sf_dir):
    """The roll-up as SQL text over a temporary view."""
    account_balances(spark, sf_dir).createOrReplaceTempView("driftmark_account_balances")
    dates = ", ".join(f"date'{d}'" for d in AS_OF_DATES)
    # The dates are month ends: their range of booking times reaches the scan.
    begin, end = min(AS_OF_DATES).replace(day=1), max(AS_OF_DATES)
    return spark.sql(
        f"""SELECT count(*) AS cnt,
                   round(CAST(sum(acc_ldgr_bl) AS DOUBLE), 2) AS acc_ldgr_sum,
                   year(asofdate) AS year, month(asofdate) AS month, dayofmonth(asofdate) AS day
            FROM driftmark_account_balances WHERE asofdate IN ({dates})
              AND booked_at >= timestamp'{begin}' AND booked_at < timestamp'{end}' + interval 1 day
            GROUP BY asofdate ORDER BY year, month, day"""
    )


def decimal_half_down_10(spark, sf_dir):
    value = F.col("acc_ldgr_bl") * F.expr("1.000000000125BD")
    return account_balances(spark, sf_dir).select(
        "loannum", half_down_double(value).alias("value")
    )


def decimal_half_down_20(spark, sf_dir):
    value = F.col("intreservebal").cast("decimal(12,2)") * F.expr("1.0000000000000000000125BD")
    return account_balances(spark, sf_dir).select("loannum", half_down_text(value).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        asof_rollup,
        asof_rollup_sorted,
        asof_sort_within,
        asof_drop_first,
        asof_in_filter,
        asof_sql_scan,
        decimal_half_down_10,
        decimal_half_down_20,
    )
}

_SHOWN = """cnt, round(CAST(acc_ldgr_sum AS DOUBLE), 2) AS acc_ldgr_sum,
  round(CAST(int_acru_sum AS DOUBLE), 2) AS int_acru_sum,
  round(CAST(intreservebal_sum AS DOUBLE), 2) AS intreservebal_sum,
  CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(d AS INTEGER) AS day"""
_DATES = ", ".join(f"DATE '{d}'" for d in AS_OF_DATES)


def _half_down(value: str, scale: int, digits: int) -> str:
    """Whole-number arithmetic on the unscaled value: (quotient, remainder), half stays down."""
    unscaled = f"CAST(CAST({value} AS DECIMAL(38,0)) AS HUGEINT)"
    cut = 10 ** (scale - digits)
    return (
        f"CASE WHEN {unscaled} < 0 THEN -1 ELSE 1 END * (abs({unscaled}) // {cut} + "
        f"CASE WHEN abs({unscaled}) % {cut} * 2 > {cut} THEN 1 ELSE 0 END)"
    )


ORACLE = {
    "asof_rollup": f"WITH {ROLLUP} SELECT {_SHOWN} FROM rollup",
    "asof_rollup_sorted": f"WITH {ROLLUP} SELECT {_SHOWN} FROM rollup ORDER BY y, m, d",
    "asof_sort_within": f"WITH {ROLLUP} SELECT {_SHOWN} FROM rollup",
    "asof_drop_first": f"""WITH {ROLLUP} SELECT {_SHOWN} FROM rollup
        WHERE asofdate <> (SELECT min(asofdate) FROM rollup)""",
    "asof_in_filter": f"""WITH {BALANCES} SELECT loannum, acc_pdue_pplint_qt, asofdate
        FROM balances WHERE asofdate IN ({_DATES})""",
    "asof_sql_scan": f"""WITH {ROLLUP} SELECT cnt,
        round(CAST(acc_ldgr_sum AS DOUBLE), 2) AS acc_ldgr_sum, CAST(y AS INTEGER) AS year,
        CAST(m AS INTEGER) AS month, CAST(d AS INTEGER) AS day
        FROM rollup WHERE asofdate IN ({_DATES}) ORDER BY y, m, d""",
    # 14 decimals: cents times 1000000000125.
    "decimal_half_down_10": f"""WITH {BALANCES}, cents AS (
          SELECT loannum, CAST(acc_ldgr_bl * 100 AS HUGEINT) * 1000000000125 AS u FROM balances)
        SELECT loannum, CAST(CAST({_half_down('u', 14, 10)} AS DOUBLE) / 1e10 AS DOUBLE) AS value
        FROM cents""",
    # 24 decimals: cents times 10000000000000000000125, in two whole-number parts.
    "decimal_half_down_20": f"""WITH {BALANCES}, cents AS (
          SELECT loannum, CAST(CAST(intreservebal AS DECIMAL(12,2)) * 100 AS HUGEINT) AS c
          FROM balances),
        parts AS (SELECT loannum, c, abs(c) * 125 AS tail FROM cents),
        whole AS (SELECT loannum, c < 0 AS neg,
            abs(c) * CAST(1000000000000000000 AS HUGEINT) + tail // 10000
              + CASE WHEN tail % 10000 > 5000 THEN 1 ELSE 0 END AS q FROM parts)
        SELECT loannum, CASE WHEN neg THEN '-' ELSE '' END
            || CAST(q // CAST(100000000000000000000 AS HUGEINT) AS VARCHAR) || '.'
            || lpad(CAST(q % CAST(100000000000000000000 AS HUGEINT) AS VARCHAR), 20, '0') AS value
        FROM whole""",
}
