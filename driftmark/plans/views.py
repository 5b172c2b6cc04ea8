"""SQL text of the views, for the checking engine."""

from __future__ import annotations

from driftmark.functions.segments import HIGH_SCORE, LOW_SCORE, NO_SEGMENT, SEGMENTS

BALANCES = """balances AS (
  SELECT o_orderkey AS loannum, o_custkey AS custkey,
         last_day(CAST(o_orderdate AS DATE)) AS asofdate,
         o_orderkey % 5 - 2 AS acc_pdue_pplint_qt,
         CAST(o_totalprice AS DECIMAL(18,2)) AS acc_ldgr_bl,
         CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0035 AS DECIMAL(4,4)) AS int_acru_am,
         CAST(o_totalprice AS DECIMAL(18,2)) * CAST(-0.0026 AS DECIMAL(4,4)) AS intreservebal
  FROM orders)"""

ACCOUNTS = (
    BALANCES
    + """,
scores AS (
  SELECT c_custkey AS custkey,
         CAST(floor((c_acctbal + 1000) * 650 / 11000) AS BIGINT) + 200 AS acc_cb_raw_scr_no,
         c_mktsegment AS mktsegment
  FROM customer),
accountlevel AS (
  SELECT b.*, s.acc_cb_raw_scr_no, s.mktsegment
  FROM balances b LEFT JOIN scores s USING (custkey))"""
)

ROLLUP = (
    BALANCES
    + """,
rollup AS (
  SELECT asofdate, count(*) AS cnt, sum(acc_ldgr_bl) AS acc_ldgr_sum,
         sum(int_acru_am) AS int_acru_sum, sum(intreservebal) AS intreservebal_sum,
         year(asofdate) AS y, month(asofdate) AS m, day(asofdate) AS d
  FROM balances GROUP BY asofdate)"""
)


def segment_case(score: str, delinquency: str) -> str:
    """Score band times overdue state, looked up in a list of labels; ``NA`` when either is null."""
    band = f"(CASE WHEN {score} > {HIGH_SCORE} THEN 0 WHEN {score} < {LOW_SCORE} THEN 2 ELSE 1 END)"
    overdue = f"(CASE WHEN {delinquency} > 0 THEN 1 ELSE 0 END)"
    good, bad, c, d, e, f = SEGMENTS
    labels = ", ".join(f"'{x}'" for x in (good, c, e, f, d, bad))
    known = f"{score} IS NOT NULL AND {delinquency} IS NOT NULL"
    return f"""CASE WHEN {known} THEN list_extract([{labels}], 2 * {band} + {overdue} + 1)
       ELSE '{NO_SEGMENT}' END"""


SEGMENTED = (
    ACCOUNTS
    + f""",
segmented AS (
  SELECT loannum, acc_cb_raw_scr_no, acc_pdue_pplint_qt,
         {segment_case('acc_cb_raw_scr_no', 'acc_pdue_pplint_qt')} AS customer_type,
         {segment_case('(acc_cb_raw_scr_no + 25)', '(acc_pdue_pplint_qt - 1)')} AS guess
  FROM accountlevel)"""
)
