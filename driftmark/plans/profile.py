"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.scalars import rounded
from driftmark.functions.segments import customer_segment
from driftmark.operators import profile as P
from driftmark.operators import quantiles
from driftmark.plans.views import ACCOUNTS, SEGMENTED
from driftmark.sources.tables import accountlevel, read_table

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lines(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem")


def _scores(spark, sf_dir):
    """Accounts whose score is missing below 300, as a table with nulls."""
    score = F.col("acc_cb_raw_scr_no")
    return accountlevel(spark, sf_dir).select(
        "loannum",
        F.when(score >= 300, score).alias("score"),
        "acc_pdue_pplint_qt",
        F.nullif("mktsegment", F.lit("FURNITURE")).alias("mktsegment"),
    )


def null_counts(spark, sf_dir):
    return P.null_counts(_scores(spark, sf_dir))


def null_total(spark, sf_dir):
    return P.null_total(_scores(spark, sf_dir))


def value_counts(spark, sf_dir):
    return P.value_counts(read_table(spark, sf_dir, "orders"), "o_orderpriority")


def equality_table(spark, sf_dir):
    score, late = F.col("acc_cb_raw_scr_no"), F.col("acc_pdue_pplint_qt")
    both = accountlevel(spark, sf_dir).select(
        customer_segment(score, late).alias("a"),
        customer_segment(score + 25, late - 1).alias("b"),
    )
    return P.equality_table(both, "a", "b")


def table_dims(spark, sf_dir):
    return P.table_dims(_lines(spark, sf_dir))


def first_k(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return P.first_k(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 3)


def mean_all(spark, sf_dir):
    out = P.means(_lines(spark, sf_dir), NUMBERS)
    return out.select(*(rounded(F.col(c), 6).alias(c) for c in NUMBERS))


def corr_matrix(spark, sf_dir):
    out = P.corr_matrix(_lines(spark, sf_dir), NUMBERS)
    return out.withColumn("corr", rounded(F.col("corr"), 9))


def histogram(spark, sf_dir):
    out = P.histogram(_lines(spark, sf_dir), "l_extendedprice", 30)
    return out.withColumns({c: rounded(F.col(c), 4) for c in ("low", "high")})


_BOX = ("q1", "med", "q3", "low", "high", "whisker_low", "whisker_high")


def _box(df):
    return df.withColumns({c: rounded(F.col(c), 4) for c in _BOX})


def box_stats(spark, sf_dir):
    return _box(quantiles.box_stats(_lines(spark, sf_dir), [], "l_extendedprice"))


def box_stats_by_group(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    return _box(quantiles.box_stats(events, ["event_type"], "value"))


def box_outside(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return quantiles.outside_points(events, ["event_type"], "value")


def scatter_points(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    months = orders.withColumn("months", F.month("o_orderdate"))
    return P.scatter(months, "months", "o_totalprice", F.year("o_orderdate"))


def scatter_density(spark, sf_dir):
    return P.scatter_density(
        _lines(spark, sf_dir), "l_quantity", "l_extendedprice", "l_returnflag", 20
    )


QUERIES = {
    f.__name__: f
    for f in (
        null_counts,
        null_total,
        value_counts,
        equality_table,
        table_dims,
        first_k,
        mean_all,
        corr_matrix,
        histogram,
        box_stats,
        box_stats_by_group,
        box_outside,
        scatter_points,
        scatter_density,
    )
}


def _r(expr: str, name: str, digits: int) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


_SCORES = (
    ACCOUNTS
    + """,
scored AS (SELECT loannum, CASE WHEN acc_cb_raw_scr_no >= 300 THEN acc_cb_raw_scr_no END AS score,
  acc_pdue_pplint_qt, CASE WHEN mktsegment <> 'FURNITURE' THEN mktsegment END AS mktsegment
  FROM accountlevel)"""
)
_SCORE_COLS = ("loannum", "score", "acc_pdue_pplint_qt", "mktsegment")


def _bin(x: str, lo: str, hi: str, bins: int) -> str:
    return f"CAST(least(floor(({x} - {lo}) / ({hi} - {lo}) * {bins}) + 1, {bins}) AS INTEGER)"


def _box_sql(table: str, x: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    using = f"JOIN q USING ({group})" if group else "CROSS JOIN q"
    inside = f"{x} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    cols = ", ".join(_r(c, c, 4) for c in _BOX)
    return f"""WITH q AS (SELECT {g} count({x}) AS n, quantile_cont({x}, 0.25) AS q1,
          quantile_cont({x}, 0.5) AS med, quantile_cont({x}, 0.75) AS q3 FROM {table} {by}),
        b AS (SELECT {g} any_value(n) AS n, any_value(q1) AS q1, any_value(med) AS med,
          any_value(q3) AS q3, min({x}) AS low, max({x}) AS high,
          min({x}) FILTER ({inside}) AS whisker_low, max({x}) FILTER ({inside}) AS whisker_high,
          count(*) FILTER (NOT ({inside})) AS n_outside FROM {table} {using} {by})
        SELECT {g} n, {cols}, n_outside FROM b"""


ORACLE = {
    "null_counts": f"WITH {_SCORES} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n
        FROM scored"""
        for c in _SCORE_COLS
    ),
    "null_total": f"WITH {_SCORES}, cells AS ("
    + " UNION ALL ".join(f"SELECT {c} IS NULL AS is_null FROM scored" for c in _SCORE_COLS)
    + ") SELECT is_null, count(*) AS cells FROM cells GROUP BY is_null",
    "value_counts": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "equality_table": f"""WITH {SEGMENTED} SELECT customer_type = guess AS equal, count(*) AS n
        FROM segmented GROUP BY 1""",
    "table_dims": """SELECT count(*) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE lineitem))
        AS INTEGER) AS n_cols FROM lineitem""",
    "first_k": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
        ORDER BY ALL LIMIT 3""",
    "mean_all": "SELECT "
    + ", ".join(_r(f"avg({c})", c, 6) for c in NUMBERS)
    + " FROM lineitem",
    "corr_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, "
        + ("1.0::DOUBLE AS corr" if a == b else f"{_r(f'corr({a}, {b})', 'corr', 9)} FROM lineitem")
        for a in NUMBERS
        for b in NUMBERS
    ),
    "histogram": f"""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
          FROM lineitem),
        b AS (SELECT {_bin('l_extendedprice', 'lo', 'hi', 30)} AS bin, count(*) AS n,
          any_value(lo) AS lo, any_value(hi) AS hi FROM lineitem CROSS JOIN e GROUP BY 1)
        SELECT bin, {_r('lo + (bin - 1) * ((hi - lo) / 30)', 'low', 4)},
          {_r('lo + bin * ((hi - lo) / 30)', 'high', 4)}, n FROM b""",
    "box_stats": _box_sql("lineitem", "l_extendedprice", None),
    "box_stats_by_group": _box_sql("events", "value", "event_type"),
    "box_outside": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1,
          quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
        SELECT event_type, event_id, value FROM events JOIN q USING (event_type)
        WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "scatter_points": """SELECT CAST(month(o_orderdate) AS INTEGER) AS x, o_totalprice AS y,
        CAST(year(o_orderdate) AS INTEGER) AS "group" FROM orders""",
    "scatter_density": f"""WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1,
          min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
        SELECT l_returnflag, {_bin('l_quantity', 'x0', 'x1', 20)} AS x_bin,
          {_bin('l_extendedprice', 'y0', 'y1', 20)} AS y_bin, count(*) AS n
        FROM lineitem CROSS JOIN e GROUP BY ALL""",
}
