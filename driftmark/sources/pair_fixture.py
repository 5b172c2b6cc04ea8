"""(pair_key, template, input1, input2, output) triples derived from the warehouse tables.

Each table is scanned once; every row carries all its triples in one array, and the arrays of
all tables are opened by one generator. What follows is then planned and compiled once, not once
per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.sources.tables import read_table, spread


def _pair(template: str, a: Column, b: Column, out: Column) -> Column:
    return F.struct(
        F.lit(template).alias("template"),
        a.alias("input1"),
        b.alias("input2"),
        out.alias("output"),
    )


def _packed(df: DataFrame, key: str, pairs: list[Column]) -> DataFrame:
    return spread(df).select(F.col(key).alias("pair_key"), F.array(*pairs).alias("triples"))


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("")
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    size = F.col("p_size").cast("string")
    from_part = _packed(
        read_table(spark, sf_dir, "part").select(
            "p_partkey", "p_name", "p_brand", "p_type", "p_size"
        ),
        "p_partkey",
        [
            _pair("same", name, none, name),
            _pair("concat", brand, kind, F.concat(brand, kind)),
            _pair("concat_other", brand, kind, name),
            _pair("zero_pad", size, none, F.lpad(size, 6, "0")),
            _pair("num_other", size, none, (F.col("p_size") + 1).cast("string")),
            _pair("unrelated", name, none, kind),
            _pair("to_empty", name, none, none),
        ],
    )

    day = F.col("o_orderdate").cast("date")
    y, m, d = F.year(day), F.month(day), F.dayofmonth(day)
    yyyy, mm, dd = _pad(y, 4), _pad(m, 2), _pad(d, 2)
    iso = F.concat_ws("-", yyyy, mm, dd)
    later = F.add_months(day, 1)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    from_orders = _packed(
        read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"),
        "o_orderkey",
        [
            _pair(
                "dec_trim",
                price.cast("string"),
                none,
                price.cast("decimal(19,3)").cast("string"),
            ),
            _pair("date_sep", iso, none, F.concat_ws("/", yyyy, mm, dd)),
            _pair("date_order", iso, none, F.concat_ws("-", mm, dd, yyyy)),
            _pair(
                "date_short_year", iso, none, F.concat_ws("-", F.right(yyyy, F.lit(2)), mm, dd)
            ),
            _pair(
                "date_unpadded",
                iso,
                none,
                F.concat_ws("-", yyyy, m.cast("string"), d.cast("string")),
            ),
            _pair(
                "date_shift",
                iso,
                none,
                F.concat_ws(
                    "-",
                    _pad(F.year(later), 4),
                    _pad(F.month(later), 2),
                    _pad(F.dayofmonth(later), 2),
                ),
            ),
            _pair(
                "time_12h",
                F.concat(iso, F.lit(" 10:30:00")),
                none,
                F.concat(iso, F.lit(" 22:30:00")),
            ),
        ],
    )

    customer = F.col("c_name")
    from_customer = _packed(
        read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
        "c_custkey",
        [
            _pair("blanks", customer, none, F.concat(F.lit("  "), customer, F.lit(" "))),
            _pair("mask", customer, none, F.concat(F.lit("XXXX"), F.substr(customer, F.lit(5)))),
        ],
    )
    packed = from_part.unionAll(from_orders).unionAll(from_customer)
    # No list is empty. Told so by the outer form, the planner adds no filter for empty lists, which
    # would make every list a second time, in front of the exchange.
    return packed.select("pair_key", F.inline_outer("triples"))
