"""File queries: tables written to the scratch folder in each format and read back."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from driftmark.functions.segments import as_feature
from driftmark.operators.classify import FLAGS, change_table
from driftmark.operators import models
from driftmark.operators.features import assemble
from driftmark.operators.rollup import asof_rollup, regression_frame
from driftmark.plans.models import CALENDAR
from driftmark.plans.pairs import ORACLE as PAIR_ORACLE
from driftmark.plans.pairs import PAIRS
from driftmark.plans.views import ACCOUNTS, ROLLUP
from driftmark.sources import files
from driftmark.sources.pair_fixture import pairs
from driftmark.sources.scratch import scratch_path
from driftmark.sources.tables import account_balances, accountlevel, read_table


def csv_roundtrip(spark, sf_dir):
    """Pairs as headerless text: four positional strings, empty fields kept empty."""
    path = scratch_path(spark, "pairs-csv")
    files.write_delimited(
        pairs(spark, sf_dir).select("input1", "input2", "output", "template"), path, quoted=True
    )
    return files.read_headerless(spark, path, quoted=True)


def csv_documents(spark, sf_dir):
    """Texts with separators, quotes and line breaks, empty and null ones, written and read back."""
    path = scratch_path(spark, "documents-csv")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # Rows of each kind that the table itself may lack.
    first = F.substring("text", 1, 1)
    tail = F.element_at(
        F.array(
            F.concat(F.lit('"'), first),
            F.concat(first, F.lit(',a""b')),
            F.lit(""),
            F.lit(None).cast("string"),
            F.concat(first, F.lit("\r\n\n,"), first),
        ),
        (F.pmod("doc_id", F.lit(5)) + 1).cast("int"),
    )
    rows = rows.withColumn("awkward", tail)
    files.write_delimited(rows, path, header=True, quoted=True, rows_per_file=1 << 12)
    return files.read_inferred(spark, path, rows.schema)


def csv_header_scan(spark, sf_dir):
    path = scratch_path(spark, "counts-csv")
    rolled = asof_rollup(account_balances(spark, sf_dir))
    since = (F.col("year") - 1995) * 12 + F.col("month")
    files.write_delimited(
        rolled.select("month", "year", since.alias("DurationSince"), F.col("cnt").alias("Count")),
        path,
        header=True,
    )
    return files.read_with_header(spark, path, {"DurationSince": 2, "Count": 3})


def lr_libsvm(spark, sf_dir):
    """Elastic-net regression on a libsvm file of (count; year, month, day)."""
    path = scratch_path(spark, "libsvm")
    frame = regression_frame(asof_rollup(account_balances(spark, sf_dir)))
    files.write_libsvm(assemble(frame.withColumnRenamed("Count", "label"), CALENDAR), path)
    data = files.read_libsvm(spark, path, len(CALENDAR))
    model = models.fit_linear(data, "label", "predicted")
    return models.linear_summary(spark, model, CALENDAR)


def csv_inferred(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    rows = account_balances(spark, sf_dir).select(
        "loannum", F.col("acc_ldgr_bl").cast("double").alias("balance"), "acc_pdue_pplint_qt"
    )
    files.write_delimited(rows, path, header=True, quoted=True)
    read = files.read_inferred(spark, path)
    return read.select(
        F.col("loannum").cast("bigint"), "balance", F.col("acc_pdue_pplint_qt").cast("bigint")
    )


def feature_csv(spark, sf_dir):
    """The full change table as text with a header, summed after reading it back."""
    path = scratch_path(spark, "features-csv")
    table = change_table(pairs(spark, sf_dir), "input1", "input2", "output", "template")
    # Most of the 300 bytes of a row are flags, few of them raised.
    files.write_delimited(table, path, header=True, quoted=True, compression="gzip")
    read = files.read_inferred(spark, path, table.schema)
    return read.groupBy(F.col("ActClassify").alias("template")).agg(
        *(F.sum(f).alias(f) for f in FLAGS)
    )


def libsvm_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "libsvm")
    rows = accountlevel(spark, sf_dir).select(
        F.col("loannum").cast("double").alias("label"),
        as_feature(F.col("acc_cb_raw_scr_no")).alias("score"),
        as_feature(F.col("acc_pdue_pplint_qt")).alias("late"),
    )
    files.write_libsvm(assemble(rows, ["score", "late"]), path)
    back = vector_to_array("features")
    return files.read_libsvm(spark, path, 2).select(
        "label", back[0].alias("score"), back[1].alias("late")
    )


QUERIES = {
    f.__name__: f
    for f in (
        csv_roundtrip,
        csv_documents,
        csv_header_scan,
        csv_inferred,
        feature_csv,
        libsvm_roundtrip,
        lr_libsvm,
    )
}

ORACLE = {
    "csv_roundtrip": f"""WITH {PAIRS} SELECT i1 AS "InputCol1", i2 AS "InputCol2",
        o AS "OutputCol", template AS "Classification" FROM pairs""",
    "csv_documents": r"""SELECT doc_id, source, text, CASE doc_id % 5
          WHEN 0 THEN '"' || left(text, 1)
          WHEN 1 THEN left(text, 1) || ',a""b'
          WHEN 2 THEN ''
          WHEN 3 THEN NULL
          ELSE left(text, 1) || chr(13) || chr(10) || chr(10) || ',' || left(text, 1)
        END AS awkward FROM documents""",
    "csv_header_scan": f"""WITH {ROLLUP} SELECT CAST((y - 1995) * 12 + m AS DOUBLE)
        AS "DurationSince", CAST(cnt AS DOUBLE) AS "Count" FROM rollup""",
    "csv_inferred": """SELECT o_orderkey AS loannum, o_totalprice AS balance,
        o_orderkey % 5 - 2 AS acc_pdue_pplint_qt FROM orders""",
    "feature_csv": PAIR_ORACLE["pair_flags"],
    "libsvm_roundtrip": f"""WITH {ACCOUNTS} SELECT CAST(loannum AS DOUBLE) AS label,
        coalesce(CAST(acc_cb_raw_scr_no AS DOUBLE), 0.0) AS score,
        CAST(acc_pdue_pplint_qt AS DOUBLE) AS late FROM accountlevel""",
}
