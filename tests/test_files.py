"""File formats and the scratch folder."""

from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import functions as F

from driftmark.operators.classify import FLAGS, change_table
from driftmark.operators.features import assemble
from driftmark.plans import files as plans
from driftmark.sources import files, scratch
from driftmark.sources.pair_fixture import pairs


def test_headerless_text_keeps_empty_fields_and_quotes(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text('abc,,abc,sm\n a ,"b,c",x\n,,,x\n"q",1,2,y\n')
    rows = [tuple(r) for r in files.read_headerless(spark, str(path)).collect()]
    assert rows == [
        ("abc", "", "abc", "sm"),
        (" a ", '"b', 'c"', "x"),
        ("", "", "", "x"),
        ('"q"', "1", "2", "y"),
    ]


def test_every_line_equal_to_the_header_goes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Month,Year,DurationSince,Count\n11,2014,1,24307508\n")
    (tmp_path / "b.csv").write_text("Month,Year,DurationSince,Count\n12,2014,2.5,24369873\n")
    got = files.read_with_header(spark, str(tmp_path), {"DurationSince": 2, "Count": 3})
    assert sorted(tuple(r) for r in got.collect()) == [(1.0, 24307508.0), (2.5, 24369873.0)]


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b ", "", 1.5), ("", " x", 2.0)], "a string, b string, c double")
    path = str(tmp_path / "out")
    files.write_delimited(df, path, single_file=True)
    back = files.read_headerless(spark, path, ["a", "b", "c"])
    assert {tuple(r) for r in back.collect()} == {("a b ", "", "1.5"), ("", " x", "2.0")}
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1


AWKWARD = ['"q', "a,b", 'a"b', "", None, "l\r\n\n,", "a\rb", " sp ", "\\", '\\"', "\\N", "NaN"]


def test_quoted_text_brings_every_value_back(spark, tmp_path):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(AWKWARD, AWKWARD[::-1], strict=True))]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    path = str(tmp_path / "quoted")
    files.write_delimited(df, path, header=True, quoted=True)
    back = files.read_inferred(spark, path, df.schema).collect()
    assert sorted(tuple(r) for r in back) == rows
    files.write_delimited(df.select("a", "b"), path, quoted=True)
    back = files.read_headerless(spark, path, ["a", "b"], quoted=True).collect()
    assert sorted(tuple(r) for r in back) == sorted((a or "", b or "") for _, a, b in rows)


@pytest.mark.parametrize("value", ["a,b", 'a"b', "a\nb", "a\rb"])
def test_unquoted_text_refuses_what_it_cannot_hold(spark, tmp_path, value):
    df = spark.createDataFrame([("fine",), (value,)], "a string")
    with pytest.raises(Exception, match="needs quoting"):
        files.write_delimited(df, str(tmp_path / "plain"))


def test_inferred_types(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Month,cnt\n1,2.5\n2,3\n")
    assert files.read_inferred(spark, str(path)).dtypes == [("Month", "int"), ("cnt", "double")]


def test_libsvm_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (0.0, 3.0, 0.0)], "label double, a double, b double")
    path = str(tmp_path / "svm")
    files.write_libsvm(assemble(df, ["a", "b"]), path)
    back = {r.label: list(r.features.toArray()) for r in files.read_libsvm(spark, path, 2).collect()}
    assert back == {1.0: [0.0, 2.0], 0.0: [3.0, 0.0]}


class _Cluster:
    """A session whose executors are elsewhere."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_scratch_needs_a_shared_folder_on_a_cluster():
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch.scratch_root(_Cluster)


def test_scratch_follows_the_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch.scratch_path(spark, "t"), scratch.scratch_path(spark, "t")
    assert a != b and a.startswith(root)
    stored = scratch.materialize(spark.range(5).select((F.col("id") * 2).alias("x")), "t")
    assert stored.count() == 5
    assert "Range" not in stored._jdf.queryExecution().executedPlan().toString()


def test_a_quoted_file_holds_a_bounded_number_of_rows(spark, tmp_path):
    """Such a file is read by one task, so one writing task may not put all its rows into it."""
    df = spark.range(0, 100, 1, 1).select("id", F.lit("a\nb").alias("a"))
    path = str(tmp_path / "bounded")
    files.write_delimited(df, path, header=True, quoted=True, rows_per_file=30)
    parts = list((tmp_path / "bounded").glob("part-*.csv"))
    assert len(parts) == 4
    assert max(p.read_text().count("a\nb") for p in parts) == 30
    back = files.read_inferred(spark, path, df.schema)
    assert sorted(tuple(r) for r in back.collect()) == [(i, "a\nb") for i in range(100)]


def test_compressed_text_brings_every_value_back(spark, tmp_path):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(AWKWARD, AWKWARD[::-1], strict=True))]
    df = spark.createDataFrame(rows, "i int, a string, b string").coalesce(1)
    path = str(tmp_path / "packed")
    files.write_delimited(
        df, path, header=True, quoted=True, rows_per_file=5, compression="gzip"
    )
    assert len(list((tmp_path / "packed").glob("part-*.csv.gz"))) == 3
    back = files.read_inferred(spark, path, df.schema).collect()
    assert sorted(tuple(r) for r in back) == rows


def test_the_change_table_takes_little_disk(spark, tmp_path, monkeypatch):
    """Its 39 quoted flags alone are 234 bytes a row as plain text, whatever the triples are."""
    deal = random.Random(5)

    def word():
        return "".join(deal.choices(string.ascii_letters + ' ,"', k=12))

    parts = [(i, word() if i % 50 else None, word(), word(), i % 60) for i in range(300)]
    orders = [(i, f"199{i % 9}-{i % 12 + 1:02}-{i % 28 + 1:02}", i * 7.25) for i in range(300)]
    customers = [(i, word()) for i in range(300)]
    for name, rows, schema in (
        ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        ("orders", orders, "o_orderkey long, o_orderdate string, o_totalprice double"),
        ("customer", customers, "c_custkey long, c_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    text = tmp_path / "text"
    monkeypatch.setattr(plans, "scratch_path", lambda *_: str(text))
    sums = plans.feature_csv(spark, str(tmp_path)).collect()

    table = change_table(pairs(spark, str(tmp_path)), "input1", "input2", "output", "template")
    wanted = table.collect()
    assert len(wanted) == 300 * 16
    back = files.read_inferred(spark, str(text), table.schema).collect()
    assert sorted(map(repr, back)) == sorted(map(repr, wanted))
    for row in sums:
        own = [r for r in wanted if r.ActClassify == row.template]
        assert row.asDict() == {"template": row.template} | {f: sum(r[f] for r in own) for f in FLAGS}
    assert len(sums) == 16
    assert sum(f.stat().st_size for f in text.iterdir()) < 100 * len(wanted)
