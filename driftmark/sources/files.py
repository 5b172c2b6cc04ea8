"""Text, libsvm and model files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the headerless pair file.
PAIR_COLUMNS = ("InputCol1", "InputCol2", "OutputCol", "Classification")


# Stands for null where every field is quoted, so that null and empty text stay apart: a
# character of the private use area.
_NULL = "\ue000"
ROWS_PER_FILE = 1 << 16
_QUOTED = {"quote": '"', "escape": '"', "nullValue": _NULL, "emptyValue": "", "lineSep": "\n"}


def read_headerless(
    spark: SparkSession,
    path: str,
    names: Sequence[str] = PAIR_COLUMNS,
    sep: str = ",",
    quoted: bool = False,
) -> DataFrame:
    """Positional strings; an empty field is empty text, never null. Without ``quoted`` every
    character but the separator and the line break is data; with it, fields are quoted as
    ``write_delimited`` does (a quoted field may hold line breaks, so a file is one task)."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("header", False).option("sep", sep)
    if quoted:
        return reader.options(**_QUOTED).option("multiLine", True).csv(path).na.fill("")
    return reader.option("quote", "").csv(path).na.fill("")


def read_with_header(
    spark: SparkSession, path: str, doubles: Mapping[str, int], sep: str = ","
) -> DataFrame:
    """Chosen positions as doubles; the first line, and every line equal to it, is dropped."""
    lines = spark.read.text(path)
    header = lines.first().value
    fields = F.split(F.col("value"), f"[{sep}]")
    body = lines.where(F.col("value") != header)
    return body.select(*(fields[i].cast("double").alias(name) for name, i in doubles.items()))


def read_inferred(
    spark: SparkSession, path: str, schema: T.StructType | None = None, quoted: bool = True
) -> DataFrame:
    """Comma text with a header; types are inferred unless given. Inference is a second pass
    over the file, so give the schema for large inputs. Quoted fields may hold separators, quotes
    and line breaks; quoted empty text is kept, nothing between separators is null."""
    reader = spark.read.option("header", True)
    if quoted:
        reader = reader.options(**_QUOTED).option("multiLine", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def _plain(c: str, kind: T.DataType, sep: str) -> Column:
    """The column, or an error where unquoted text could not be read back."""
    column = F.col(f"`{c}`")
    if not isinstance(kind, T.StringType):
        return column
    unsafe = column.rlike(f'["\\r\\n\\x00]|\\Q{sep}\\E')
    told = F.raise_error(F.concat(F.lit(f"needs quoting, column {c}: "), column))
    return F.when(unsafe, told).otherwise(column).alias(c)


def write_delimited(
    df: DataFrame,
    path: str,
    header: bool = False,
    single_file: bool = False,
    quoted: bool = False,
    sep: str = ",",
    rows_per_file: int = ROWS_PER_FILE,
    compression: str | None = None,
) -> None:
    """Delimited text. With ``quoted`` every field is quoted, inner quotes are doubled and null is a mark
    of its own, so any value can be read back; without, a text with a separator, a quote or a line break raises.
    A quoted file is read by one task, so none gets more than ``rows_per_file`` rows: fewer for long
    texts. ``single_file`` sends everything through one task and into one file: small tables.
    ``compression`` names a codec, such as gzip; the readers here tell it by the file names."""
    if not quoted:
        df = df.select(*(_plain(f.name, f.dataType, sep) for f in df.schema))
    out = df.coalesce(1) if single_file else df
    writer = (
        out.write.mode("overwrite")
        .option("header", header)
        .option("sep", sep)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", 0 if single_file else rows_per_file)
    )
    if quoted:
        writer = writer.options(**_QUOTED).option("quoteAll", True)
    else:
        writer = writer.option("quote", "").option("emptyValue", "")
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """(label, features). With the number of features given, the file is not scanned for it."""
    return spark.read.format("libsvm").option("numFeatures", str(num_features)).load(path)


def write_libsvm(df: DataFrame, path: str) -> None:
    """df has the columns label and features."""
    df.select("label", "features").write.mode("overwrite").format("libsvm").save(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type[MLReadable], path: str):
    return kind.load(path)
