"""Flow-feature tables from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.scalars import is_finite
from flowsieve.sources.schemas import FLOW_SCHEMA

UTF8, CP1252 = "UTF-8", "windows-1252"

# Spark's CSV reader knows ISO-8859-1 but not windows-1252.  The two differ only in bytes
# 0x80-0x9F, so the file is read as the former and those characters are replaced.
_C1_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_C1_TEXT = "".join(chr(b) for b in _C1_BYTES)
_CP1252_TEXT = bytes(_C1_BYTES).decode("cp1252")


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding in which every line of the input has valid bytes.

    A pass over all lines, which ends at the first broken one; callers who know the encoding pass it.
    """
    broken = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return UTF8 if broken.isEmpty() else CP1252


def _reader_charset(encoding: str) -> str:
    return "ISO-8859-1" if encoding == CP1252 else encoding


def _as_cp1252(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.translate(f"`{f.name}`", _C1_TEXT, _CP1252_TEXT).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def read_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of a CSV file, stripped of surrounding blanks."""
    raw = spark.read.option("header", True).option("encoding", _reader_charset(encoding)).csv(path).columns
    fix = str.maketrans(_C1_TEXT, _CP1252_TEXT) if encoding == CP1252 else {}
    return [name.translate(fix).strip() for name in raw]


def non_finite_to_null(df: DataFrame) -> DataFrame:
    fixes = {
        f.name: F.when(is_finite(F.col(f"`{f.name}`")), F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(*[fixes.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_flow_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = FLOW_SCHEMA,
    encoding: str | None = None,
) -> DataFrame:
    """Typed CSV scan with clean column names; infinities become null.

    Types come from ``schema`` by column name, never from a pass over the data.  Columns
    the schema does not know stay text, so a later check can report them.
    """
    encoding = encoding or detect_encoding(spark, path)
    names = read_header(spark, path, encoding)
    known = {f.name: f.dataType for f in schema.fields}
    actual = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
    df = (
        spark.read.schema(actual)
        .option("header", True)
        .option("encoding", _reader_charset(encoding))
        .option("enforceSchema", True)
        .option("positiveInf", "inf")
        .option("negativeInf", "-inf")
        .option("nanValue", "nan")
        .csv(path)
    )
    return non_finite_to_null(_as_cp1252(df) if encoding == CP1252 else df)
