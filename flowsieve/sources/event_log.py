"""Event logs from newline-delimited JSON, plain or gzip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.scalars import parse_timestamp
from flowsieve.sources.schemas import EVENT_NESTED, EVENT_SCALARS


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Raw lines with the file they came from.

    A gzip file is one partition whatever its size; ``partitions`` spreads its lines before
    the expensive parsing.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    return lines.repartition(partitions) if partitions else lines


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n\f"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their JSON as ``v`` and a ``malformed`` flag.

    Malformed means unreadable or not an object.  A wrong type inside a valid object is not
    malformed; that field alone reads as null.
    """
    text = _stripped(F.col("value"))
    parsed = lines.where(text != "").withColumn("v", F.try_parse_json("value"))
    # Valid JSON that starts with a brace is an object.
    return parsed.withColumn("malformed", F.col("v").isNull() | ~text.startswith("{"))


def malformed_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where("malformed").drop("v", "malformed")


def line_counts(lines: DataFrame) -> DataFrame:
    """Total, blank, malformed and decoded lines in one pass."""
    text = _stripped(F.col("value"))
    blank = text == ""
    good = text.startswith("{") & F.try_parse_json("value").isNotNull()
    return lines.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(blank).alias("empty_lines"),
        F.count_if(~blank & ~good).alias("malformed_lines"),
        F.count_if(~blank & good).alias("decoded_events"),
    )


def typed_events(parsed: DataFrame) -> DataFrame:
    """Event records with declared nested types, plus the parsed instant ``ts``.

    ``row_id`` is a hash of the whole line: stable under repartitioning and retries.
    """
    v = F.col("v")
    scalars = [F.try_variant_get(v, f"$.{name}", "string").alias(name) for name in EVENT_SCALARS]
    nested = {
        name: F.try_variant_get(v, f"$.{name}", schema.simpleString()) for name, schema in EVENT_NESTED.items()
    }
    alert_kind = F.schema_of_variant(F.try_variant_get(v, "$.alert", "variant"))
    is_object = F.coalesce(alert_kind.startswith("OBJECT"), F.lit(False))
    alert = F.when(
        is_object,
        F.struct(
            *[
                F.try_variant_get(v, f"$.alert.{f.name}", "string").alias(f.name)
                for f in EVENT_NESTED["alert"].fields
            ],
            (alert_kind == "OBJECT<>").alias("empty"),
        ),
    )
    records = parsed.where(~F.col("malformed")).select(
        F.md5(F.col("value").cast("binary")).alias("row_id"),
        *scalars,
        *[alert.alias(n) if n == "alert" else c.alias(n) for n, c in nested.items()],
    )
    return records.withColumn("ts", parse_timestamp("timestamp"))


def read_event_log(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Typed event records of every well-formed line under ``path``."""
    return typed_events(parse_lines(read_lines(spark, path, partitions)))


def flatten_one_level(records: DataFrame) -> DataFrame:
    """Struct columns become ``parent.child`` columns; deeper levels stay nested."""
    out = []
    for field in records.schema.fields:
        if hasattr(field.dataType, "fields"):
            out += [
                F.col(f"`{field.name}`.`{child.name}`").alias(f"{field.name}.{child.name}")
                for child in field.dataType.fields
            ]
        else:
            out.append(F.col(f"`{field.name}`"))
    return records.select(*out)


def key_counts(parsed: DataFrame) -> DataFrame:
    """How many objects carry each top-level key."""
    keys = F.explode(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")))
    return parsed.where(~F.col("malformed")).select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
