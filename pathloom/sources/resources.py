"""Resources as DataFrames: JSON, NDJSON, Parquet, Bundles and schemaless data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """One resource a line (or a file). Give the schema where it is known: without
    one the data are read twice."""
    reader = spark.read.option("multiLine", multiline).option("primitivesAsString", False)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_objects(spark: SparkSession, objects: list[dict], schema: T.StructType | str | None = None) -> DataFrame:
    """Resources given as Python objects."""
    lines = spark.createDataFrame([(json.dumps(o),) for o in objects], "value string")
    if schema is None:
        schema = spark.range(1).select(F.schema_of_json(F.lit(json.dumps(objects)))).first()[0]
        schema = spark.sql(f"select cast(null as {schema}) as x").schema["x"].dataType.elementType
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def schemaless(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON text as a VARIANT, for data whose shape isn't known."""
    return df.withColumn(column, F.try_parse_json(df[column]))


def bundle_entries(df: DataFrame) -> DataFrame:
    """The resources of Bundles, each a row, with their place in `entry_index`."""
    rows = df.select(F.posexplode("entry").alias("entry_index", "entry"))
    return rows.where("entry.resource is not null").select("entry_index", "entry.resource.*")
