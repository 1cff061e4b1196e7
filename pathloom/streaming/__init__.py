"""Expressions over streams. Those of one resource need no state, so the same
Columns run on readStream; what is across resources uses watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.api.engine import Engine


def read(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def windowed(engine: Engine, stream: DataFrame, time: str, size: str, aggregates: dict[str, tuple[str, str]], late: str = "10 minutes", slide: str | None = None, by: dict[str, str] | None = None, kind: str | None = None) -> DataFrame:
    """Aggregates of expressions by window of an event-time column; rows later than `late` are dropped."""
    fns = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}
    keys = {n: engine.first(stream, e, kind) for n, e in (by or {}).items()}
    vals = {n: engine.first(stream, e, kind) for n, (_, e) in aggregates.items()}
    rows = stream.select(stream[time].cast("timestamp").alias("__t"), *[v.alias(n) for n, v in (keys | vals).items()])
    window = F.window("__t", size, slide) if slide else F.window("__t", size)
    return rows.withWatermark("__t", late).groupBy(window.alias("window"), *keys).agg(*[fns[f](n).alias(n) for n, (f, _) in aggregates.items()])
