"""Collections over all resources as relational operators: `Kind.path` flattened
to rows, then counted, summed, made distinct or sorted by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.api.engine import Engine


def values(engine: Engine, df: DataFrame, expression: str, kind: str | None = None, name: str = "value") -> DataFrame:
    """All results of all rows, as rows."""
    x = engine.compile(df, expression, kind)
    if x.single:
        return df.select(x.col.alias(name)).where(F.col(name).isNotNull())
    return df.select(F.explode(x.col).alias(name))


def distinct(engine, df, expression, kind=None, name="value") -> DataFrame:
    return values(engine, df, expression, kind, name).distinct()


def aggregate(engine, df, expression, how: dict[str, str], kind=None) -> DataFrame:
    """how: output name to sum, min, max, avg or count."""
    fns = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}
    return values(engine, df, expression, kind).agg(*[fns[f]("value").alias(n) for n, f in how.items()])


def group(engine: Engine, df: DataFrame, by: dict[str, str], aggregates: dict[str, tuple[str, str]], kind: str | None = None) -> DataFrame:
    """Rows grouped by scalar expressions; aggregates are (function, expression)."""
    cols = {n: engine.first(df, e, kind) for n, e in by.items()} | {n: engine.first(df, e, kind) for n, (_, e) in aggregates.items()}
    fns = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}
    return df.select(*[v.alias(n) for n, v in cols.items()]).groupBy(*by).agg(*[fns[f](n).alias(n) for n, (f, _) in aggregates.items()])


def top(engine: Engine, df: DataFrame, key: str, n: int, kind: str | None = None, descending: bool = True, tie: str = "id") -> DataFrame:
    """The n rows that are first by a key, ties by `tie`; Spark keeps n a task."""
    k = engine.first(df, key, kind)
    return df.orderBy(k.desc_nulls_last() if descending else k.asc_nulls_last(), tie).limit(n)
