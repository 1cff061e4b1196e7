"""Views: classes that name a resource type, variables and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.lang.errors import PathTypeError


class _Column:
    def __init__(self, spec: dict):
        self.spec = spec


def column(path: str, **options) -> _Column:
    return _Column({"path": path} | options)


def criteria(test: str) -> _Column:
    return _Column({"test": test})


class View:
    """Subclass with type, variables, env and columns; subclasses inherit them."""

    type: str | None = None
    variables: dict = {}
    env: dict = {}

    @classmethod
    def columns(cls) -> dict:
        out: dict = {}
        for base in reversed(cls.__mro__):
            out |= {k: v.spec for k, v in vars(base).items() if isinstance(v, _Column)}
        return out

    @classmethod
    def project(cls, engine, df: DataFrame, keep: list[str] = (), row_order: str | None = None) -> DataFrame:
        """One row for each resource; one of another type is an error of the job."""
        if cls.type and "resourceType" in df.columns:
            wrong = F.raise_error(F.concat(F.lit(f"PATH-RUNTIME: {cls.__name__} takes {cls.type}, not "), F.coalesce("resourceType", F.lit("nothing"))))
            df = df.where(F.when(F.col("resourceType") == cls.type, F.lit(True)).otherwise(wrong.cast("boolean")))
        if not cls.columns():
            raise PathTypeError(f"{cls.__name__} has no columns")
        env: dict = {}
        variables: dict = {}
        for base in reversed(cls.__mro__):
            env |= vars(base).get("env", {})
            variables |= vars(base).get("variables", {})
        return engine.with_(env=env).project(df, cls.columns(), kind=cls.type, variables=variables, keep=keep, row_order=row_order)
