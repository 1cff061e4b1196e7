"""Columns of a projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.lang.errors import PathTypeError
from pathloom.plans import coll as c
from pathloom.plans.coll import Coll

_SHAPERS = ("as", "choices", "enum")
_KNOWN = {"path", "test", "collection", "default", "pick", "type", *_SHAPERS}


def validate(name: str, spec: dict) -> None:
    if set(spec) - _KNOWN:
        raise PathTypeError(f"column {name}: unknown options {sorted(set(spec) - _KNOWN)}")
    if ("path" in spec) == ("test" in spec):
        raise PathTypeError(f"column {name} needs a path or a test")
    if sum(s in spec for s in _SHAPERS) > 1:
        raise PathTypeError(f"column {name} takes one of {', '.join(_SHAPERS)}")
    if "pick" in spec and not isinstance(spec.get("choices"), (list, tuple)):
        raise PathTypeError(f"column {name}: pick needs a table of choices")
    if "test" in spec and len(spec) > 1:
        raise PathTypeError(f"column {name}: a test takes no options")


def shape(engine, df, name: str, spec: dict, kind: str | None, bound: dict) -> Column:
    validate(name, spec)
    if "test" in spec:
        return c.holds(engine.compile(df, spec["test"], kind, bound))
    x = engine.compile(df, spec["path"], kind, bound)
    if not spec.get("collection") and not x.single:
        x = c.as_one(x, f"column {name}")
    x = _shaped(x, spec)
    if spec.get("collection"):
        return c.many(x)
    if spec.get("default") is not None:
        return F.coalesce(x.col, F.lit(spec["default"]).cast(x.ty.dt) if x.ty.name != "Empty" else F.lit(spec["default"]))
    return x.col


def _shaped(x: Coll, spec: dict) -> Coll:
    if "enum" in spec:
        return c.mapped(x, lambda v: F.when(v.isin(*spec["enum"]), v), x.ty)
    if "as" in spec:
        if spec["as"] == "Date":
            ty = c.Ty("DateTime", c.T.TimestampType())
            return c.mapped(x, lambda v: F.try_to_timestamp(c.temporal_text(v, x.ty)), ty)
        return c.mapped(x, spec["as"], x.ty)
    if "choices" in spec:
        table = spec["choices"]
        if not isinstance(table, dict):
            pick, seen = spec.get("pick"), {}
            for row in table:
                seen.setdefault(row["code"], row[pick] if pick else row)
            table = seen
        if not table:
            return c.nothing(x.ty)
        sample = next(iter(table.values()))
        if isinstance(sample, dict):
            keys = list(dict.fromkeys(k for r in table.values() for k in r))
            make = lambda r: F.struct(*[F.lit(r.get(k)).alias(k) for k in keys])
            ty = c.Ty("Struct", c.T.StructType([c.T.StructField(k, c.T.StringType()) for k in keys]))
        else:
            make, ty = F.lit, c.STRING if isinstance(sample, str) else c.INTEGER
        lookup = F.create_map(*[v for k, r in table.items() for v in (F.lit(k), make(r))])
        return c.mapped(x, lambda v: F.try_element_at(lookup, v.cast("string")), ty)
    return x
