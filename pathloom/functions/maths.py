"""Mathematical functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import function
from pathloom.lang.errors import PathTypeError
from pathloom.plans import coll as c
from pathloom.plans.coll import Coll


def _number(x: Coll, name: str) -> Coll:
    return c.want(x, c.NUMERIC, f"{name}()")


@function("abs")
def abs_(k, x, args, scope):
    if x.ty.name == "Quantity":
        q = c.as_one(x)
        return c.scalar(F.when(q.col.isNotNull(), F.struct(F.abs(q.col["value"]).alias("value"), q.col["unit"].alias("unit"))), c.QTY)
    x = _number(x, "abs")
    return x.with_(col=F.abs(x.col), const=None)


def _whole(name, build):
    @function(name)
    def run(k, x, args, scope):
        x = _number(x, name)
        return c.scalar(build(x.col).cast("bigint"), c.INTEGER)


_whole("ceiling", F.ceil)
_whole("floor", F.floor)
_whole("truncate", lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)))


@function("round", 0, 1)
def round_(k, x, args, scope):
    x = _number(x, "round")
    n = k.arg(args[0], scope).const if args else 0
    if not isinstance(n, int) or n < 0:
        raise PathTypeError("round() takes a literal precision of 0 or more")
    if isinstance(x.ty.dt, (T.DoubleType, T.FloatType)):
        return c.scalar(F.round(x.col, n), c.DOUBLE)
    return c.scalar(F.round(x.col, n).cast(T.DecimalType(38, min(n, 18))), c.Ty("Decimal", T.DecimalType(38, min(n, 18))))


def _finite(v):
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _real(name, build):
    @function(name)
    def run(k, x, args, scope):
        x = _number(x, name)
        return c.scalar(_finite(build(x.col.cast("double"))), c.DOUBLE)


_real("exp", F.exp)
_real("ln", F.ln)
_real("sqrt", F.sqrt)


@function("log", 1)
def log(k, x, args, scope):
    v, b = _number(x, "log").col.cast("double"), _number(k.arg(args[0], scope), "log").col.cast("double")
    return c.scalar(_finite(F.try_divide(F.ln(v), F.ln(b))), c.DOUBLE)


@function("power", 1)
def power(k, x, args, scope):
    x, e = _number(x, "power"), _number(k.arg(args[0], scope), "power")
    out = _finite(F.pow(x.col.cast("double"), e.col.cast("double")))
    if x.ty.name == "Integer" and e.ty.name == "Integer" and isinstance(e.const, int) and e.const >= 0:
        return c.scalar(F.round(out).cast("bigint"), c.INTEGER)
    return c.scalar(out, c.DOUBLE)
