"""Conversions: toX() is empty where convertsToX() is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions import function
from pathloom.plans import coll as c
from pathloom.plans import operators as o
from pathloom.plans.coll import Coll, Ty
from pathloom.values import units

_DATE = r"\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?"
_TIME = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d+)?)?)?"
_ZONE = r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d)?"
_MOMENT, _CLOCK = rf"^{_DATE}(T({_TIME}{_ZONE})?)?$", rf"^T?{_TIME}$"


def _pair(name: str, ty: Ty, build, form: str | None = None) -> None:
    """build(scalar Column, Ty) -> Column or None where the type never converts;
    form: the texts that convert, if those that match it do."""

    def convert(x: Coll) -> Coll:
        x = c.as_one(x, f"to{name}()")
        if x.ty.name == "Empty":
            return c.nothing(ty)
        out = build(x.col, x.ty)
        return c.nothing(ty) if out is None else c.scalar(out, ty)

    @function(f"to{name}")
    def to(k, x, args, scope):
        return convert(x)

    @function(f"convertsTo{name}")
    def converts(k, x, args, scope):
        one = c.as_one(x, f"convertsTo{name}()")
        if one.ty.name == "Empty":
            return c.nothing(c.BOOLEAN)
        if form and one.ty.name == "String":
            return c.scalar(F.rlike(one.col, F.lit(form)), c.BOOLEAN)
        return c.scalar(F.when(one.col.isNotNull(), convert(one).col.isNotNull()), c.BOOLEAN)


def _variant(v: Column, ty: Ty) -> tuple[Column, Ty]:
    return (F.try_variant_get(v, "$", "string"), c.STRING) if ty.name == "Variant" else (v["value"], c.STRING) if ty.name == "Mixed" else (v, ty)


def _boolean(v, ty):
    v, ty = _variant(v, ty)
    if ty.name == "Boolean":
        return v
    if ty.name in c.NUMERIC:
        return F.when(v == 1, True).when(v == 0, False)
    if ty.name == "String":
        s = F.lower(v)
        return F.when(s.isin("true", "t", "yes", "y", "1", "1.0"), True).when(s.isin("false", "f", "no", "n", "0", "0.0"), False)


def _integer(v, ty):
    v, ty = _variant(v, ty)
    if ty.name == "Boolean":
        return v.cast("bigint")
    if ty.name == "Integer":
        return v.cast("bigint")
    if ty.name == "Long":
        return F.when(v.between(-(2**31), 2**31 - 1), v)
    if ty.name == "String":
        n = v.try_cast("bigint")
        return F.when(F.rlike(v, F.lit(r"^[+-]?\d+$")), F.when(F.abs(n) < 2**53, n))


def _long(v, ty):
    v, ty = _variant(v, ty)
    if ty.name in ("Boolean", "Integer", "Long"):
        return v.cast("bigint")
    if ty.name == "String":
        return F.when(F.rlike(v, F.lit(r"^[+-]?\d+$")), v.try_cast("bigint"))


def _decimal(v, ty):
    v, ty = _variant(v, ty)
    if ty.name in ("Boolean", *c.NUMERIC):
        return v.cast(c.DEC)
    if ty.name == "String":
        return F.when(F.rlike(v, F.lit(r"^[-+]?\d+(?:[.]\d+)?$")), v.try_cast(c.DEC))


def _string(v, ty):
    if ty.name == "Variant":
        return F.try_variant_get(v, "$", "string")
    if o.is_quantity(ty) and ty.name != "Quantity":
        q = o.quantity(c.scalar(v, ty))
        return c.to_text(q.col, c.QTY)
    return c.to_text(v, ty) if ty.name not in ("Struct", "TypeInfo") else None


def _matching(v: Column, form: str) -> Column:
    """v, or null where it doesn't match; v is named once, so that chains of conversions don't double."""
    return F.get(F.regexp_extract_all(v, F.lit(form + r"\R?"), F.lit(0)), F.lit(0))


def _date(v, ty):
    v, ty = _variant(v, ty)
    if ty.name in ("Date", "DateTime"):
        text = F.regexp_replace(c.temporal_text(v, ty), "T.*$", "")
        return text
    if ty.name == "String":
        return F.regexp_replace(_matching(v, _MOMENT), "T.*$", "")


def _datetime(v, ty):
    v, ty = _variant(v, ty)
    if ty.name in ("Date", "DateTime"):
        return c.temporal_text(v, ty)
    if ty.name == "String":
        return _matching(v, _MOMENT)


def _time(v, ty):
    v, ty = _variant(v, ty)
    if ty.name == "Time":
        return c.temporal_text(v, ty)
    if ty.name == "String":
        return F.regexp_replace(_matching(v, _CLOCK), "^T", "")


_pair("Boolean", c.BOOLEAN, _boolean)
_pair("Integer", c.INTEGER, _integer)
_pair("Long", c.LONG, _long)
_pair("Decimal", c.DECIMAL, _decimal)
_pair("String", c.STRING, _string)
_pair("Date", c.DATE, _date, _MOMENT)
_pair("DateTime", c.DATETIME, _datetime, _MOMENT)
_pair("Time", c.TIME, _time, _CLOCK)


def _quantity(k, x: Coll, args, scope) -> Coll:
    x = c.as_one(x, "toQuantity()")
    if x.ty.name == "Empty":
        return c.nothing(c.QTY)
    v, ty = _variant(x.col, x.ty)
    make = lambda n, u: F.struct(n.cast(c.DEC).alias("value"), u.alias("unit"))
    if ty.name == "Boolean":
        q = F.when(v.isNotNull(), make(v.cast("int"), F.lit("1")))
    elif ty.name in c.NUMERIC or o.is_quantity(ty):
        q = o.quantity(c.scalar(v, ty)).col
    elif ty.name == "String":
        form = rf"^([-+]?\d+(?:[.]\d+)?)(?:\s*'([^']+)'|\s*((?:{'|'.join(units.CALENDAR)})s?))?$"
        number, code, word = (F.regexp_extract(v, form, i) for i in (1, 2, 3))
        unit = F.when(code != "", code).when(word != "", F.regexp_replace(word, "s$", "")).otherwise(F.lit("1"))
        q = F.when(F.rlike(v, F.lit(form)), make(number.try_cast(c.DEC), unit))
    else:
        return c.nothing(c.QTY)
    if not args:
        return c.scalar(q, c.QTY, const=x.const if x.ty.name == "Quantity" else None)
    unit = c.want(k.arg(args[0], scope), "String", "the unit")
    to = F.lit(unit.const.removesuffix("s") if isinstance(unit.const, str) and unit.const.removesuffix("s") in units.CALENDAR else unit.const) if unit.const is not None else unit.col
    fa, da = units.factor_and_dimension(q["unit"])
    fb, db = units.factor_and_dimension(to, unit.const if isinstance(unit.const, str) else None)
    return c.scalar(F.when(q["unit"] == to, q).when(q.isNotNull() & (da == db), make(F.round(q["value"].cast("double") * fa / fb, 12), to)), c.QTY)


@function("toQuantity", 0, 1)
def to_quantity(k, x, args, scope):
    return _quantity(k, x, args, scope)


@function("convertsToQuantity", 0, 1)
def converts_to_quantity(k, x, args, scope):
    one = c.as_one(x, "convertsToQuantity()")
    if one.ty.name == "Empty":
        return c.nothing(c.BOOLEAN)
    return c.scalar(F.when(one.col.isNotNull(), _quantity(k, one, args, scope).col.isNotNull()), c.BOOLEAN)


