"""Dates and times: clock, components, boundaries, precision."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import function
from pathloom.lang.errors import PathTypeError
from pathloom.plans import coll as c
from pathloom.plans import operators as o
from pathloom.plans.coll import Coll, Ty
from pathloom.values import temporal


def _clock(name, ty):
    @function(name)
    def run(k, x, args, scope):
        if k.now:
            text = temporal.now_parts(ty, k.now)
            return c.scalar(F.lit(text), ty, const=text)
        pattern = {"DateTime": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "Date": "yyyy-MM-dd", "Time": "HH:mm:ss.SSS"}[ty.name]
        return c.scalar(F.date_format(F.current_timestamp(), pattern), ty)


_clock("now", c.DATETIME)
_clock("today", c.DATE)
_clock("timeOfDay", c.TIME)


def _component(name, native, start, length, of_time=None):
    """Digits at a place of the text; of_time is their place in a Time."""

    @function(name)
    def run(k, x, args, scope):
        x = c.as_one(x, f"{name}()")
        if x.ty.name not in c.TEMPORAL or x.ty.name == "Time" and of_time is None or x.ty.name == "Date" and start > 10:
            return c.nothing(c.INTEGER)
        if x.ty.native and native and x.ty.name != "Time":
            return c.scalar(native(x.col).cast("bigint"), c.INTEGER)
        at = of_time if x.ty.name == "Time" else start

        def digits(p: temporal.Parts):
            text = p.body if name == "millisecondOf" else p.shown
            return F.when(F.length(text) >= at + length - 1, F.substring(text, at, length).cast("bigint"))

        if x.ty.native or x.const is not None:
            return c.scalar(temporal.with_parts(x, digits), c.INTEGER)
        # without an offset it is the text itself that counts
        plain = digits(temporal.Parts(x.col, x.col, temporal.body(x.col, x.ty.name), F.lit(""), x.ty.name == "Time", False))
        return c.scalar(F.when(temporal.bare(x), plain).otherwise(temporal.with_parts(x, digits)), c.INTEGER)


_component("yearOf", F.year, 1, 4)
_component("monthOf", F.month, 6, 2)
_component("dayOf", F.day, 9, 2)
_component("hourOf", F.hour, 12, 2, 1)
_component("minuteOf", F.minute, 15, 2, 4)
_component("secondOf", F.second, 18, 2, 7)
_component("millisecondOf", lambda v: (F.extract(F.lit("SECOND"), v) * 1000).cast("bigint") % 1000, 21, 3, 10)


@function("timezoneOffsetOf")
def timezone_offset(k, x, args, scope):
    x = c.as_one(x, "timezoneOffsetOf()")
    if x.ty.name != "DateTime":
        return c.nothing(c.DECIMAL)
    hours = lambda z: F.concat(F.substring(z, 1, 1), F.lit("1")).try_cast("int") * (F.substring(z, 2, 2).try_cast("int") + F.substring(z, 5, 2).try_cast("int") / 60)
    offset = lambda z: F.when(z == "Z", F.lit(0.0)).when(z != "", hours(z))
    if x.ty.native or x.const is not None:
        return c.scalar(offset(temporal.zone(x)), c.DOUBLE)
    return c.scalar(F.when(x.col.endswith("Z"), F.lit(0.0)).when(~temporal.bare(x), c.bind(temporal.zone(x), offset)), c.DOUBLE)


@function("dateOf")
def date_of(k, x, args, scope):
    x = c.as_one(x, "dateOf()")
    if x.ty.name not in ("Date", "DateTime"):
        return c.nothing(c.DATE)
    return c.scalar(F.date_format(x.col, "yyyy-MM-dd") if x.ty.native else F.regexp_replace(x.col, "T.*$", ""), c.DATE)


@function("timeOf")
def time_of(k, x, args, scope):
    x = c.as_one(x, "timeOf()")
    if x.ty.name != "DateTime":
        return c.nothing(c.TIME)
    if x.ty.native:
        return c.scalar(F.date_format(x.col, "HH:mm:ss.SSS"), c.TIME)
    t = F.regexp_extract(x.col, r"T([0-9:.]+)", 1)
    return c.scalar(F.nullif(t, F.lit("")), c.TIME)


def _temporal_edge(x: Coll, low: bool, digits: int | None) -> Coll:
    time = x.ty.name == "Time"
    most = 9 if time else 17
    want = most if digits is None else digits
    if want > most or want < 0:
        return c.nothing(x.ty)
    # characters of the text at each number of digits
    width = {2: 2, 4: 5, 6: 8, 9: 12} if time else {4: 4, 6: 7, 8: 10, 10: 13, 12: 16, 14: 19, 17: 23}
    keep = max((w for d, w in width.items() if d <= want), default=0)
    if x.ty.name == "Date":
        keep = min(keep, 10)
    if not keep:
        return c.nothing(x.ty)
    zoned = x.ty.name == "DateTime" and keep > 10

    def edge(p: temporal.Parts):
        if time:
            fill = "00:00:00.000" if low else "23:59:59.999"
            return F.substring(F.concat(p.shown, F.substring(F.lit(fill), F.length(p.shown) + 1, F.lit(12))), 1, keep)
        month = F.when(F.length(p.shown) >= 7, p.shown).otherwise(F.concat(p.shown, F.lit("-01" if low else "-12")))
        last = F.lit("01") if low else F.date_format(F.last_day(F.concat(F.substring(month, 1, 7), F.lit("-01")).try_cast("date")), "dd")
        day = F.when(F.length(p.shown) >= 10, p.shown).otherwise(F.concat(month, F.lit("-"), last))
        fill = "0000-00-00T00:00:00.000" if low else "0000-00-00T23:59:59.999"
        out = lambda day: F.substring(F.concat(day, F.substring(F.lit(fill), F.length(day) + 1, F.lit(23))), 1, keep)
        zone = F.when(p.zone != "", p.zone).otherwise(F.lit("+14:00" if low else "-12:00"))
        return F.concat(c.bind(day, out), zone) if zoned else c.bind(day, out)

    return c.scalar(temporal.with_parts(x, edge), c.TIME if time else c.DATETIME if zoned else c.DATE)


def _boundary(name, low):
    @function(name, 0, 1)
    def run(k, x, args, scope):
        x = c.as_one(x, f"{name}()")
        digits = k.arg(args[0], scope).const if args else None
        if args and not isinstance(digits, int):
            raise PathTypeError(f"{name}() takes a literal precision")
        if x.ty.name in c.NUMERIC:
            scale = 8 if digits is None else digits
            if not 0 <= scale <= 28:
                return c.nothing(c.DECIMAL)
            own = x.scale if x.scale is not None else x.ty.dt.scale if isinstance(x.ty.dt, T.DecimalType) else 0 if x.ty.name != "Decimal" else None
            if x.const is not None:
                half = Decimal(5).scaleb(-(own + 1))
                v = Decimal(x.const) + (-half if low else half)
                if scale < own + 1:
                    v = v.quantize(Decimal(1).scaleb(-scale), ROUND_FLOOR if low else ROUND_CEILING)
                s = min(scale, 20)
                return c.scalar(F.lit(v).cast(T.DecimalType(38, s)), Ty("Decimal", T.DecimalType(38, s)), scale=s)
            if isinstance(x.ty.dt, T.DecimalType):
                p, s = min(38, x.ty.dt.precision + 2), x.ty.dt.scale + 1
                half = F.lit(Decimal(5).scaleb(-s)).cast(T.DecimalType(s + 1, s))
                v, dt = o.added("-" if low else "+", x.col, (p, s), half, (s + 1, s))
                out = T.DecimalType(38, min(scale, s))
                v = v if scale >= s else (F.floor if low else F.ceil)(v, F.lit(scale))
                return c.scalar(v.cast(out), Ty("Decimal", out), scale=out.scale)
            text = F.regexp_extract(c.to_text(x.col, x.ty), r"\.(\d+)$", 1)
            digits_ = F.length(text) if own is None else F.lit(own)
            half = F.pow(F.lit(10.0), -digits_) / 2
            v = x.col.cast("double") + (-half if low else half)
            m = F.pow(F.lit(10.0), F.lit(scale))
            scaled = F.round(v * m, 6)
            return c.scalar((F.floor(scaled) if low else F.ceil(scaled)) / m, c.DOUBLE)
        if x.ty.name in c.TEMPORAL:
            return _temporal_edge(x, low, digits)
        if x.ty.name == "Empty":
            return c.nothing(c.DECIMAL)
        raise PathTypeError(f"{name}() can't take {x.ty.name}")


_boundary("lowBoundary", True)
_boundary("highBoundary", False)


@function("precision")
def precision(k, x, args, scope):
    x = c.as_one(x, "precision()")
    if x.ty.name in ("Integer", "Long"):
        return c.scalar(F.when(x.col.isNotNull(), F.lit(0).cast("bigint")), c.INTEGER)
    if x.ty.name == "Decimal":
        if x.scale is not None:
            return c.scalar(F.when(x.col.isNotNull(), F.lit(x.scale).cast("bigint")), c.INTEGER)
        return c.scalar(F.length(F.regexp_extract(c.to_text(x.col, x.ty), r"\.(\d+)$", 1)).cast("bigint"), c.INTEGER)
    if x.ty.name in c.TEMPORAL:
        text = F.regexp_replace(c.temporal_text(x.col, x.ty), r"(Z|[+-]\d\d:\d\d)$", "")
        return c.scalar(F.length(F.regexp_replace(text, r"\D", "")).cast("bigint"), c.INTEGER)
    if x.ty.name == "Empty":
        return c.nothing(c.INTEGER)
    raise PathTypeError(f"precision() can't take {x.ty.name}")
