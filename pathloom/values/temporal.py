"""Dates and times of any precision, as text or as native Spark values.

A text value is ISO text without the @: its length, less the offset, tells the
precision. Seconds and milliseconds are one level.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.plans.coll import Coll, Ty, bind, temporal_text

_ZONE = r"(Z|[+-]\d\d:\d\d)$"
#: An offset, and the T before it where there is no time.
_END = r"T?(Z|[+-]\d\d:\d\d)?$"
_FULL = "0000-01-01T00:00:00.000"


@dataclass
class Parts:
    text: Column
    shown: Column  # text without offset
    body: Column  # that, with a fraction of three digits where seconds are given
    zone: Column  # offset text, '' where there is none
    time: bool  # a Time
    native: bool
    const: str | None = None


def zone(c: Coll) -> Column:
    """The offset's text, '' where there is none."""
    if c.ty.native:
        return F.lit("Z") if isinstance(c.ty.dt, T.TimestampType) else F.lit("")
    return F.lit(split_zone(c.const)[1]) if isinstance(c.const, str) else F.regexp_extract(c.col, _ZONE, 1)


def bare(c: Coll) -> Column:
    """Whether the text is one without an offset or a last T, told without a regular
    expression. What holds for those can be plain, compiled code, with `with_parts`
    for the rest."""
    if c.ty.native:
        return F.lit(not isinstance(c.ty.dt, T.TimestampType))
    last = c.col.substr(-1, 1)
    return (last >= "0") & (last <= "9") & ~((c.col.substr(-3, 1) == ":") & c.col.substr(-6, 1).isin("+", "-"))


def with_parts(c: Coll, fn: Callable[[Parts], Column]) -> Column:
    """fn of c's parts. Text, offset and what is shown are computed once, however
    often fn names them: as plain columns they would double the expression at every
    step. The body is an expression of what is shown."""
    time = c.ty.name == "Time"
    if c.ty.native:
        text = F.date_format(c.col, "yyyy-MM-dd'T'HH:mm:ss.SSS") if c.ty.name == "DateTime" else temporal_text(c.col, c.ty)
        return bind(text, lambda t: fn(Parts(t, t, t, zone(c), time, True)))
    if isinstance(c.const, str):  # folded while planning
        b, z = split_zone(c.const)
        return fn(Parts(F.lit(c.const), F.regexp_replace(F.lit(c.const), _END, ""), F.lit(b), F.lit(z), time, False, c.const))
    split = lambda t: F.struct(t.alias("text"), F.regexp_replace(t, _END, "").alias("shown"), F.regexp_extract(t, _ZONE, 1).alias("zone"))
    return bind(bind(c.col, split), lambda p: fn(Parts(p["text"], p["shown"], body(p["shown"], c.ty.name), p["zone"], time, False)))


def body(shown: Column, kind: str) -> Column:
    """With a fraction of three digits where there are seconds."""
    n, seconds = F.length(shown), 8 if kind == "Time" else 19
    return F.when(n < seconds, shown).otherwise(F.substring(F.concat(shown, F.when(n == seconds, F.lit(".000")).otherwise(F.lit("000"))), 1, seconds + 4))


def split_zone(text: str) -> tuple[str, str]:
    m = re.search(_ZONE, text)
    zone = m[0] if m else ""
    body = (text[: m.start()] if m else text).removesuffix("T")
    seconds = 8 if re.match(r"\d\d:|\d\d$", body) else 19
    if len(body) >= seconds:
        body = (body + (".000" if len(body) == seconds else "000"))[: seconds + 4]
    return body, zone


def _shifted(p: Parts) -> Column:
    """The text at UTC, where there are an offset and a time."""
    if p.const is not None and not split_zone(p.const)[1]:
        return p.body
    if p.const is None:
        return F.when(p.zone == "", p.body).otherwise(bind(p.body, lambda b: _at_offset(replace(p, body=b))))
    return _at_offset(p)


def _at_offset(p: Parts) -> Column:
    full = F.concat(p.body, F.substring(F.lit(_FULL), F.length(p.body) + 1, F.lit(23)))
    minutes = F.when(p.zone == "Z", F.lit(0)).otherwise(
        F.concat(F.substring(p.zone, 1, 1), F.lit("1")).cast("int") * (F.substring(p.zone, 2, 2).cast("int") * 60 + F.substring(p.zone, 5, 2).cast("int"))
    )
    moment = F.try_to_timestamp(full, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.when((p.zone != "") & (F.length(p.body) > 10), F.substring(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(1), F.length(p.body))).otherwise(p.body)


def rank(a: Coll, b: Coll) -> Column:
    """-1, 0 or 1; null where precisions or offsets don't decide."""

    def at_utc(p: Parts, fn: Callable[[Column], Column]) -> Column:
        if p.time or p.native and a.ty.dt != T.TimestampType():
            return fn(p.body)
        return fn(_shifted(p)) if p.const is not None else bind(_shifted(p), fn)

    def ranked(x: Parts, y: Parts, tx: Column, ty: Column) -> Column:
        n = F.least(F.length(tx), F.length(ty))
        left, right = F.substring(tx, F.lit(1), n), F.substring(ty, F.lit(1), n)
        odd = F.lit(False) if x.time else (n > 10) & ((x.zone == "") != (y.zone == ""))
        return F.when(odd, F.lit(None).cast("int")).when(left < right, -1).when(left > right, 1).when(F.length(tx) == F.length(ty), 0)

    rest = with_parts(a, lambda x: with_parts(b, lambda y: at_utc(x, lambda tx: at_utc(y, lambda ty: ranked(x, y, tx, ty)))))
    # of one length, no longer than milliseconds, and without offsets the texts decide
    left, right = temporal_text(a.col, a.ty), temporal_text(b.col, b.ty)
    alike = (F.length(left) == F.length(right)) & (F.length(left) <= (12 if a.ty.name == "Time" else 23)) & bare(a) & bare(b)
    return F.when(alike, F.when(left < right, -1).when(left > right, 1).otherwise(0)).otherwise(rest)


def native_bounds(text: str) -> tuple[str, str] | None:
    """First moment of a literal without offset, and the first after it."""
    body, zone = split_zone(text)
    if zone or ":" in body[:3]:
        return None
    import datetime as dt

    lo = body + _FULL[len(body) :]
    start = dt.datetime.fromisoformat(lo)
    step = {4: ("year", 1), 7: ("month", 1), 10: 86400, 13: 3600, 16: 60}.get(len(body), 0.001)
    if step == ("year", 1):
        end = start.replace(year=start.year + 1)
    elif step == ("month", 1):
        end = (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    else:
        end = start + dt.timedelta(seconds=step)
    return start.isoformat(sep=" "), end.isoformat(sep=" ")


def compare_native(op: str, a: Coll, literal: str) -> Column | None:
    """A native timestamp or date against a literal: plain comparisons, which
    reach the scan."""
    bounds = native_bounds(literal)
    if bounds is None or isinstance(a.ty.dt, T.TimestampType):
        return None
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in bounds)
    v = a.col
    exact = len(split_zone(literal)[0]) >= (10 if isinstance(a.ty.dt, T.DateType) else 23)
    if isinstance(a.ty.dt, T.DateType):
        lo, hi = lo.cast("date"), hi.cast("date")
        if len(split_zone(literal)[0]) > 10:
            return None
    if exact:
        return {"<": v < lo, "<=": v < hi, ">": v >= hi, ">=": v >= lo, "=": (v >= lo) & (v < hi)}[op]
    if op in ("<", "<="):
        return F.when(v < lo, True).when(v >= hi, False)
    if op in (">", ">="):
        return F.when(v >= hi, True).when(v < lo, False)
    return F.when((v < lo) | (v >= hi), False)


#: Units as (months, days, seconds) of one.
_STEP = {"year": (12, 0, 0), "month": (1, 0, 0), "week": (0, 7, 0), "day": (0, 1, 0), "hour": (0, 0, 3600), "minute": (0, 0, 60), "second": (0, 0, 1), "millisecond": (0, 0, 0.001)}


def add(c: Coll, amount: Column, unit: str) -> Column:
    """c plus an amount of a calendar unit, at c's own precision; months clamp to
    the month's last day, times wrap, a year outside 1 to 9999 is empty."""
    months, days, seconds = _STEP[unit]
    amount = amount.cast("double")
    whole = F.when(amount >= 0, F.floor(amount)).otherwise(F.ceil(amount)).cast("int")
    if c.ty.native and c.ty.name == "Date":
        if months:
            return F.add_months(c.col, whole * months)
        return F.date_add(c.col, (whole * days if days else F.when(amount >= 0, F.floor(amount * seconds / 86400)).otherwise(F.ceil(amount * seconds / 86400)).cast("int")))
    if c.ty.native:
        if months:
            return c.col + F.make_ym_interval(F.lit(0), whole * months)
        if days:
            return c.col + F.make_dt_interval(whole * days)
        return c.col + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (amount if seconds <= 1 else whole) * seconds)
    if isinstance(c.const, str):
        return with_parts(c, lambda p: _added(p, amount, whole, unit))
    return with_parts(c, lambda p: bind(p.body, lambda b: _added(replace(p, body=b), amount, whole, unit)))


def _added(p: Parts, amount: Column, whole: Column, unit: str) -> Column:
    months, days, seconds = _STEP[unit]
    if p.time:
        full = F.concat(p.body, F.substring(F.lit("00:00:00.000"), F.length(p.body) + 1, F.lit(12)))
        secs = F.substring(full, 1, 2).cast("int") * 3600 + F.substring(full, 4, 2).cast("int") * 60 + F.substring(full, 7, 6).cast("decimal(9,3)")
        step = F.round(amount * (seconds or days * 86400) * 1000).cast("bigint")
        ms = F.pmod((secs * 1000).cast("bigint") + step, F.lit(86_400_000))
        out = lambda ms: F.concat(
            F.lpad((F.floor(ms / 3_600_000)).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 60_000) % 60).cast("string"), 2, "0"), F.lit(":"),
            F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"),
        )
        return F.substring(bind(ms, out), F.lit(1), F.length(p.text))
    full = F.concat(p.body, F.substring(F.lit(_FULL), F.length(p.body) + 1, F.lit(23)))
    start = F.try_to_timestamp(full, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")).cast("timestamp_ntz")
    n = F.length(p.body)
    cut = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")
    if months:
        to = start + F.make_ym_interval(F.lit(0), F.when(n == 4, cut(whole * months / 12) * 12).otherwise(whole * months))
    else:
        in_days = amount * (days or seconds / 86400)
        fine = F.make_dt_interval(whole * days) if days else F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (amount if seconds <= 1 else whole) * seconds)
        to = (
            F.when(n == 4, start + F.make_ym_interval(cut(in_days / 365)))
            .when(n == 7, start + F.make_ym_interval(F.lit(0), cut(in_days / 30)))
            .when(n == 10, start + F.make_dt_interval(cut(in_days)))
            .otherwise(start + fine)
        )
    keep = F.when(n == 23, F.length(F.regexp_replace(p.text, _ZONE, ""))).otherwise(n)
    text = lambda to: F.concat(F.substring(F.date_format(to, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(1), keep), p.zone)
    return bind(to, lambda to: F.when((F.year(to) >= 1) & (F.year(to) <= 9999), text(to)))


def now_parts(ty: Ty, moment: str) -> str:
    return {"DateTime": moment, "Date": moment[:10], "Time": moment[11:23]}[ty.name]
