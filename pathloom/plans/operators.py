"""Binary and unary operators on collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.lang.errors import PathTypeError
from pathloom.plans import coll as c
from pathloom.plans.coll import Coll, Ty
from pathloom.values import temporal, units



def null(dt: str = "boolean") -> Column:
    return F.lit(None).cast(dt)


def quantity(x: Coll) -> Coll:
    """Numbers and quantity-like structs as Quantity."""
    if x.ty.name == "Quantity":
        return x
    if x.ty.name in c.NUMERIC:
        return c.mapped(x, lambda v: F.when(v.isNotNull(), F.struct(v.cast(c.DEC).alias("value"), F.lit("1").alias("unit"))), c.QTY).with_(
            const=(x.const, "1") if x.const is not None else None
        )
    if is_quantity(x.ty):
        names = x.ty.dt.names

        def build(v: Column) -> Column:
            unit = F.coalesce(*[v[k] for k in ("code", "unit") if k in names], F.lit("1"))
            table = F.create_map(*[y for k, u in units.FROM_CODE.items() for y in (F.lit(k), F.lit(u))])
            unit = F.coalesce(F.try_element_at(table, unit), unit)
            return F.when(v["value"].isNotNull(), F.struct(v["value"].cast(c.DEC).alias("value"), unit.alias("unit")))

        return c.mapped(x, build, c.QTY)
    raise PathTypeError(f"{x.ty.full} is no quantity")


def is_quantity(ty: Ty) -> bool:
    if ty.name == "Quantity":
        return True
    return ty.name == "Struct" and "value" in ty.dt.names and isinstance(ty.dt["value"].dataType, T.NumericType) and bool({"unit", "code"} & set(ty.dt.names))


def _measures(a: Coll, b: Coll) -> tuple[Column, Column, Column]:
    """Values at a common unit, and whether they can be compared."""
    (fa, da), (fb, db) = (units.factor_and_dimension(x.col["unit"], x.const[1] if x.const else None) for x in (a, b))
    va, vb = (x.col["value"].cast("double") * f for x, f in ((a, fa), (b, fb)))
    # what decimal arithmetic would keep equal stays equal
    snap = lambda v: F.round(v, 9)
    return snap(va), snap(vb), da == db


def equal_items(a: Column, b: Column, ta: Ty, tb: Ty, ca: object = None, cb: object = None) -> Column:
    """One item with one item; null where precisions or units don't decide."""
    if "Empty" in (ta.name, tb.name):
        return null()
    if ta.name in c.NUMERIC and tb.name in c.NUMERIC:
        return a == b
    if ta.name == tb.name and ta.name in ("String", "Boolean"):
        return a == b
    if {ta.name, tb.name} <= {"Date", "DateTime"} or ta.name == tb.name == "Time":
        x, y = Coll(a, ta, True, const=ca), Coll(b, tb, True, const=cb)
        for p, q in ((x, y), (y, x)):
            if p.ty.native and isinstance(q.const, str):
                quick = temporal.compare_native("=", p, q.const)
                if quick is not None:
                    return quick
        if ta.native and ta.dt == tb.dt:
            return a == b
        return temporal.rank(x, y) == 0
    if "Quantity" in (ta.name, tb.name) or is_quantity(ta) and is_quantity(tb):
        if not (is_quantity(ta) or ta.name in c.NUMERIC) or not (is_quantity(tb) or tb.name in c.NUMERIC):
            return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
        x, y = quantity(Coll(a, ta, True, const=ca)), quantity(Coll(b, tb, True, const=cb))
        va, vb, same = _measures(x, y)
        return F.when(same, va == vb)
    if "Mixed" in (ta.name, tb.name):
        x, y = c.tagged(a, ta), c.tagged(b, tb)
        return x == y
    if "Variant" in (ta.name, tb.name):
        return variant_text(a, ta) == variant_text(b, tb)
    if ta.name == tb.name == "Struct" and ta.dt == tb.dt:
        x, y = without_ids(a, ta.dt), without_ids(b, tb.dt)
        return F.when(a.isNotNull() & b.isNotNull(), x.eqNullSafe(y))
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))


def without_ids(x: Column, dt: T.StructType) -> Column:
    names = [n for n in dt.names if n != "id" and not n.startswith("_")]
    return x if len(names) == len(dt.names) or not names else F.struct(*[x[n].alias(n) for n in names])


def variant_text(v: Column, ty: Ty) -> Column:
    return F.try_variant_get(v, "$", "string") if ty.name == "Variant" else c.to_text(v, ty)


def equal(a: Coll, b: Coll) -> Column:
    if "Empty" in (a.ty.name, b.ty.name):
        return null()
    if a.single and b.single:
        return equal_items(a.col, b.col, a.ty, b.ty, a.const, b.const)
    x, y = c.many(a), c.many(b)
    pairs = F.zip_with(x, y, lambda p, q: equal_items(p, q, a.ty, b.ty, a.const, b.const))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), null()).when(F.size(x) != F.size(y), False).otherwise(F.forall(pairs, lambda p: p))


def equivalent_items(a: Column, b: Column, ta: Ty, tb: Ty, sa: int | None = None, sb: int | None = None) -> Column:
    if ta.name == tb.name == "String":
        norm = lambda v: F.regexp_replace(F.lower(v), r"\s", " ")
        return norm(a) == norm(b)
    if ta.name in c.NUMERIC and tb.name in c.NUMERIC:
        scales = [s if s is not None else 0 if t.name != "Decimal" else t.dt.scale if isinstance(t.dt, T.DecimalType) and t.dt.scale <= 9 else None for s, t in ((sa, ta), (sb, tb))]
        if None in scales:
            return F.round(a.cast("double"), 8) == F.round(b.cast("double"), 8)
        return F.round(a.cast(c.DEC), min(scales)) == F.round(b.cast(c.DEC), min(scales))
    if ta.name == tb.name == "Struct" and ta.dt == tb.dt:
        names = ta.dt.names
        if "code" in names and "system" in names:
            return a["code"].eqNullSafe(b["code"]) & a["system"].eqNullSafe(b["system"])
        if "coding" in names and isinstance(ta.dt["coding"].dataType, T.ArrayType):
            pick = lambda v: F.transform(F.coalesce(v["coding"], F.array().cast(ta.dt["coding"].dataType)), lambda q: F.struct(q["system"], q["code"]))
            return F.arrays_overlap(pick(a), pick(b))
    return F.coalesce(equal_items(a, b, ta, tb), F.lit(False))


def equivalent(a: Coll, b: Coll) -> Column:
    """Order doesn't matter; each item needs its own partner."""
    if a.ty.name == "Empty" or b.ty.name == "Empty":
        return c.size(a) == c.size(b)
    if a.single and b.single:
        return F.when(a.col.isNull() | b.col.isNull(), a.col.isNull() & b.col.isNull()).otherwise(
            F.coalesce(equivalent_items(a.col, b.col, a.ty, b.ty, a.scale, b.scale), F.lit(False))
        )
    x, y = c.many(a), c.many(b)
    same = lambda p, tp, q, tq: F.coalesce(equivalent_items(p, q, tp, tq), F.lit(False))
    count = lambda arr, ty, p, tp: F.size(F.filter(arr, lambda q: same(p, tp, q, ty)))
    return (F.size(x) == F.size(y)) & F.forall(x, lambda p: count(x, a.ty, p, a.ty) == count(y, b.ty, p, a.ty))


def ordering(op: str, a: Coll, b: Coll) -> Column:
    if "Empty" in (a.ty.name, b.ty.name):
        return null()
    a, b = c.as_one(a, f"the left side of {op}"), c.as_one(b, f"the right side of {op}")
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if a.ty.name in c.NUMERIC and b.ty.name in c.NUMERIC or a.ty.name == b.ty.name == "String":
        return test(a.col, b.col)
    if {a.ty.name, b.ty.name} <= {"Date", "DateTime"} or a.ty.name == b.ty.name == "Time":
        flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
        for o, p, q in ((op, a, b), (flip, b, a)):
            if p.ty.native and isinstance(q.const, str):
                quick = temporal.compare_native(o, p, q.const)
                if quick is not None:
                    return quick
        if a.ty.native and a.ty.dt == b.ty.dt:
            return test(a.col, b.col)
        return test(temporal.rank(a, b), F.lit(0))
    if (is_quantity(a.ty) or a.ty.name in c.NUMERIC) and (is_quantity(b.ty) or b.ty.name in c.NUMERIC):
        va, vb, same = _measures(quantity(a), quantity(b))
        return F.when(same, test(va, vb))
    if "Variant" in (a.ty.name, b.ty.name):
        number = b if a.ty.name == "Variant" else a
        kind = "double" if number.ty.name in c.NUMERIC else "string"
        x, y = (F.try_variant_get(z.col, "$", kind) if z.ty.name == "Variant" else z.col for z in (a, b))
        return test(x, y)
    raise PathTypeError(f"{op} can't compare {a.ty.name} with {b.ty.name}")


def _floor0(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def arithmetic(op: str, a: Coll, b: Coll) -> Coll:
    what = f"an operand of {op}"
    if "Empty" in (a.ty.name, b.ty.name):
        return c.nothing(b.ty if a.ty.name == "Empty" else a.ty)
    a, b = c.as_one(a, what), c.as_one(b, what)
    if op == "+" and a.ty.name == b.ty.name == "String":
        return c.scalar(F.concat(a.col, b.col), c.STRING)
    if a.ty.name in c.NUMERIC and b.ty.name in c.NUMERIC:
        return numbers(op, a, b)
    if op in "+-" and a.ty.name in c.TEMPORAL and is_quantity(b.ty):
        return shift(a, quantity(b), 1 if op == "+" else -1)
    if op == "+" and b.ty.name in c.TEMPORAL and is_quantity(a.ty):
        return shift(b, quantity(a), 1)
    if (is_quantity(a.ty) or a.ty.name in c.NUMERIC) and (is_quantity(b.ty) or b.ty.name in c.NUMERIC) and op in "+-*/":
        return quantities(op, quantity(a), quantity(b))
    raise PathTypeError(f"{op} can't take {a.ty.name} and {b.ty.name}")


def numbers(op: str, a: Coll, b: Coll) -> Coll:
    ty = c.wider(a.ty, b.ty)
    floating = isinstance(ty.dt, T.DoubleType)
    x, y = a.col, b.col
    if floating:
        x, y = x.cast("double"), y.cast("double")
    if op == "/":
        if floating:
            return c.scalar(F.when(y != 0, x / y), c.DOUBLE)
        out, dt = divided(x, c.digits(a.ty, a.const), y, c.digits(b.ty, b.const))
        return c.scalar(out, Ty("Decimal", dt))
    if op == "div":
        out = F.when(y != 0, _floor0(x / y)) if floating else F.when(y != 0, F.try_divide(x - F.try_mod(x, y), y))
        return c.scalar(F.round(out, 0).cast("bigint"), c.INTEGER if ty.name != "Long" else c.LONG)
    if op == "mod":
        return c.scalar(F.when(y != 0, x % y) if floating else F.try_mod(x, y).cast(ty.dt), ty)
    if ty.name in ("Integer", "Long"):
        x, y = x.cast("bigint"), y.cast("bigint")
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        if a.const is not None and b.const is not None:
            import operator

            v = {"+": operator.add, "-": operator.sub, "*": operator.mul}[op](int(a.const), int(b.const))
            if abs(v) >= 2**63:
                return c.scalar(F.lit(str(v)).cast("decimal(38,0)"), Ty("Decimal", T.DecimalType(38, 0)), scale=0)
            return c.scalar(F.lit(v).cast("bigint"), c.LONG if abs(v) >= 2**31 or ty.name == "Long" else c.INTEGER, const=v, scale=0)
        return c.scalar(out, ty)
    if floating:
        return c.scalar({"+": x + y, "-": x - y, "*": x * y}[op], c.DOUBLE)
    scale = None
    if a.scale is not None and b.scale is not None:
        scale = a.scale + b.scale if op == "*" else max(a.scale, b.scale)
    da, db = c.digits(a.ty, a.const), c.digits(b.ty, b.const)
    out, dt = multiplied(x, da, y, db) if op == "*" else added(op, x, da, y, db)
    return c.scalar(out, Ty("Decimal", dt), scale=scale if scale is None or scale <= dt.scale else None)


def added(op: str, x: Column, dx: tuple[int, int], y: Column, dy: tuple[int, int]) -> tuple[Column, T.DecimalType]:
    """Exact, null where 38 digits don't hold it. dx, dy: digits and places."""
    scale = max(dx[1], dy[1])
    whole = min(max(dx[0] - dx[1], dy[0] - dy[1]), 37 - scale)
    x, y = (z.try_cast(T.DecimalType(whole + scale, scale)) for z in (x, y))
    dt = T.DecimalType(whole + scale + 1, scale)
    return (F.try_add if op == "+" else F.try_subtract)(x, y).cast(dt), dt


def multiplied(x: Column, dx: tuple[int, int], y: Column, dy: tuple[int, int]) -> tuple[Column, T.DecimalType]:
    """Exact where the types leave room; else exact for operands of 18 digits with 9
    places, and with 6 places for others that 38 digits hold."""
    if dx[0] + dy[0] < 38:
        dt = T.DecimalType(dx[0] + dy[0] + 1, dx[1] + dy[1])
        return F.try_multiply(x.cast(T.DecimalType(*dx)), y.cast(T.DecimalType(*dy))).cast(dt), dt
    dt = T.DecimalType(38, min(dx[1] + dy[1], 18))
    u, v = (z.try_cast(T.DecimalType(18, min(d[1], 9))) for z, d in ((x, dx), (y, dy)))
    wide = F.try_multiply(x.cast(T.DecimalType(*dx)), y.cast(T.DecimalType(*dy))).try_cast(dt)
    return F.when((u == x) & (v == y), F.try_multiply(u, v).cast(dt)).otherwise(wide), dt


#: Places of a quotient, where 38 digits hold them.
PLACES = 24


def divided(x: Column, dx: tuple[int, int], y: Column, dy: tuple[int, int]) -> tuple[Column, T.DecimalType]:
    """Rounded to PLACES, or as many as the types leave room for; where that are few,
    to 16 for operands of 12 whole digits and 8 or 6 places. Null for 0."""

    def exact(x, dx, y, dy):
        whole = dx[0] - dx[1] + dy[1]
        places = max(6, min(PLACES, 38 - whole))
        # the more places the dividend has, the more Spark gives the quotient
        scale = max(dx[1], min(places, 38 - (dx[0] - dx[1])))
        return F.try_divide(x.cast(T.DecimalType(dx[0] - dx[1] + scale, scale)), y.cast(T.DecimalType(*dy))), min(38, whole + places), places

    if dx[0] - dx[1] + dy[1] <= 38 - 16:
        out, p, s = exact(x, dx, y, dy)
        return out.cast(T.DecimalType(p, s)), T.DecimalType(p, s)
    dt = T.DecimalType(38, 16)
    u, v = x.try_cast(T.DecimalType(20, 8)), y.try_cast(T.DecimalType(18, 6))
    narrow, wide = exact(u, (20, 8), v, (18, 6))[0], F.try_divide(x.cast(T.DecimalType(*dx)), y.cast(T.DecimalType(*dy)))
    return F.when((u == x) & (v == y), narrow.try_cast(dt)).otherwise(wide.try_cast(dt)), dt


def shift(a: Coll, q: Coll, sign: int) -> Coll:
    """A date or time plus a quantity of a calendar unit."""
    if q.const is None:
        by = lambda v, w, u: temporal.add(a.with_(col=v), F.when(w["unit"] == u, w["value"]) * sign, u)
        return c.scalar(c.bind(a.col, lambda v: c.bind(q.col, lambda w: F.coalesce(*[by(v, w, u) for u in units.CALENDAR]))), a.ty)
    amount, unit = q.const
    if unit in ("a", "mo"):
        raise PathTypeError(f"dates take calendar units, not '{unit}'")
    unit = {v: k for k, v in units.DEFINITE.items()}.get(unit, unit)
    if unit not in units.CALENDAR:
        raise PathTypeError(f"'{unit}' is no unit of time")
    return c.scalar(temporal.add(a, F.lit(float(amount)) * sign, unit), a.ty)


def quantities(op: str, a: Coll, b: Coll) -> Coll:
    (fa, da), (fb, db) = (units.factor_and_dimension(x.col["unit"], x.const[1] if x.const else None) for x in (a, b))
    va, vb, ua, ub = a.col["value"], b.col["value"], a.col["unit"], b.col["unit"]
    make = lambda v, u: F.struct(v.cast(c.DEC).alias("value"), u.alias("unit"))
    present = a.col.isNotNull() & b.col.isNotNull()
    if op in "+-":
        small = fa <= fb
        ratio = lambda v, f, g: F.when(f == g, v.cast("double")).otherwise(F.round(v.cast("double") * f / g, 12))
        x = F.when(small, va.cast("double")).otherwise(ratio(va, fa, fb))
        y = F.when(small, ratio(vb, fb, fa)).otherwise(vb.cast("double"))
        out = F.when(ua == ub, make(va + vb if op == "+" else va - vb, ua)).when(
            present & (da == db), make(F.round(x + y if op == "+" else x - y, 12), F.when(small, ua).otherwise(ub))
        )
        return c.scalar(out, c.QTY)
    one = F.lit("1")
    if op == "*":
        unit = F.when(ua == one, ub).when(ub == one, ua).otherwise(F.concat(ua, F.lit("."), ub))
        both = ua.isin(*units.CALENDAR) & ub.isin(*units.CALENDAR)
        return c.scalar(F.when(present & ~both, make(multiplied(va, (38, 12), vb, (38, 12))[0].try_cast(c.DEC), unit)), c.QTY)
    same = (da == db) & (ua.isin(*units.CALENDAR) | ub.isin(*units.CALENDAR) | (ua == ub))
    value = F.when(same, F.round(va.cast("double") * fa / (vb.cast("double") * fb), 12)).otherwise(va.cast("double") / vb.cast("double"))
    unit = F.when(same, one).when(ub == one, ua).otherwise(F.concat(ua, F.lit("/"), ub))
    return c.scalar(F.when(present & (vb != 0), make(value, unit)), c.QTY)


def unary(op: str, a: Coll) -> Coll:
    if a.ty.name == "Empty":
        return a
    a = c.as_one(a, f"unary {op}")
    if a.ty.name in c.NUMERIC:
        return a if op == "+" else a.with_(col=-a.col, const=None if a.const is None else -a.const)
    if a.ty.name == "Quantity":
        if op == "+":
            return a
        neg = F.when(a.col.isNotNull(), F.struct((-a.col["value"]).alias("value"), a.col["unit"].alias("unit")))
        return a.with_(col=neg, const=None if a.const is None else (-a.const[0], a.const[1]))
    raise PathTypeError(f"unary {op} can't take {a.ty.name}")


def simple(ty: Ty) -> bool:
    """Items whose equality is Spark's own."""
    return ty.name in ("String", "Boolean", "Integer", "Long", "Decimal", "Mixed") or ty.native or ty.name == "Struct" and "id" not in ty.dt.names and not any(n[0] == "_" for n in ty.dt.names)


def distinct(x: Coll) -> Coll:
    if x.single:
        return x
    if simple(x.ty):
        return x.with_(col=F.array_distinct(x.col))
    kept = F.filter(x.col, lambda v, i: ~F.exists(F.slice(x.col, F.lit(1), i), lambda w: F.coalesce(equal_items(w, v, x.ty, x.ty), F.lit(False))))
    return x.with_(col=kept)


def union(a: Coll, b: Coll) -> Coll:
    a, b = c.common(a, b)
    if simple(a.ty):
        return c.array(F.array_union(c.many(a), c.many(b)), a.ty, ordered=False)
    return distinct(c.array(F.concat(c.many(a), c.many(b)), a.ty, ordered=False))


def has(arr: Coll, v: Column, tv: Ty, const: object = None) -> Column:
    """Whether an array holds an item."""
    if arr.ty.name == "Empty":
        return F.lit(False)
    if simple(arr.ty) and arr.ty.name == tv.name and arr.ty.dt == tv.dt:
        return F.coalesce(F.array_contains(c.many(arr), v), F.lit(False))
    return F.exists(c.many(arr), lambda w: F.coalesce(equal_items(w, v, arr.ty, tv, None, const), F.lit(False)))


def member(item: Coll, of: Coll) -> Coll:
    if item.ty.name == "Empty":
        return c.nothing(c.BOOLEAN)
    v = c.as_one(item, "the item")
    if of.single:
        inside = F.coalesce(equal_items(of.col, v.col, of.ty, v.ty, of.const, v.const), F.lit(False))
    else:
        inside = has(of, v.col, v.ty, v.const)
    return c.scalar(F.when(v.col.isNotNull(), inside), c.BOOLEAN)


def text_of(x: Coll, op: str) -> Column:
    return F.coalesce(c.want(x, "String", f"an operand of {op}").col, F.lit(""))


def binary(op: str, a: Coll, b: Coll) -> Coll:
    from pathloom.plans.compiler import Compiler

    a, b = (Compiler.settle(None, x) if x.choices else x for x in (a, b))
    if op in ("and", "or", "xor", "implies"):
        x, y = c.boolean(a, f"an operand of {op}"), c.boolean(b, f"an operand of {op}")
        out = {"and": lambda: x & y, "or": lambda: x | y, "xor": lambda: x != y, "implies": lambda: ~x | y}[op]()
        return c.scalar(out, c.BOOLEAN)
    if op in ("=", "!="):
        e = equal(a, b)
        return c.scalar(e if op == "=" else ~e, c.BOOLEAN)
    if op in ("~", "!~"):
        e = equivalent(a, b)
        return c.scalar(e if op == "~" else ~e, c.BOOLEAN)
    if op in ("<", "<=", ">", ">="):
        return c.scalar(ordering(op, a, b), c.BOOLEAN)
    if op == "&":
        return c.scalar(F.concat(text_of(a, op), text_of(b, op)), c.STRING)
    if op == "|":
        return union(a, b)
    if op == "in":
        return member(a, b)
    if op == "contains":
        return member(b, a)
    return arithmetic(op, a, b)
