"""Existence, filtering, subsetting, combining, aggregates, sorting, control."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import function
from pathloom.lang import tree as t
from pathloom.lang.errors import RUNTIME, PathTypeError
from pathloom.plans import coll as c
from pathloom.plans import operators as o
from pathloom.plans.coll import Coll


def _bool(col: Column) -> Coll:
    return c.scalar(col, c.BOOLEAN)


def _criterion(k, x: Coll, node, scope):
    return k.each(x, scope, lambda item, s: c.holds(k.settle(k.walk(node, item, s))))


@function("where", 1)
def where(k, x, args, scope):
    if x.ty.name == "Empty":
        return x
    if x.single:
        item = k.body(args[0], x, scope, index=c.scalar(F.lit(0).cast("bigint"), c.INTEGER))
        return x.with_(col=F.when(x.col.isNotNull() & c.holds(item), x.col), const=None)
    return x.with_(col=F.filter(x.col, _criterion(k, x, args[0], scope)))


@function("select", 1)
def select(k, x, args, scope):
    if x.ty.name == "Empty":
        return x
    if x.single:
        out = k.body(args[0], x, scope, index=c.scalar(F.lit(0).cast("bigint"), c.INTEGER))
        if out.single:
            return out.with_(col=F.when(x.col.isNotNull(), out.col), const=None)
        return out.with_(col=F.when(x.col.isNotNull(), out.col).otherwise(F.array().cast(T.ArrayType(out.ty.dt))))
    kind: list[Coll] = []

    def run(item, s):
        out = k.settle(k.walk(args[0], item, s))
        kind.append(out)
        return out.col

    each = F.transform(x.col, k.each(x, scope, run))
    out = kind[0]
    if out.ty.name == "Empty":
        return out
    return c.array(F.array_compact(each) if out.single else F.flatten(each), out.ty, ordered=x.ordered)


#: Rounds of repeat() over values that are not structs; an error if they don't suffice.
ROUNDS = 1000


def _fixpoint(k, x: Coll, args, scope) -> Coll:
    """x and all that the projection, which keeps its type, yields from it."""
    if not o.simple(x.ty):
        raise PathTypeError(f"repeat() over {x.ty.name} is not supported")
    kind = T.ArrayType(x.ty.dt)
    shape = T.StructType([T.StructField("all", kind), T.StructField("new", kind)])

    def merge(acc, _):
        step = c.many(select(k, c.array(acc["new"], x.ty, ordered=False), args, scope)).cast(kind)
        new = F.array_except(step, acc["all"])
        return F.when(F.size(acc["new"]) == 0, acc).otherwise(F.struct(F.concat(acc["all"], new).alias("all"), new.alias("new")).cast(shape))

    start = F.array_distinct(c.many(x)).cast(kind)
    late = F.raise_error(F.lit(f"{RUNTIME}repeat() finds new items after {ROUNDS} rounds")).cast(kind)
    col = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(start.alias("all"), start.alias("new")).cast(shape), merge, lambda a: F.when(F.size(a["new"]) == 0, a["all"]).otherwise(late)
    )
    return c.array(col, x.ty, ordered=False)


def _merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds what either holds, with all fields of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        both = [T.StructField(f.name, _merged(f.dataType, b[f.name].dataType) if f.name in b.names else f.dataType) for f in a.fields]
        return T.StructType(both + [T.StructField(f.name, f.dataType) for f in b.fields if f.name not in a.names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merged(a.elementType, b.elementType))
    if isinstance(a, T.NullType):
        return b
    raise PathTypeError(f"repeat() finds {a.simpleString()} and {b.simpleString()} under one name")


def _padded(v: Column, have: T.DataType, want: T.DataType) -> Column:
    """v with nulls for the fields that it lacks."""
    if have == want:
        return v
    if isinstance(want, T.StructType):
        fields = [(_padded(v[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(v.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(v, lambda x: _padded(x, have.elementType, want.elementType))
    return v.cast(want)


@function("repeat", 1)
def repeat(k, x, args, scope):
    """Rounds of the projection, as deep as the schema goes; values that are not
    structs go round until no new one comes."""
    found: list[Coll] = []
    at = x
    for _ in range(64):
        at = select(k, at, args, scope)
        if at.ty.name == "Empty" or at.ty.name == "Struct" and not at.ty.dt.names:
            break
        found.append(at)
        if isinstance(args[0], t.Name) and at.ty.name == "Struct" and args[0].name not in at.ty.dt.names:
            break
        if at.ty.name != "Struct" and len(found) > 1 and at.ty == found[-2].ty:
            found[-2:] = [_fixpoint(k, found[-2], args, scope)]
            break
    else:
        raise PathTypeError("the types of repeat() do not settle")
    if not found:
        return c.nothing()
    if found[0].ty.name == "Struct" and len({f.ty.dt.json() for f in found}) > 1:
        # a recursive type ends a level earlier at each depth
        whole = found[0].ty.dt
        for f in found[1:]:
            whole = _merged(whole, f.ty.dt)
        pad = lambda dt: lambda v: _padded(v, dt, whole)
        found = [c.mapped(f, pad(f.ty.dt), c.Ty("Struct", whole, f.ty.model)) for f in found]
    out = found[0].with_(ordered=False)
    for f in found[1:]:
        a, b = c.common(out, f)
        out = c.array(F.concat(c.many(a), c.many(b)), a.ty, ordered=False)
    return o.distinct(out)


@function("coalesce", 0, 99)
def coalesce(k, x, args, scope):
    found = [v for v in (k.arg(a, scope) for a in args) if v.ty.name != "Empty"]
    if not found:
        return c.nothing()
    out = found[-1]
    for v in reversed(found[:-1]):
        v, out = c.common(v, out)
        if v.single and out.single:
            out = c.scalar(F.coalesce(v.col, out.col), v.ty)
        else:
            out = c.array(F.when(c.size(v) > 0, c.many(v)).otherwise(c.many(out)), v.ty)
    return out


def _type_name(node: t.Node) -> str:
    if isinstance(node, t.Name):
        return node.name
    if isinstance(node, t.Dot) and isinstance(node.right, t.Name):
        return f"{_type_name(node.left)}.{node.right.name}"
    raise PathTypeError("expected the name of a type")


@function("ofType", 1)
def of_type(k, x, args, scope):
    return k.of_type(x, _type_name(args[0]))


@function("as", 1)
def as_(k, x, args, scope):
    return k.of_type(c.as_one(x, "as()"), _type_name(args[0]))


@function("is", 1)
def is_(k, x, args, scope):
    return k.is_type(c.as_one(x, "is()"), _type_name(args[0]))


@function("empty")
def empty(k, x, args, scope):
    return _bool(c.size(x) == 0 if not x.single else x.col.isNull())


@function("exists", 0, 1)
def exists(k, x, args, scope):
    if x.ty.name == "Empty":
        return _bool(F.lit(False))
    if args:
        if not x.single:
            return _bool(F.exists(x.col, lambda v: _criterion(k, x, args[0], scope)(v, F.lit(0))) if not _uses_index(args[0]) else F.size(where(k, x, args, scope).col) > 0)
        x = where(k, x, args, scope)
    return _bool(x.col.isNotNull() if x.single else F.size(x.col) > 0)


def _uses_index(n) -> bool:
    if isinstance(n, t.Special):
        return n.name == "index"
    return any(_uses_index(v) for f in getattr(n, "__dataclass_fields__", {}) for v in ([*getattr(n, f)] if isinstance(getattr(n, f), tuple) else [getattr(n, f)]) if isinstance(v, t.Node))


@function("all", 1)
def all_(k, x, args, scope):
    if x.ty.name == "Empty":
        return _bool(F.lit(True))
    if x.single:
        return _bool(x.col.isNull() | c.holds(k.body(args[0], x, scope, index=c.scalar(F.lit(0).cast("bigint"), c.INTEGER))))
    if _uses_index(args[0]):
        return _bool(F.size(F.filter(x.col, _criterion(k, x, args[0], scope))) == F.size(x.col))
    return _bool(F.forall(x.col, lambda v: _criterion(k, x, args[0], scope)(v, F.lit(0))))


def _fold(name, each, default):
    @function(name)
    def run(k, x, args, scope):
        if x.ty.name == "Empty":
            return _bool(F.lit(default))
        if x.ty.name != "Boolean":
            raise PathTypeError(f"{name} takes Boolean, not {x.ty.name}")
        return _bool(each(c.many(x)))


_fold("allTrue", lambda a: F.forall(a, lambda v: v), True)
_fold("anyTrue", lambda a: F.exists(a, lambda v: v), False)
_fold("allFalse", lambda a: F.forall(a, lambda v: ~v), True)
_fold("anyFalse", lambda a: F.exists(a, lambda v: ~v), False)


@function("count")
def count(k, x, args, scope):
    return c.scalar(c.size(x).cast("bigint"), c.INTEGER)


@function("distinct")
def distinct(k, x, args, scope):
    return o.distinct(x)


@function("isDistinct")
def is_distinct(k, x, args, scope):
    return _bool(F.lit(True) if x.single else F.size(o.distinct(x).col) == F.size(x.col))


def _subset(a: Coll, b: Coll) -> Coll:
    if a.ty.name == "Empty":
        return _bool(F.lit(True))
    return _bool(F.forall(c.many(a), lambda v: o.has(b, v, a.ty)))


@function("subsetOf", 1)
def subset_of(k, x, args, scope):
    return _subset(x, k.arg(args[0], scope))


@function("supersetOf", 1)
def superset_of(k, x, args, scope):
    return _subset(k.arg(args[0], scope), x)


@function("not")
def not_(k, x, args, scope):
    return _bool(~c.boolean(x, "not()"))


@function("iif", 2, 3)
def iif(k, x, args, scope):
    focus = c.as_one(x, "iif()") if x.ty.name != "Empty" else x
    inner = scope.frame(focus)
    test = c.holds(k.settle(k.walk(args[0], focus, inner)))
    yes = k.settle(k.walk(args[1], focus, scope.frame(focus)))
    no = k.settle(k.walk(args[2], focus, scope.frame(focus))) if len(args) > 2 else c.nothing(yes.ty)
    yes, no = c.common(yes, no)
    if yes.single and no.single:
        return c.scalar(F.when(test, yes.col).otherwise(no.col), yes.ty)
    return c.array(F.when(test, c.many(yes)).otherwise(c.many(no)), yes.ty)


@function("single")
def single(k, x, args, scope):
    return c.as_one(x, "single()")


@function("first")
def first(k, x, args, scope):
    return c.first(x)


@function("last")
def last(k, x, args, scope):
    return x if x.single else x.with_(col=F.try_element_at(x.col, F.lit(-1)), single=True)


def _count_arg(k, node, scope, name) -> Column:
    n = c.want(k.arg(node, scope), "Integer", f"the argument of {name}()")
    if n.ty.name == "Empty":
        raise PathTypeError(f"{name}() needs a number")
    return F.greatest(n.col.cast("int"), F.lit(0))


def _slice(x: Coll, start: Column, length: Column | None) -> Coll:
    rest = F.greatest(F.size(x.col) - start, F.lit(0))
    return x.with_(col=F.slice(x.col, start + 1, rest if length is None else F.least(rest, length)))


@function("tail")
def tail(k, x, args, scope):
    return c.nothing(x.ty) if x.single else _slice(x, F.lit(1), None)


@function("skip", 1)
def skip(k, x, args, scope):
    n = _count_arg(k, args[0], scope, "skip")
    return x.with_(col=F.when(n <= 0, x.col), const=None) if x.single else _slice(x, n, None)


@function("take", 1)
def take(k, x, args, scope):
    n = _count_arg(k, args[0], scope, "take")
    return x.with_(col=F.when(n > 0, x.col), const=None) if x.single else _slice(x, F.lit(0), n)


@function("intersect", 1)
def intersect(k, x, args, scope):
    other = k.arg(args[0], scope)
    if x.ty.name == "Empty" or other.ty.name == "Empty":
        return c.nothing(x.ty)
    x, other = c.common(x, other)
    if o.simple(x.ty):
        return c.array(F.array_intersect(c.many(x), c.many(other)), x.ty, ordered=False)
    return o.distinct(c.array(F.filter(c.many(x), lambda v: o.has(other, v, x.ty)), x.ty, ordered=False))


@function("exclude", 1)
def exclude(k, x, args, scope):
    other = k.arg(args[0], scope)
    if x.ty.name == "Empty":
        return x
    if x.single:
        return x.with_(col=F.when(~o.has(other, x.col, x.ty), x.col), const=None)
    return x.with_(col=F.filter(x.col, lambda v: ~o.has(other, v, x.ty)))


@function("union", 1)
def union(k, x, args, scope):
    return o.union(x, k.arg(args[0], scope))


@function("combine", 1)
def combine(k, x, args, scope):
    a, b = c.common(x, k.arg(args[0], scope))
    return c.array(F.concat(c.many(a), c.many(b)), a.ty, ordered=False)


@function("aggregate", 1, 2)
def aggregate(k, x, args, scope):
    init = k.arg(args[1], scope) if len(args) > 1 else None
    if x.ty.name == "Empty":
        return init or c.nothing()
    item = x.with_(single=True, const=None)
    # the accumulator's type: that of the body over the initial value, widened
    total = init if init is not None else c.nothing(x.ty)
    for _ in range(2):
        probe = k.body(args[0], item.with_(col=F.lit(None).cast(x.ty.dt)), scope, total=total.with_(col=F.lit(None).cast(total.ty.dt), const=None, single=True), index=c.scalar(F.lit(0).cast("bigint"), c.INTEGER))
        ty = probe.ty if probe.ty.name != "Empty" else total.ty
        if ty.name in c.NUMERIC and total.ty.name in c.NUMERIC:
            ty = c.wider(ty, total.ty)
        total = total.with_(ty=ty, scale=None)
    start = (c.as_one(init).col if init is not None else F.lit(None)).cast(ty.dt)

    def merge(acc, v):
        i, sofar = acc["i"], c.scalar(acc["v"], ty)
        out = k.body(args[0], item.with_(col=v), scope, total=sofar, index=c.scalar(i, c.INTEGER))
        return F.struct(c.one(out).cast(ty.dt).alias("v"), (i + 1).alias("i"))

    zero = F.struct(start.alias("v"), F.lit(0).cast("bigint").alias("i"))
    shape = T.StructType([T.StructField("v", ty.dt), T.StructField("i", T.LongType())])
    return c.scalar(F.aggregate(c.many(x), zero.cast(shape), lambda a, v: merge(a, v).cast(shape), lambda a: a["v"]), ty)


def _numeric(x: Coll, name: str) -> Coll:
    if o.is_quantity(x.ty) and x.ty.name != "Quantity":
        return o.quantity(x)
    if x.ty.name not in (*c.NUMERIC, "Quantity", "Empty"):
        raise PathTypeError(f"{name}() takes numbers or quantities, not {x.ty.name}")
    return x


def _sum(x: Coll) -> Coll:
    if x.single:
        return x
    dt = x.ty.dt if not isinstance(x.ty.dt, (T.IntegerType, T.ShortType, T.ByteType)) else T.LongType()
    if isinstance(dt, T.DecimalType):
        # room for ten digits more, and for Spark to add without giving up a place
        dt = T.DecimalType(max(dt.precision, min(37, dt.precision + 10)), dt.scale)
    ty = c.Ty(x.ty.name, dt)
    if x.ty.name == "Quantity":
        # like repeated +: at the smaller unit, empty where two don't go together
        one = lambda v: c.scalar(v, c.QTY)
        rest = F.slice(x.col, F.lit(2), F.greatest(F.size(x.col) - 1, F.lit(0)))
        return one(F.aggregate(rest, F.get(x.col, F.lit(0)), lambda a, v: o.quantities("+", one(a), one(v)).col.cast(c.QUANTITY)))
    zero = F.lit(0).cast(dt)
    return c.scalar(F.when(F.size(x.col) > 0, F.aggregate(x.col, zero, lambda a, v: (a + v).cast(dt))), ty)


@function("sum")
def sum_(k, x, args, scope):
    return _sum(_numeric(x, "sum"))


@function("avg")
def avg(k, x, args, scope):
    x = _numeric(x, "avg")
    if x.single or x.ty.name == "Empty":
        return x
    total = _sum(x)
    n = F.size(x.col)
    if x.ty.name == "Quantity":
        mean = o.divided(total.col["value"], (38, 12), n, (10, 0))[0].cast(c.DEC)
        return c.scalar(F.when(total.col.isNotNull(), F.struct(mean.alias("value"), total.col["unit"].alias("unit"))), c.QTY)
    if isinstance(total.ty.dt, T.DoubleType):
        return c.scalar(total.col / F.when(n > 0, n), c.DOUBLE)
    p, s = c.digits(x.ty)
    # the sum of decimals that have room to spare has it still
    mean, dt = o.divided(total.col, (max(p, min(37, p + 10)) if s else p, s), n, (10, 0))
    return c.scalar(mean, c.Ty("Decimal", dt))


def _extreme(name, pick, sign):
    @function(name)
    def run(k, x, args, scope):
        x = _numeric(x, name)
        if x.single:
            return x
        if x.ty.name == "Quantity":
            better = "<" if sign < 0 else ">"
            keep = lambda a, v: F.when(a.isNull() | o.ordering(better, c.scalar(v, c.QTY), c.scalar(a, c.QTY)), v).otherwise(a)
            return c.scalar(F.aggregate(x.col, F.lit(None).cast(c.QUANTITY), keep), c.QTY)
        return c.scalar(pick(x.col), x.ty)


_extreme("min", F.array_min, -1)
_extreme("max", F.array_max, 1)


@function("sort", 0, 8)
def sort(k, x, args, scope):
    """Stable; a key under unary minus descends. Empty keys come last, first where descending."""
    if x.single:
        return x
    keys = [(a.of, True) if isinstance(a, t.Unary) and a.op == "-" else (a, False) for a in args] or [(None, False)]
    kinds: list = []

    def decorated(item, s):
        cols = []
        for i, (node, _) in enumerate(keys):
            v = c.as_one(k.settle(k.walk(node, item, s)) if node is not None else item, "a sort key")
            kinds.append(v)
            cols.append(v.col.alias(f"k{i}"))
        return F.struct(*cols, s.index.col.alias("i"), item.col.alias("v"))

    rows = F.transform(x.col, k.each(x, scope, decorated))
    kinds = kinds[: len(keys)]

    def before(a, b):
        out = F.when(a["i"] < b["i"], -1).otherwise(1)
        for i in reversed(range(len(keys))):
            p, q, down = a[f"k{i}"], b[f"k{i}"], keys[i][1]
            u, v = kinds[i].with_(col=p, const=None), kinds[i].with_(col=q, const=None)
            less, more = (F.coalesce(o.ordering(op, u, v), F.lit(False)) for op in ("<", ">"))
            lo, hi = (1, -1) if down else (-1, 1)
            out = (
                F.when(p.isNull() & q.isNotNull(), hi).when(p.isNotNull() & q.isNull(), lo)
                .when(less, lo).when(more, hi).otherwise(out)
            )
        return out

    if len(keys) == 1 and not keys[0][1] and o.simple(kinds[0].ty):
        ordered = F.array_sort(F.transform(rows, lambda r: F.struct(r["k0"].isNull().alias("n"), r["k0"].alias("k"), r["i"].alias("i"), r["v"].alias("v"))))
        if isinstance(x.ty.dt, (T.VariantType, T.MapType)):
            ordered = F.array_sort(rows, before)
    else:
        ordered = F.array_sort(rows, before)
    return x.with_(col=F.transform(ordered, lambda r: r["v"]))


@function("defineVariable", 1, 2)
def define_variable(k, x, args, scope):
    name = args[0].text if isinstance(args[0], t.Literal) and args[0].type == "String" else None
    if name is None:
        raise PathTypeError("defineVariable() needs a literal name")
    if name in scope.variables or name in k.env or name in ("context", "resource", "rootResource", "ucum", "sct", "loinc"):
        raise PathTypeError(f"%{name} is defined already")
    scope.variables[name] = k.body(args[1], x, scope) if len(args) > 1 else x
    return x


@function("trace", 1, 2)
def trace(k, x, args, scope):
    if k.trace:
        k.trace(args[0].text if isinstance(args[0], t.Literal) else "", k.body(args[1], x, scope) if len(args) > 1 else x)
    return x
