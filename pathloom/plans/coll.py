"""What a sub-expression compiles to: a Column with its static type and cardinality.

A collection of at most one item is a scalar Column, null when empty. Any other
is an array Column, never null and without null items. Types decide the rest at
compile time, so most expressions need no runtime dispatch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.lang.errors import RUNTIME, PathTypeError

NUMERIC = ("Integer", "Long", "Decimal")
TEMPORAL = ("Date", "DateTime", "Time")
DEC = T.DecimalType(38, 12)
QUANTITY = T.StructType([T.StructField("value", DEC), T.StructField("unit", T.StringType())])
MIXED = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
TYPE_INFO = T.StructType([T.StructField("namespace", T.StringType()), T.StructField("name", T.StringType())])


@dataclass(frozen=True)
class Ty:
    """name: Boolean String Integer Long Decimal Date DateTime Time Quantity Struct
    TypeInfo Mixed Variant Empty; model: the type's name in the model, if any;
    dt: the item's Spark type."""

    name: str
    dt: T.DataType
    model: str | None = None

    @property
    def native(self) -> bool:
        """A temporal held as a Spark date or timestamp, not as text."""
        return self.name in TEMPORAL and not isinstance(self.dt, T.StringType)

    @property
    def full(self) -> str:
        return self.model or f"System.{self.name}"


BOOLEAN, STRING = Ty("Boolean", T.BooleanType()), Ty("String", T.StringType())
INTEGER, LONG = Ty("Integer", T.LongType()), Ty("Long", T.LongType())
DOUBLE, DECIMAL = Ty("Decimal", T.DoubleType()), Ty("Decimal", DEC)
DATE, DATETIME, TIME = (Ty(n, T.StringType()) for n in TEMPORAL)
QTY, MIX, EMPTY = Ty("Quantity", QUANTITY), Ty("Mixed", MIXED), Ty("Empty", T.NullType())
INFO = Ty("TypeInfo", TYPE_INFO)


@dataclass(frozen=True)
class Coll:
    col: Column
    ty: Ty
    single: bool
    ordered: bool = True
    #: The value of a literal, None where it isn't known while compiling.
    const: object = None
    #: Typed alternatives of a choice element: (model type, its collection).
    choices: tuple = ()
    #: Digits after the point, where they are known.
    scale: int | None = None
    #: What the data hold beside a primitive: its id and extensions (`_name`).
    sibling: Coll | None = None

    def with_(self, **kw) -> Coll:
        """Changed; what stands beside a primitive goes with the untouched value only."""
        return replace(self, **({"sibling": None} | kw))


def scalar(col: Column, ty: Ty, **kw) -> Coll:
    return Coll(col, ty, True, **kw)


def array(col: Column, ty: Ty, **kw) -> Coll:
    return Coll(col, ty, False, **kw)


def nothing(ty: Ty = EMPTY) -> Coll:
    return Coll(F.lit(None).cast(ty.dt), ty, True)


def fail(message: str, dt: T.DataType) -> Column:
    return F.raise_error(F.lit(RUNTIME + message)).cast(dt)


def many(c: Coll) -> Column:
    """As an array."""
    if not c.single:
        return c.col
    if c.ty.name == "Empty":
        return F.array().cast(T.ArrayType(c.ty.dt))
    return F.array_compact(F.array(c.col))


def one(c: Coll, what: str = "the expression") -> Column:
    """As a scalar; more than one item is an error of the running job."""
    if c.single:
        return c.col
    return F.when(F.size(c.col) <= 1, F.get(c.col, F.lit(0))).otherwise(fail(f"{what} has more than one item", c.ty.dt))


def as_one(c: Coll, what: str = "the expression") -> Coll:
    return c if c.single else c.with_(col=one(c, what), single=True)


def first(c: Coll) -> Coll:
    return c if c.single else c.with_(col=F.get(c.col, F.lit(0)), single=True)


def size(c: Coll) -> Column:
    if c.single:
        return F.when(c.col.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    return F.size(c.col)


def bind(col: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once."""
    return F.get(F.transform(F.array(col), fn), F.lit(0))


def boolean(c: Coll, what: str = "the criterion") -> Column:
    """Singleton evaluation as Boolean: null where empty."""
    if c.ty.name == "Empty":
        return F.lit(None).cast("boolean")
    v = one(c, what)
    if c.ty.name == "Boolean":
        return v
    if c.ty.name == "Mixed":
        return F.when(v["type"] == "System.Boolean", v["value"].cast("boolean")).when(v.isNotNull(), F.lit(True))
    return F.when(v.isNotNull(), F.lit(True))


def holds(c: Coll) -> Column:
    return F.coalesce(boolean(c), F.lit(False))


def want(c: Coll, names: tuple[str, ...] | str, what: str) -> Coll:
    """A scalar of one of these types; another static type is a type error."""
    names = (names,) if isinstance(names, str) else names
    if c.ty.name == "Empty":
        kind = {"String": STRING, "Integer": INTEGER, "Boolean": BOOLEAN}.get(names[0], DOUBLE if names[0] == "Decimal" else STRING)
        return nothing(kind)
    if c.ty.name == "Mixed":
        # take the text when it has the wanted type
        if "String" in names:
            v = one(c, what)
            return scalar(F.when(v["type"] == "System.String", v["value"]), STRING)
    if c.ty.name not in names:
        raise PathTypeError(f"{what} takes {' or '.join(names)}, not {c.ty.name}")
    return as_one(c, what)


def to_text(c: Column, ty: Ty) -> Column:
    """The item's String form; null for complex types."""
    if ty.name == "Boolean" or ty.name in ("Integer", "Long", "String"):
        return c.cast("string")
    if ty.name == "Decimal":
        if isinstance(ty.dt, T.DecimalType):
            return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "") if ty.dt.scale > 9 else c.cast("string")
        whole = c == F.floor(c)
        return F.when(whole & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if ty.name in TEMPORAL:
        return temporal_text(c, ty)
    if ty.name == "Quantity":
        from pathloom.values import units

        v = to_text(c["value"], DECIMAL)
        return F.when(c["unit"].isin(*units.CALENDAR), F.concat(v, F.lit(" "), c["unit"], F.when(c["value"] == 1, F.lit("")).otherwise(F.lit("s")))).otherwise(
            F.concat(v, F.lit(" '"), c["unit"], F.lit("'"))
        )
    if ty.name == "Mixed":
        return c["value"]
    return F.lit(None).cast("string")


def temporal_text(c: Column, ty: Ty) -> Column:
    if isinstance(ty.dt, T.StringType):
        return c
    if isinstance(ty.dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if ty.name == "Time":
        return F.date_format(c, "HH:mm:ss.SSS")
    end = "XXX" if isinstance(ty.dt, T.TimestampType) else ""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS" + end)


def tagged(c: Column, ty: Ty) -> Column:
    """An item of a collection of several types."""
    if ty.name == "Mixed":
        return c
    text = F.to_json(c) if ty.name in ("Struct", "TypeInfo") else to_text(c, ty)
    return F.when(c.isNotNull(), F.struct(F.lit(ty.full).alias("type"), text.alias("value")))


def common(a: Coll, b: Coll) -> tuple[Coll, Coll]:
    """Both with one item type."""
    if a.ty.name == "Empty":
        return nothing(b.ty), b
    if b.ty.name == "Empty":
        return a, nothing(a.ty)
    if a.ty == b.ty or (a.ty.name == b.ty.name and a.ty.dt == b.ty.dt):
        return a, b
    if a.ty.name in NUMERIC and b.ty.name in NUMERIC:
        ty = wider(a.ty, b.ty)
        return cast(a, ty), cast(b, ty)
    if a.ty.name in TEMPORAL and a.ty.name == b.ty.name or {a.ty.name, b.ty.name} == {"String"}:
        ty = Ty(a.ty.name, T.StringType())
        return mapped(a, lambda x: temporal_text(x, a.ty), ty), mapped(b, lambda x: temporal_text(x, b.ty), ty)
    return as_tagged(a), as_tagged(b)


def as_tagged(x: Coll) -> Coll:
    return mapped(x, lambda v: tagged(v, x.ty), MIX)


def wider(a: Ty, b: Ty) -> Ty:
    if a.name == b.name == "Integer":
        return INTEGER
    if "Decimal" not in (a.name, b.name):
        return LONG
    if isinstance(a.dt, (T.DoubleType, T.FloatType)) or isinstance(b.dt, (T.DoubleType, T.FloatType)):
        return DOUBLE
    (p, s), (q, r) = digits(a), digits(b)
    scale = max(s, r)
    return Ty("Decimal", T.DecimalType(min(38, max(p - s, q - r) + scale), scale))


def digits(ty: Ty, const: object = None) -> tuple[int, int]:
    """Digits and places of a whole or decimal number."""
    if const is not None:
        _, figures, places = Decimal(str(const)).as_tuple()
        return max(len(figures) + max(places, 0), -places, 1), max(-places, 0)
    if isinstance(ty.dt, T.DecimalType):
        return ty.dt.precision, ty.dt.scale
    return {T.IntegerType: 10, T.ShortType: 5, T.ByteType: 3}.get(type(ty.dt), 19), 0


def cast(c: Coll, ty: Ty) -> Coll:
    dt = ty.dt if c.single else T.ArrayType(ty.dt)
    return c.with_(col=c.col.cast(dt), ty=ty, const=c.const)


def mapped(c: Coll, fn: Callable[[Column], Column], ty: Ty) -> Coll:
    """fn of each item; items for which it is null go."""
    if c.ty.name == "Empty":
        return nothing(ty)
    if c.single:
        return Coll(fn(c.col), ty, True, c.ordered)
    return Coll(F.array_compact(F.transform(c.col, fn)), ty, False, c.ordered)
