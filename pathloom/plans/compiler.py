"""Tree to Column: navigation, operators and scopes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom import functions
from pathloom.lang import tree as t
from pathloom.lang.errors import PathError, PathTypeError
from pathloom.lang.parser import parse
from pathloom.model.provider import QUANTITIES, TWINS, Model
from pathloom.plans import coll as c
from pathloom.plans import operators
from pathloom.plans.coll import Coll, Ty
from pathloom.values import units

SYSTEM = {"Boolean", "String", "Integer", "Long", "Decimal", "Date", "DateTime", "Time", "Quantity", "Any"}


@dataclass(frozen=True)
class Scope:
    """Bindings of an expression: $this, $index, $total, variables."""

    this: Coll
    index: Coll | None = None
    total: Coll | None = None
    variables: dict = field(default_factory=dict)
    expanding: tuple = ()

    def frame(self, this: Coll, **kw) -> Scope:
        return replace(self, this=this, variables=dict(self.variables), **kw)


class Compiler:
    """One expression over rows whose root is a Coll. `touched` gathers the
    elements read, as owner.element."""

    def __init__(self, root: Coll, model: Model | None = None, env: dict | None = None, host: dict | None = None, now: str | None = None, trace=None):
        functions.load()
        self.root, self.model, self.env, self.host, self.now, self.trace = root, model, env or {}, host or {}, now, trace
        self.touched: set[str] = set()

    def compile(self, expression: str | t.Node) -> Coll:
        node = parse(expression) if isinstance(expression, str) else expression
        return self.walk(node, self.root, Scope(self.root))

    def walk(self, n: t.Node, focus: Coll, scope: Scope) -> Coll:
        match n:
            case t.Empty():
                return c.nothing()
            case t.Literal():
                return self.literal(n)
            case t.QuantityLit():
                unit = n.unit.removesuffix("s") if n.calendar else n.unit
                value = F.struct(F.lit(Decimal(n.number)).cast(c.DEC).alias("value"), F.lit(unit).alias("unit"))
                return c.scalar(value, c.QTY, const=(Decimal(n.number), unit))
            case t.Name():
                return self.name(n, focus)
            case t.Special(name="this"):
                return scope.this
            case t.Special(name=name):
                found = getattr(scope, name)
                if found is None:
                    raise PathTypeError(f"${name} outside of an iteration", n.at)
                return found
            case t.Env():
                return self.external(n, scope)
            case t.Dot():
                left = self.walk(n.left, focus, scope)
                return self.walk(n.right, left, scope)
            case t.Index():
                of, i = self.walk(n.of, focus, scope), self.walk(n.index, scope.this, self.fork(scope))
                i = c.want(i, "Integer", "an index").col
                if of.single:
                    return of.with_(col=F.when(i == 0, of.col), const=None)
                return of.with_(col=F.when(i >= 0, F.get(of.col, i.cast("int"))), single=True)
            case t.Unary():
                return operators.unary(n.op, self.walk(n.of, focus, scope))
            case t.Binary():
                left, right = (self.walk(x, focus, self.fork(scope)) for x in (n.left, n.right))
                try:
                    return operators.binary(n.op, left, right)
                except PathError as e:
                    if e.at is None:
                        raise type(e)(e.message, n.at) from None
                    raise
            case t.TypeOp():
                of = self.walk(n.of, focus, scope)
                return self.is_type(c.as_one(of), n.type) if n.op == "is" else self.of_type(c.as_one(of), n.type, exact=True)
            case t.Call():
                return self.call(n, focus, scope)
        raise PathTypeError(f"unknown node {n}")

    def fork(self, scope: Scope) -> Scope:
        return replace(scope, variables=dict(scope.variables))

    def literal(self, n: t.Literal) -> Coll:
        match n.type:
            case "Boolean":
                return c.scalar(F.lit(n.text == "true"), c.BOOLEAN, const=n.text == "true")
            case "String":
                return c.scalar(F.lit(n.text), c.STRING, const=n.text)
            case "Integer" | "Long":
                v = int(n.text)
                if v >= 2**63:
                    return c.scalar(F.lit(Decimal(v)), Ty("Decimal", T.DecimalType(38, 0)), const=Decimal(v), scale=0)
                return c.scalar(F.lit(v).cast("bigint"), c.INTEGER if n.type == "Integer" and v < 2**31 else c.LONG, const=v, scale=0)
            case "Decimal":
                d = Decimal(n.text)
                scale = -d.as_tuple().exponent
                digits, places = c.digits(c.DECIMAL, d)
                if digits > 38:
                    raise PathTypeError(f"{n.text} has more than 38 digits")
                return c.scalar(F.lit(d).cast(T.DecimalType(digits, places)), Ty("Decimal", T.DecimalType(digits, places)), const=d, scale=scale)
        return c.scalar(F.lit(n.text), Ty(n.type, T.StringType()), const=n.text)

    # navigation

    def name(self, n: t.Name, focus: Coll) -> Coll:
        name = n.name
        if focus.ty.name == "Empty":
            return focus
        model = focus.ty.model.partition(".")[2] if focus.ty.model else None
        if name[:1].isupper() and model and (model == name or self.model and self.model.is_a(model, name)):
            return focus
        if name[:1].isupper() and focus.ty.name == "Struct" and "resourceType" in focus.ty.dt.names and model is None:
            if focus.single:
                return focus.with_(col=F.when(focus.col["resourceType"] == name, focus.col))
            return focus.with_(col=F.filter(focus.col, lambda x: x["resourceType"] == name))
        if focus.choices:
            focus = self.settle(focus)
        if focus.ty.name == "Variant":
            return self.variant_field(focus, name)
        if focus.ty.name == "Quantity" and name in ("value", "unit", "code"):
            part = "value" if name == "value" else "unit"
            return c.mapped(focus, lambda x: x[part], c.DECIMAL if part == "value" else c.STRING)
        if focus.sibling is not None and name in ("extension", "id"):
            return self.name(n, focus.sibling)
        if not isinstance(focus.ty.dt, T.StructType):
            return c.nothing()
        return self.element(focus, model, name)

    def element(self, focus: Coll, owner: str | None, name: str) -> Coll:
        names = focus.ty.dt.names
        spec = self.model.element(owner, name) if self.model and owner else None
        if owner:
            self.touched.add(f"{owner}.{name}")
        if spec and len(spec[0]) > 1:
            found = []
            for kind in spec[0]:
                stored = name + kind[0].upper() + kind[1:]
                if stored in names:
                    found.append((kind, self.field(focus, stored, kind)))
            if not found:
                return c.nothing()
            if len(found) == 1:
                return found[0][1]
            return found[0][1].with_(choices=tuple(found))
        if name not in names or spec is None and self.model and owner and self.model.has(owner) and self._is_choice_field(owner, name):
            return c.nothing()
        return self.field(focus, name, spec[0][0] if spec else None)

    def _is_choice_field(self, owner: str, name: str) -> bool:
        """valueQuantity isn't an element, value is."""
        stem = name
        while stem:
            stem = stem[:-1]
            spec = self.model.element(owner, stem)
            if spec and len(spec[0]) > 1 and any(stem + k[0].upper() + k[1:] == name for k in spec[0]):
                return True
        return False

    def field(self, focus: Coll, name: str, kind: str | None) -> Coll:
        out = self._field(focus, name, kind)
        beside = "_" + name
        if kind in TWINS and beside in focus.ty.dt.names and isinstance(focus.ty.dt[beside].dataType, (T.StructType, T.ArrayType)):
            out = out.with_(sibling=self._field(focus, beside, "Element"))
        return out

    def _field(self, focus: Coll, name: str, kind: str | None) -> Coll:
        dt = focus.ty.dt[name].dataType
        nullable = True
        if isinstance(dt, T.ArrayType):
            nullable, item = dt.containsNull, dt.elementType
            ty = self.type_of(item, kind)
            if focus.single:
                col = F.coalesce(focus.col[name], F.array().cast(dt))
                col = F.array_compact(col) if nullable else col
            else:
                col = F.flatten(F.array_compact(focus.col[name]))
                col = F.array_compact(col) if nullable else col
            return c.array(col, ty)
        ty = self.type_of(dt, kind)
        if focus.single:
            return c.scalar(focus.col[name], ty)
        return c.array(F.array_compact(focus.col[name]), ty, ordered=focus.ordered)

    def type_of(self, dt: T.DataType, kind: str | None = None) -> Ty:
        """A Spark type under a type of the model, if one is known."""
        model = f"{self.model.namespace}.{kind}" if self.model and kind else None
        if kind in TWINS:
            twin = TWINS[kind]
            if twin in ("Date", "DateTime", "Time") and isinstance(dt, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
                return Ty(twin, dt, model)
            if twin == "Decimal" and isinstance(dt, T.NumericType):
                return Ty("Decimal", dt, model)
        match dt:
            case T.BooleanType():
                return Ty("Boolean", dt, model)
            case T.StringType():
                return Ty("String", dt, model)
            case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
                return Ty("Integer", dt, model)
            case T.DoubleType() | T.FloatType() | T.DecimalType():
                return Ty("Decimal", dt, model)
            case T.DateType():
                return Ty("Date", dt, model)
            case T.TimestampType() | T.TimestampNTZType():
                return Ty("DateTime", dt, model)
            case T.VariantType():
                return Ty("Variant", dt, model)
        return Ty("Struct", dt, model)

    def variant_field(self, focus: Coll, name: str) -> Coll:
        """Schemaless data: a member of each object, lists flattened."""
        path = F.lit(f"$['{name}']") if "'" not in name else F.lit(f'$["{name}"]')
        ty = Ty("Variant", T.VariantType())
        one = lambda v: F.try_variant_get(v, path, "variant")
        if focus.single:
            items = F.coalesce(F.try_variant_get(focus.col, path, "array<variant>"), F.array_compact(F.array(one(focus.col))))
        else:
            items = F.flatten(F.transform(focus.col, lambda v: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array_compact(F.array(one(v))))))
        return c.array(F.filter(items, lambda v: v.isNotNull() & ~F.is_variant_null(v)), ty)

    def settle(self, x: Coll) -> Coll:
        """A choice as one collection: of its common type, or of tagged items."""
        if not x.choices:
            return x
        parts = [p for _, p in x.choices]
        if len({p.ty.name for p in parts}) > 1 or any(p.ty.dt != parts[0].ty.dt for p in parts):
            parts = [c.as_tagged(p) for p in parts]
        if all(p.single for p in parts):
            return parts[0].with_(col=F.coalesce(*[p.col for p in parts]), choices=())
        return c.array(F.concat(*[c.many(p) for p in parts]), parts[0].ty, ordered=False)

    # types

    def resolve_type(self, name: str) -> tuple[str | None, str]:
        space, _, local = name.rpartition(".")
        return (space or None), local

    def _answers(self, ty: Ty, name: str, exact: bool) -> bool:
        space, local = self.resolve_type(name)
        if ty.name in ("Variant", "Empty"):
            return False
        if ty.model is None:
            system = ty.name if ty.name != "Struct" else None
            if space == "System" or space is None:
                return local == "Any" and system is not None or system is not None and local.lower() == system.lower() and (space is None or local == system)
            return False
        if space == "System":
            return False
        own = ty.model.partition(".")[2]
        if space and space != ty.model.partition(".")[0]:
            return False
        if exact and local.lower() in {s.lower() for s in SYSTEM} and local not in QUANTITIES:
            return own == local
        return bool(self.model and self.model.is_a(own, local)) or own == local

    def check_type(self, name: str) -> None:
        space, local = self.resolve_type(name)
        if self.model and local not in SYSTEM and not self.model.has(local) and local.lower() not in {s.lower() for s in SYSTEM} and local not in TWINS:
            raise PathTypeError(f"unknown type {name}")

    def is_type(self, x: Coll, name: str) -> Coll:
        self.check_type(name)
        if x.ty.name == "Empty":
            return c.nothing(c.BOOLEAN)
        if x.choices:
            hits = [F.when(p.col.isNotNull(), F.lit(self._answers(p.ty, name, False))) for _, p in x.choices]
            return c.scalar(F.coalesce(*hits), c.BOOLEAN)
        return c.scalar(F.when(x.col.isNotNull(), self.matches(x.col, x.ty, name, False)), c.BOOLEAN)

    def matches(self, col: Column, ty: Ty, name: str, exact: bool) -> Column:
        if ty.name == "Mixed":
            _, local = self.resolve_type(name)
            space = name.rpartition(".")[0]
            local = next((s for s in SYSTEM if s.lower() == local.lower()), local)
            options = [f"{space}.{local}"] if space else [f"System.{local}", *([f"{self.model.namespace}.{name}"] if self.model else [])]
            return col["type"].isin(*options)
        if ty.name == "Struct" and "resourceType" in ty.dt.names and (ty.model is None or ty.model.endswith((".Resource", ".DomainResource"))):
            local = self.resolve_type(name)[1]
            if local in ("Resource", "DomainResource"):
                return col["resourceType"].isNotNull()
            return F.coalesce(col["resourceType"] == local, F.lit(False))
        return F.lit(self._answers(ty, name, exact))

    def of_type(self, x: Coll, name: str, exact: bool = True) -> Coll:
        self.check_type(name)
        if x.choices:
            kept = [(k, p) for k, p in x.choices if self._answers(p.ty, name, exact)]
            if not kept:
                return c.nothing()
            return kept[0][1] if len(kept) == 1 else kept[0][1].with_(choices=tuple(kept))
        if x.ty.name == "Mixed":
            local = next((s for s in SYSTEM if s.lower() == self.resolve_type(name)[1].lower()), None)
            to = {"Boolean": c.BOOLEAN, "String": c.STRING, "Integer": c.INTEGER, "Long": c.LONG, "Decimal": c.DECIMAL, "Date": c.DATE, "DateTime": c.DATETIME, "Time": c.TIME}.get(local, c.STRING)
            return c.mapped(x, lambda v: F.when(self.matches(v, x.ty, name, exact), v["value"].cast(to.dt)), to)
        if x.ty.name == "Struct" and self.matches(x.col, x.ty, name, exact) is not None and "resourceType" in x.ty.dt.names and (x.ty.model is None or x.ty.model.endswith("Resource")):
            ty = replace(x.ty, model=f"{self.model.namespace}.{self.resolve_type(name)[1]}") if self.model else x.ty
            return c.mapped(x, lambda v: F.when(self.matches(v, x.ty, name, exact), v), ty)
        return x if self._answers(x.ty, name, exact) else c.nothing()

    # calls

    def external(self, n: t.Env, scope: Scope) -> Coll:
        if n.name in scope.variables:
            return scope.variables[n.name]
        if n.name in self.env:
            v = self.env[n.name]
            return v if isinstance(v, Coll) else self.value(v)
        fixed = {"ucum": "http://unitsofmeasure.org", "sct": "http://snomed.info/sct", "loinc": "http://loinc.org"}
        if n.name in fixed:
            return c.scalar(F.lit(fixed[n.name]), c.STRING, const=fixed[n.name])
        if n.name in ("context", "resource", "rootResource"):
            return self.root
        for stem, base in (("vs-", "http://hl7.org/fhir/ValueSet/"), ("ext-", "http://hl7.org/fhir/StructureDefinition/")):
            if n.name.startswith(stem):
                return c.scalar(F.lit(base + n.name[len(stem) :]), c.STRING, const=base + n.name[len(stem) :])
        raise PathTypeError(f"unknown variable %{n.name}", n.at)

    def value(self, v: object) -> Coll:
        """A host value: scalars, lists of scalars of one type, Columns."""
        if isinstance(v, Column):
            raise PathTypeError("give a Column as a Coll with its type")
        if v is None or v == []:
            return c.nothing()
        if isinstance(v, bool):
            return c.scalar(F.lit(v), c.BOOLEAN, const=v)
        if isinstance(v, int):
            return c.scalar(F.lit(v).cast("bigint"), c.INTEGER, const=v, scale=0)
        if isinstance(v, float):
            v = Decimal(repr(v))
        if isinstance(v, Decimal):
            return self.literal(t.Literal("Decimal", format(v, "f")))
        if isinstance(v, str):
            return c.scalar(F.lit(v), c.STRING, const=v)
        if isinstance(v, (list, tuple)):
            items = [self.value(x) for x in v]
            out = items[0]
            for x in items[1:]:
                a, b = c.common(out, x)
                out = c.array(F.concat(c.many(a), c.many(b)), a.ty)
            return out
        raise PathTypeError(f"can't use a {type(v).__name__} as a value")

    def call(self, n: t.Call, focus: Coll, scope: Scope) -> Coll:
        if n.name in self.host:
            return self.host_call(n, focus, scope)
        if n.name not in functions.REGISTRY:
            import difflib

            near = difflib.get_close_matches(n.name, [*functions.REGISTRY, *self.host], 1)
            raise PathTypeError(f"unknown function {n.name}" + (f", did you mean {near[0]}?" if near else ""), n.at)
        fewest, most, build = functions.REGISTRY[n.name]
        if not fewest <= len(n.args) <= most:
            raise PathTypeError(f"{n.name} takes {fewest if fewest == most else f'{fewest} to {most}'} arguments, not {len(n.args)}", n.at)
        if n.name not in ("ofType", "is", "as"):
            focus = self.settle(focus)
        try:
            return build(self, focus, n.args, scope)
        except PathError as e:
            if e.at is None:
                raise type(e)(e.message, n.at) from None
            raise

    def host_call(self, n: t.Call, focus: Coll, scope: Scope) -> Coll:
        """Functions of the caller: a Column builder, an expression that is
        expanded in place, or overloads by input type."""
        f = self.host[n.name]
        if isinstance(f, list):
            for option in f:
                need = option.get("input")
                if need is None or focus.ty.name == "Empty" or self._answers(focus.ty, need, False):
                    f = option
                    break
            else:
                raise PathTypeError(f"no overload of {n.name} takes {focus.ty.full}", n.at)
        if callable(f):
            args = [self.arg(a, scope) for a in n.args]
            out = f(focus, *args)
            return out if isinstance(out, Coll) else c.scalar(out, focus.ty)
        if isinstance(f, str):
            f = {"expression": f}
        if n.args:
            raise PathTypeError(f"{n.name} takes no arguments", n.at)
        if n.name in scope.expanding:
            raise PathTypeError(f"{n.name} calls itself", n.at)
        own = Compiler(self.root, self.model, self.env | f.get("env", {}), self.host, self.now, self.trace)
        inner = Scope(focus, variables=dict(scope.variables), expanding=(*scope.expanding, n.name))
        out = own.walk(parse(f["expression"]), focus, inner)
        self.touched |= own.touched
        return c.scalar(c.holds(out), c.BOOLEAN) if f.get("criteria") else out

    def arg(self, node: t.Node, scope: Scope) -> Coll:
        """A value argument: evaluated against $this, not the function's input."""
        return self.settle(self.walk(node, scope.this, self.fork(scope)))

    def body(self, node: t.Node, item: Coll, scope: Scope, **frame) -> Coll:
        """A lambda's body for one item."""
        return self.settle(self.walk(node, item, scope.frame(item, **frame)))

    def each(self, x: Coll, scope: Scope, fn: Callable[[Coll, Scope], Column]) -> Callable:
        """A two-argument lambda for the items of an array."""

        def run(v: Column, i: Column) -> Column:
            item = x.with_(col=v, single=True, const=None)
            return fn(item, scope.frame(item, index=c.scalar(i.cast("bigint"), c.INTEGER)))

        return run


__all__ = ["Compiler", "Scope", "units"]
