"""The engine: expressions over DataFrames of resources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.lang import tree as t
from pathloom.lang.errors import RUNTIME, PathError, PathTypeError
from pathloom.lang.parser import parse
from pathloom.model.provider import Model
from pathloom.plans import coll as c
from pathloom.plans.analyzer import Diagnostic, analyze
from pathloom.plans.coll import Coll, Ty
from pathloom.plans.compiler import Compiler


def root_of(df: DataFrame, kind: str | None, model: Model | None, only: set[str] | None = None) -> Coll:
    """A row as the root item. The struct is of plain columns, so what an
    expression doesn't read is pruned."""
    fields = [f for f in df.schema.fields if only is None or f.name in only]
    struct = F.struct(*[df[f.name].alias(f.name) for f in fields])
    return Coll(struct, Ty("Struct", T.StructType(fields), f"{model.namespace}.{kind}" if model and kind else None), True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    have = {x.lower() for x in df.columns}
    while stem in have:
        stem = "_" + stem
    return stem


@dataclass(frozen=True)
class Engine:
    """model: what types mean; env: %name values; functions: the caller's own;
    strict: refuse what the analyzer finds wrong; now: a fixed clock (ISO text)."""

    model: Model | None = None
    env: dict = field(default_factory=dict)
    functions: dict = field(default_factory=dict)
    strict: bool = False
    now: str | None = None
    trace: Callable | None = None
    views: tuple = ()

    def with_(self, **options) -> Engine:
        """Options of a call merged over the engine's: env and functions by name."""
        options = dict(options)
        for k in ("env", "functions"):
            if k in options:
                options[k] = getattr(self, k) | {n.removeprefix("%"): v for n, v in options[k].items()}
        return replace(self, **options)

    def compiler(self, df: DataFrame, kind: str | None = None, root: Coll | None = None) -> Compiler:
        from pathloom.functions import REGISTRY, load

        load()
        host = dict(self.functions)
        for v in self.views:
            for name, spec in v.columns().items():
                host.setdefault(name, [])
                if isinstance(host[name], list):
                    if any(o.get("input") == v.type for o in host[name]):
                        raise PathTypeError(f"two views give {name} of {v.type}")
                    host[name] = [*host[name], {"input": v.type, "expression": spec.get("path") or spec.get("test"), "criteria": "test" in spec, "env": v.env}]
        clash = set(host) & set(REGISTRY)
        if clash:
            raise PathTypeError(f"built-in functions can't be replaced: {', '.join(sorted(clash))}")
        return Compiler(root or root_of(df, kind or self.kind_of(df), self.model), self.model, self.env, host, self.now, self.trace)

    def kind_of(self, df: DataFrame) -> str | None:
        """The resource type, if a literal column tells it."""
        return None

    def compile(self, df: DataFrame, expression: str | t.Node, kind: str | None = None, scope_vars: dict | None = None) -> Coll:
        node = parse(expression) if isinstance(expression, str) else expression
        kind = kind or head_type(node, self.model)
        if self.strict:
            wrong = [d for d in self.analyze(expression, kind, df) if d.severity == "error"]
            if wrong:
                raise PathTypeError("; ".join(f"{d.code}: {d.message}" for d in wrong))
        k = self.compiler(df, kind)
        from pathloom.plans.compiler import Scope

        out = k.walk(node, k.root, Scope(k.root, variables=dict(scope_vars or {})))
        return k.settle(out)

    def unwrapped(self, df: DataFrame, expressions: list, kind: str | None) -> DataFrame:
        """Bundles as rows of their resources of the type that the expressions begin
        with, where that is not Bundle; anything else as it is."""
        entry = df.schema["entry"].dataType if "entry" in df.columns else None
        if not isinstance(entry, T.ArrayType) or not isinstance(entry.elementType, T.StructType) or "resource" not in entry.elementType.names:
            return df
        resource = entry.elementType["resource"].dataType
        kinds = {kind or head_type(parse(e) if isinstance(e, str) else e, self.model) for e in expressions} - {None}
        if "Bundle" in kinds or not kinds or not isinstance(resource, T.StructType):
            return df
        if len(kinds) > 1:
            raise PathTypeError(f"one row can't be of several types: {', '.join(sorted(kinds))}")
        rows = df.select(F.explode("entry.resource").alias("r")).where("r is not null").select("r.*")
        return rows.where(F.col("resourceType") == kinds.pop()) if "resourceType" in resource.names else rows

    def evaluate(self, df: DataFrame, expression: str, key: str = "id", kind: str | None = None, typed: bool = False) -> DataFrame:
        """One row for each result: key, position, value (and type). Bundles are unwrapped."""
        df = self.unwrapped(df, [expression], kind)
        x = self.compile(df, expression, kind)
        if x.single:
            rows = df.select(df[key].alias(key), F.lit(0).alias("position"), x.col.alias("value")).where("value is not null")
        else:
            rows = df.select(df[key].alias(key), F.posexplode(x.col).alias("position", "value"))
        if typed:
            tag = F.col("value.type") if x.ty.name == "Mixed" else F.lit(x.ty.full)
            rows = rows.withColumn("type", tag)
        return rows

    def first(self, df: DataFrame, expression: str, kind: str | None = None) -> Column:
        return c.first(self.compile(df, expression, kind)).col

    def test(self, df: DataFrame, expression: str, kind: str | None = None) -> Column:
        return c.holds(self.compile(df, expression, kind))

    def filter(self, df: DataFrame, expression: str, kind: str | None = None) -> DataFrame:
        df = self.unwrapped(df, [expression], kind)
        # a row whose criterion is empty goes either way: bare, the condition reaches the scan
        return df.where(c.boolean(self.compile(df, expression, kind)))

    def project(self, df: DataFrame, columns: dict, kind: str | None = None, variables: dict | None = None, keep: list[str] = (), row_order: str | None = None) -> DataFrame:
        """One row for each resource. A column is an expression or a dict: path or
        test, collection, default, as, choices (with pick), enum. variables are
        bound in order, once a row; %rowIndex counts along row_order."""
        from pathloom.api.project import shape

        if isinstance(columns, type):
            return columns.project(self, df)
        specs = [{"path": x} if isinstance(x, str) else x for x in columns.values()]
        df = self.unwrapped(df, [e for x in specs for e in (x.get("path") or x.get("test"),) if e], kind)
        bound: dict = {}
        if row_order is not None:
            from pyspark.sql import Window as W

            row, rows = fresh(df, "row"), fresh(df, "rows")
            df = df.withColumn(row, F.row_number().over(W.orderBy(row_order)) - 1).withColumn(rows, F.count(F.lit(1)).over(W.partitionBy()))
            bound = {"rowIndex": c.scalar(df[row].cast("bigint"), c.INTEGER), "rowTotal": c.scalar(df[rows], c.INTEGER)}
        for name, e in (variables or {}).items():
            bound[name.removeprefix("%")] = self.compile(df, e, kind, bound)
        out = [df[k] for k in keep]
        for name, spec in columns.items():
            spec = {"path": spec} if isinstance(spec, str) else dict(spec)
            out.append(shape(self, df, name, spec, kind, bound).alias(name))
        return df.select(*out)

    def check_constraints(self, df: DataFrame, constraints: list[dict], key: str = "id", kind: str | None = None) -> DataFrame:
        """One row for each constraint that doesn't hold: key, constraint, severity,
        human, error. What a constraint raises while compiling is its error."""
        issues = []
        for k in constraints:
            try:
                ok, error = self.test(df, k["expression"], kind), F.lit(None).cast("string")
            except PathError as e:
                ok, error = F.lit(False), F.lit(str(e))
            issues.append(
                F.when(
                    ~ok,
                    F.struct(
                        F.lit(k["key"]).alias("constraint"), F.lit(k.get("severity", "error")).alias("severity"), F.lit(k.get("human")).cast("string").alias("human"), error.alias("error")
                    ),
                )
            )
        rows = df.select(df[key].alias(key), F.explode(F.array_compact(F.array(*issues))).alias("issue"))
        return rows.select(key, "issue.*")

    def operation_outcome(self, df: DataFrame, constraints: list[dict], key: str = "id", kind: str | None = None) -> DataFrame:
        """Issues of each failing resource as an OperationOutcome; valid tells that none is an error."""
        found = self.check_constraints(df, constraints, key, kind)
        issue = F.struct(F.col("severity"), F.lit("invariant").alias("code"), F.coalesce("human", "constraint").alias("diagnostics"))
        return found.groupBy(key).agg(
            F.lit("OperationOutcome").alias("resourceType"), F.sort_array(F.collect_list(issue)).alias("issue"), (~F.bool_or(F.col("severity") == "error")).alias("valid")
        )

    def analyze(self, expression: str, kind: str | None = None, df: DataFrame | None = None) -> list[Diagnostic]:
        return analyze(expression, self.model, kind, set(self.env), self.functions)


def head_type(n: t.Node, model: Model | None) -> str | None:
    """The type that a path begins with, if it is one of the model's."""
    if model is None:
        return None
    found: set[str] = set()

    def visit(n, head=True):
        if isinstance(n, t.Name):
            if head and n.name[:1].isupper() and model.has(n.name):
                found.add(n.name)
        elif isinstance(n, t.Dot):
            visit(n.left, head)
            visit(n.right, False)
        elif isinstance(n, t.Call):
            for a in n.args:
                if n.name not in ("ofType", "is", "as"):
                    visit(a, head)
        else:
            for f in n.__dataclass_fields__:
                v = getattr(n, f)
                for x in v if isinstance(v, tuple) else (v,):
                    if isinstance(x, t.Node):
                        visit(x, head)

    visit(n)
    return found.pop() if len(found) == 1 else None


__all__ = ["RUNTIME", "Engine", "head_type", "root_of"]
