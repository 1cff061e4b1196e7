"""Trees, reflection, extensions, references, and names that are only reserved."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import function
from pathloom.lang.errors import PathRuntimeError, PathTypeError
from pathloom.plans import coll as c
from pathloom.plans import operators as o
from pathloom.plans.coll import Coll


@function("extension", 1)
def extension(k, x, args, scope):
    url = c.want(k.arg(args[0], scope), "String", "the url").col
    if x.sibling is not None:
        x = x.sibling
    if x.ty.name != "Struct" or "extension" not in x.ty.dt.names:
        return c.nothing()
    owner = x.ty.model.partition(".")[2] if x.ty.model else None
    found = k.field(x, "extension", "Extension" if k.model and k.model.has(owner or "") else None)
    return found.with_(col=F.filter(c.many(found), lambda e: e["url"] == url), single=False)


def _primitive(x: Coll) -> bool:
    return x.ty.name in ("Boolean", "String", *c.NUMERIC, *c.TEMPORAL)


@function("hasValue")
def has_value(k, x, args, scope):
    if x.ty.name == "Empty":
        return c.nothing(c.BOOLEAN)
    if not _primitive(x):
        return c.scalar(F.when(c.size(x) > 0, F.lit(False)), c.BOOLEAN)
    return c.scalar(F.when(c.size(x) > 0, c.size(x) == 1), c.BOOLEAN)


@function("getValue")
def get_value(k, x, args, scope):
    if not _primitive(x):
        return c.nothing()
    return x.with_(ty=c.Ty(x.ty.name, x.ty.dt)) if x.single else c.scalar(F.when(F.size(x.col) == 1, F.get(x.col, F.lit(0))), c.Ty(x.ty.name, x.ty.dt))


def _children(k, x: Coll) -> list[Coll]:
    if x.choices:
        x = k.settle(x)
    if x.ty.name != "Struct" or not isinstance(x.ty.dt, T.StructType):
        return []
    owner = x.ty.model.partition(".")[2] if x.ty.model else None
    known = k.model.elements(owner) if k.model and k.model.has(owner or "") else None
    names = known if known is not None else [n for n in x.ty.dt.names if n != "resourceType" and not n.startswith("_")]
    return [r for r in (k.settle(k.element(x, owner if known is not None else None, n)) for n in names) if r.ty.name != "Empty"]


def _gathered(found: list[Coll]) -> Coll:
    if not found:
        return c.nothing()
    if len(found) == 1:
        return found[0].with_(ordered=False)
    parts = [c.many(c.as_tagged(f)) for f in found]
    return c.array(F.concat(*parts), c.MIX, ordered=False)


@function("children")
def children(k, x, args, scope):
    return _gathered(_children(k, x))


@function("descendants")
def descendants(k, x, args, scope):
    """All that the schema can hold below the input, level by level."""
    found, level = [], [x]
    while level:
        level = [child for item in level for child in _children(k, item)]
        found += level
    return _gathered(found)


@function("type")
def type_(k, x, args, scope):
    if x.ty.name == "Empty":
        return c.nothing(c.INFO)

    def info(v):
        if x.ty.name == "Mixed":
            return F.struct(F.substring_index(v["type"], ".", 1).alias("namespace"), F.regexp_replace(v["type"], r"^[^.]*\.", "").alias("name"))
        space, _, name = x.ty.full.partition(".")
        if x.ty.name == "Struct" and x.ty.model is None:
            space, name = "System", "Object"
        return F.when(v.isNotNull(), F.struct(F.lit(space).alias("namespace"), F.lit(name).alias("name")))

    return c.mapped(x, info, c.INFO)


@function("resolve")
def resolve(k, x, args, scope):
    """References within the row: contained resources (#id), # for the root, and
    entries of a Bundle. Across rows, operators.joins.resolve does it."""
    root = k.root
    if x.ty.name == "Empty" or root.ty.name != "Struct":
        return c.nothing()
    ref = c.mapped(x, lambda v: v["reference"] if x.ty.name == "Struct" else v, c.STRING)
    names = root.ty.dt.names
    if "contained" in names:
        pool = k.field(root, "contained", "Resource" if k.model else None)
        found = F.filter(c.many(pool), lambda r: F.exists(c.many(ref), lambda s: s == F.concat(F.lit("#"), r["id"])))
        return c.array(found, pool.ty, ordered=False)
    if "entry" in names:
        entries = root.ty.dt["entry"].dataType.elementType
        kind = entries["resource"].dataType
        hit = lambda e: F.exists(
            c.many(ref),
            lambda s: ((s == e["fullUrl"]) if "fullUrl" in entries.names else F.lit(False)) | (s == F.concat(e["resource"]["resourceType"], F.lit("/"), e["resource"]["id"])),
        )
        found = F.transform(F.filter(F.coalesce(root.col["entry"], F.array().cast(root.ty.dt["entry"].dataType)), hit), lambda e: e["resource"])
        return c.array(F.array_compact(found), k.type_of(kind, "Resource" if k.model else None), ordered=False)
    return c.nothing()


@function("comparable", 1)
def comparable(k, x, args, scope):
    from pathloom.values import units

    a, b = o.quantity(c.as_one(x)), o.quantity(c.as_one(k.arg(args[0], scope)))
    loose = lambda q: units.factor_and_dimension(q.col["unit"], {"year": "a", "month": "mo"}.get(q.const[1], q.const[1]) if q.const else None)[1]
    return c.scalar(F.when(a.col.isNotNull() & b.col.isNotNull(), loose(a) == loose(b)), c.BOOLEAN)


@function("conformsTo", 1)
def conforms_to(k, x, args, scope):
    url = k.arg(args[0], scope).const
    base = "http://hl7.org/fhir/StructureDefinition/"
    if not isinstance(url, str) or not url.startswith(base):
        raise PathRuntimeError(f"no profile {url} is known")
    name = url[len(base) :]
    x = c.as_one(x, "conformsTo()")
    if x.ty.name == "Struct" and "resourceType" in x.ty.dt.names:
        return c.scalar(F.when(x.col.isNotNull(), x.col["resourceType"] == name), c.BOOLEAN)
    return c.scalar(F.when(x.col.isNotNull(), F.lit((x.ty.model or "").endswith("." + name))), c.BOOLEAN)


_TAGS = set("a abbr acronym b big blockquote br caption cite code col colgroup dd dfn div dl dt em h1 h2 h3 h4 h5 h6 hr i img li ol p pre q samp small span strong sub sup table tbody td tfoot th thead tr tt ul var".split())
_ATTRS = set("abbr accesskey align alt axis bgcolor border cellhalign cellpadding cellspacing cellvalign char charoff charset cite class colspan compact coords dir frame headers height href hreflang hspace id lang longdesc name nowrap rel rev rowspan rules scope shape span src start style summary tabindex title type valign value vspace width xml:lang xmlns".split())
_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|</?[A-Za-z][^<>]*>|[^<]+", re.S)
_OPEN = re.compile(r"<([A-Za-z][\w:-]*)((?:\s+[\w:-]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(/?)>", re.S)
_ATTR = re.compile(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)")


def narrative_ok(html: str) -> bool:
    """One div of allowed elements and attributes, well formed, with content."""
    stack: list[str] = []
    at, root, content = 0, False, False
    for m in _TOKEN.finditer(html):
        if m.start() != at:
            return False
        at, s = m.end(), m[0]
        if s[0] != "<":
            if not stack and s.strip() or _ENTITY.search(s):
                return False
            content = content or bool(s.strip())
        elif s.startswith("<!"):
            continue
        elif s[1] == "/":
            if not stack or stack.pop() != s[2:-1].strip().lower():
                return False
        else:
            o_ = _OPEN.fullmatch(s)
            if not o_:
                return False
            name = o_[1].lower()
            if name not in _TAGS or not stack and (root or name != "div") or _ENTITY.search(o_[2]):
                return False
            attrs = [a[0].lower() for a in _ATTR.findall(o_[2])]
            if len(set(attrs)) < len(attrs) or not set(attrs) <= _ATTRS:
                return False
            root, content = True, content or name == "img"
            if not o_[3]:
                stack.append(name)
    return at == len(html) and root and not stack and content


@function("htmlChecks")
def html_checks(k, x, args, scope):
    x = c.as_one(x, "htmlChecks()")
    if x.ty.name == "Empty":
        return c.nothing(c.BOOLEAN)
    if x.ty.name != "String":
        raise PathTypeError("htmlChecks() takes a narrative")

    @F.pandas_udf("boolean")
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else narrative_ok(v)).astype("boolean")

    return c.scalar(check(x.col), c.BOOLEAN)


def _reserved(name, fewest, most, needs):
    @function(name, fewest, most)
    def run(k, x, args, scope):
        raise PathRuntimeError(f"{name}() needs {needs}, which is not there")


for _name, _n, _m, _needs in (
    ("memberOf", 1, 1, "a terminology service"), ("subsumes", 1, 1, "a terminology service"), ("subsumedBy", 1, 1, "a terminology service"), ("slice", 2, 2, "profiles"),
    ("elementDefinition", 0, 0, "profiles"), ("checkModifiers", 0, 1, "profiles"), ("weight", 0, 0, "an ordinal value service"),
):
    _reserved(_name, _n, _m, _needs)

