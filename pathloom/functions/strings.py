"""String functions. Positions count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import function
from pathloom.lang.errors import RUNTIME, PathTypeError
from pathloom.plans import coll as c
from pathloom.plans.coll import Coll


def _text(x: Coll, name: str) -> Column:
    return c.want(x, "String", f"{name}()").col


def _args(k, args, scope, name) -> list[Column]:
    return [c.want(k.arg(a, scope), "String", f"an argument of {name}()").col for a in args]


def _text_function(name, build, out, n=1):
    @function(name, n)
    def run(k, x, args, scope):
        if x.ty.name == "Empty":
            return c.nothing(out)
        return c.scalar(build(_text(x, name), *_args(k, args, scope, name)), out)


_text_function("indexOf", lambda v, s: (F.position(s, v) - 1).cast("bigint"), c.INTEGER)
_text_function("startsWith", lambda v, s: F.startswith(v, s), c.BOOLEAN)
_text_function("endsWith", lambda v, s: F.endswith(v, s), c.BOOLEAN)
_text_function("contains", lambda v, s: F.contains(v, s), c.BOOLEAN)
_text_function("upper", lambda v: F.upper(v), c.STRING, 0)
_text_function("lower", lambda v: F.lower(v), c.STRING, 0)
_text_function("length", lambda v: F.length(v).cast("bigint"), c.INTEGER, 0)
_WS = "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
_text_function("trim", lambda v: F.regexp_replace(v, f"^{_WS}|{_WS}$", ""), c.STRING, 0)
_text_function(
    "lastIndexOf",
    lambda v, s: F.when(s == "", F.length(v)).otherwise(F.coalesce(F.length(v) - F.length(s) - F.nullif(F.position(F.reverse(s), F.reverse(v)), F.lit(0)) + 1, F.when(v.isNotNull() & s.isNotNull(), F.lit(-1)))).cast("bigint"),
    c.INTEGER,
)
_text_function(
    "replace",
    lambda v, p, s: F.when(p == "", F.concat(s, F.array_join(F.transform(F.filter(F.split(v, ""), lambda x: x != ""), lambda x: F.concat(x, s)), ""))).otherwise(F.replace(v, p, s)),
    c.STRING,
    2,
)


@function("substring", 1, 2)
def substring(k, x, args, scope):
    if x.ty.name == "Empty":
        return c.nothing(c.STRING)
    v = _text(x, "substring")
    start, *rest = (c.want(k.arg(a, scope), "Integer", "an argument of substring()") for a in args)
    s = start.col.cast("int")
    n = F.coalesce(rest[0].col.cast("int"), F.length(v)) if rest and rest[0].ty.name != "Empty" else F.length(v)
    return c.scalar(F.when((s >= 0) & (s < F.length(v)), F.substring(v, s + 1, F.greatest(n, F.lit(0)))), c.STRING)


def java_regex(p: str) -> str:
    """A JavaScript pattern for Java: group names carry no underscore, [ inside
    a class is escaped."""
    p = re.sub(r"\(\?<([A-Za-z]\w*)>", lambda m: f"(?<{m[1].replace('_', 'U')}>", p)
    out, inside, i = [], False, 0
    while i < len(p):
        ch = p[i]
        if ch == "\\":
            out.append(p[i : i + 2])
            i += 2
            continue
        if ch == "[":
            out.append("\\[" if inside else "[")
            inside = True
        else:
            inside = inside and ch != "]"
            out.append(ch)
        i += 1
    return "".join(out)


def _pattern(k, node, scope, name, wrap="(?s){}") -> tuple[Column, str | None]:
    p = c.want(k.arg(node, scope), "String", f"the pattern of {name}()")
    if isinstance(p.const, str):
        return F.lit(wrap.format(java_regex(p.const))), p.const
    head, tail = wrap.split("{}")
    return F.concat(F.lit(head), p.col, F.lit(tail)), None


@function("matches", 1)
def matches(k, x, args, scope):
    if x.ty.name == "Empty":
        return c.nothing(c.BOOLEAN)
    return c.scalar(F.rlike(_text(x, "matches"), _pattern(k, args[0], scope, "matches")[0]), c.BOOLEAN)


@function("matchesFull", 1)
def matches_full(k, x, args, scope):
    if x.ty.name == "Empty":
        return c.nothing(c.BOOLEAN)
    return c.scalar(F.rlike(_text(x, "matchesFull"), _pattern(k, args[0], scope, "matchesFull", "(?s)^(?:{})$")[0]), c.BOOLEAN)


def java_replacement(s: str) -> str:
    s = s.replace("\\", "\\\\")
    s = s.replace("$$", "\0").replace("$&", "$0")
    s = re.sub(r"\$<(\w+)>", lambda m: "${" + m[1].replace("_", "U") + "}", s)
    s = re.sub(r"\$(?![0-9{])", r"\\$", s)
    return s.replace("\0", "\\$")


@function("replaceMatches", 2)
def replace_matches(k, x, args, scope):
    if x.ty.name == "Empty":
        return c.nothing(c.STRING)
    v = _text(x, "replaceMatches")
    p, known = _pattern(k, args[0], scope, "replaceMatches")
    to = c.want(k.arg(args[1], scope), "String", "the substitution")
    if known == "":
        return c.scalar(v, c.STRING)
    sub = F.lit(java_replacement(to.const)) if isinstance(to.const, str) else to.col
    return c.scalar(F.regexp_replace(v, p, sub), c.STRING)


@function("toChars")
def to_chars(k, x, args, scope):
    v = _text(x, "toChars")
    return c.array(F.coalesce(F.filter(F.split(v, ""), lambda s: s != ""), F.array().cast("array<string>")), c.STRING)


@function("split", 1)
def split(k, x, args, scope):
    v = _text(x, "split")
    sep = c.want(k.arg(args[0], scope), "String", "the separator")
    if sep.const == "":
        return to_chars(k, x, (), scope)
    quoted = F.concat(F.lit("\\Q"), sep.col, F.lit("\\E"))
    return c.array(F.coalesce(F.split(v, quoted, -1), F.array().cast("array<string>")), c.STRING)


@function("join", 0, 1)
def join(k, x, args, scope):
    sep = _args(k, args, scope, "join")[0] if args else F.lit("")
    if x.ty.name == "Empty":
        return c.scalar(F.lit(""), c.STRING)
    if x.ty.name != "String":
        raise PathTypeError(f"join() takes String, not {x.ty.name}")
    return c.scalar(F.call_function("array_join", c.many(x), sep), c.STRING)


def _format(k, node, scope, name, allowed) -> str:
    f = k.arg(node, scope).const
    if f not in allowed:
        raise PathTypeError(f"{name}() takes {', '.join(allowed)}")
    return f


@function("encode", 1)
def encode(k, x, args, scope):
    f = _format(k, args[0], scope, "encode", ("base64", "urlbase64", "hex"))
    v = F.encode(_text(x, "encode"), "UTF-8")
    # base64() of Spark breaks no lines of its own here: chunks are joined again
    b = F.regexp_replace(F.base64(v), r"\s", "")
    return c.scalar({"base64": b, "urlbase64": F.translate(b, "+/", "-_"), "hex": F.lower(F.hex(v))}[f], c.STRING)


@function("decode", 1)
def decode(k, x, args, scope):
    f = _format(k, args[0], scope, "decode", ("base64", "urlbase64", "hex"))
    v = _text(x, "decode")
    raw = F.try_to_binary(F.translate(v, "-_", "+/") if f == "urlbase64" else v, F.lit("hex" if f == "hex" else "base64"))
    bad = F.raise_error(F.lit(f"{RUNTIME}decode() of what is no {f}")).cast("string")
    return c.scalar(F.when(v.isNotNull(), F.when(raw.isNull(), bad).otherwise(F.decode(raw, "UTF-8"))), c.STRING)


_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
_JSON = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


@function("escape", 1)
def escape(k, x, args, scope):
    v = _text(x, "escape")
    for a, b in _HTML if _format(k, args[0], scope, "escape", ("html", "json")) == "html" else _JSON:
        v = F.replace(v, F.lit(a), F.lit(b))
    return c.scalar(v, c.STRING)


@function("unescape", 1)
def unescape(k, x, args, scope):
    v = _text(x, "unescape")
    if _format(k, args[0], scope, "unescape", ("html", "json")) == "html":
        for a, b in [*_HTML[1:], ("'", "&apos;"), _HTML[0]]:
            v = F.replace(v, F.lit(b), F.lit(a))
        return c.scalar(v, c.STRING)
    body = F.replace(F.replace(F.replace(v, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    parsed = F.from_json(F.concat(F.lit('{"v":"'), F.regexp_replace(body, r'(?<!\\)((?:\\\\)*)"', r'$1\\"'), F.lit('"}')), T.StructType([T.StructField("v", T.StringType())]))
    bad = F.raise_error(F.lit(RUNTIME + "unescape() of a bad json escape")).cast("string")
    return c.scalar(F.when(v.isNotNull(), F.coalesce(parsed["v"], bad)), c.STRING)
