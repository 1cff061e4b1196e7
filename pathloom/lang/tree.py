"""The tree of an expression, and its canonical text."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    at: int = field(default=0, compare=False, kw_only=True)


@dataclass(frozen=True)
class Empty(Node):
    pass


@dataclass(frozen=True)
class Literal(Node):
    type: str  # Boolean String Integer Long Decimal Date DateTime Time
    text: str


@dataclass(frozen=True)
class QuantityLit(Node):
    number: str
    unit: str
    calendar: bool


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Special(Node):
    name: str  # this index total


@dataclass(frozen=True)
class Env(Node):
    name: str


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple


@dataclass(frozen=True)
class Dot(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Index(Node):
    of: Node
    index: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    of: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class TypeOp(Node):
    op: str  # is as
    of: Node
    type: str


#: How tightly operators bind; unary, index and dot bind tighter still.
POWER = {
    "implies": 1, "or": 2, "xor": 2, "and": 3, "in": 4, "contains": 4, "=": 5, "!=": 5, "~": 5, "!~": 5,
    "<": 6, ">": 6, "<=": 6, ">=": 6, "|": 7, "is": 8, "as": 8, "+": 9, "-": 9, "&": 9, "*": 10, "/": 10, "div": 10, "mod": 10,
}
UNARY, INDEX, DOT = 11, 12, 13


def quote(s: str, mark: str = "'") -> str:
    out = s.replace("\\", "\\\\").replace(mark, "\\" + mark)
    for c, e in (("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = out.replace(c, e)
    return mark + out + mark


def _name(s: str, after_dot: bool = False) -> str:
    from pathloom.lang.lexer import KEYWORDS

    plain = s.isascii() and (s[:1].isalpha() or s[:1] == "_") and all(c.isalnum() or c == "_" for c in s)
    return s if plain and s not in (KEYWORDS - {"as", "is", "in", "contains"}) else quote(s, "`")


def show(n: Node, least: int = 0) -> str:
    """Canonical text; parsing it gives the tree again."""

    def wrap(power: int, s: str) -> str:
        return f"({s})" if power < least else s

    match n:
        case Empty():
            return "{}"
        case Literal(type="String"):
            return quote(n.text)
        case Literal(type="Date" | "DateTime"):
            return "@" + n.text
        case Literal(type="Time"):
            return "@T" + n.text
        case Literal(type="Long"):
            return n.text + "L"
        case Literal():
            return n.text
        case QuantityLit():
            return f"{n.number} {n.unit if n.calendar else quote(n.unit)}"
        case Name():
            return _name(n.name)
        case Special():
            return "$" + n.name
        case Env():
            plain = n.name.isascii() and n.name.replace("_", "a").isalnum() and not n.name[0].isdigit()
            return "%" + (n.name if plain else quote(n.name, "`"))
        case Call():
            return f"{_name(n.name)}({', '.join(show(a) for a in n.args)})"
        case Dot():
            return wrap(DOT, f"{show(n.left, DOT)}.{show(n.right, DOT + 1)}")
        case Index():
            return wrap(INDEX, f"{show(n.of, INDEX)}[{show(n.index)}]")
        case Unary():
            return wrap(UNARY, f"{n.op}{show(n.of, UNARY)}")
        case TypeOp():
            return wrap(POWER[n.op], f"{show(n.of, POWER[n.op])} {n.op} {'.'.join(_name(p) for p in n.type.split('.'))}")
        case Binary():
            p = POWER[n.op]
            return wrap(p, f"{show(n.left, p)} {n.op} {show(n.right, p + 1)}")
    raise TypeError(n)
