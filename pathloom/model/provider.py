"""A model: types with a base and elements, written in short lines.

A line is `Name Base element:Type element:Type* element:Type|Type`, where *
marks a list and | the types of a choice, whose element is stored as element
plus type name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: FHIR-like primitives and the System type that they behave as.
TWINS = {
    "boolean": "Boolean", "integer": "Integer", "positiveInt": "Integer", "unsignedInt": "Integer", "integer64": "Long", "decimal": "Decimal",
    "date": "Date", "dateTime": "DateTime", "instant": "DateTime", "time": "Time",
} | dict.fromkeys(("string", "code", "uri", "url", "canonical", "id", "oid", "uuid", "markdown", "base64Binary", "xhtml"), "String")
QUANTITIES = {"Quantity", "SimpleQuantity", "Age", "Count", "Distance", "Duration", "MoneyQuantity"}
_PRIMITIVE_BASE = {"code": "string", "id": "string", "markdown": "string", "url": "uri", "canonical": "uri", "oid": "uri", "uuid": "uri", "positiveInt": "integer", "unsignedInt": "integer"}


@dataclass
class Type:
    name: str
    base: str | None
    elements: dict[str, tuple[tuple[str, ...], bool]] = field(default_factory=dict)
    targets: dict[str, tuple[str, ...]] = field(default_factory=dict)


class Model:
    def __init__(self, namespace: str, lines: str, primitives: bool = True):
        self.namespace, self.types = namespace, {}
        if primitives:
            for p in TWINS:
                self.types[p] = Type(p, _PRIMITIVE_BASE.get(p, "Element"))
        for line in filter(None, map(str.strip, lines.splitlines())):
            name, base, *rest = line.split()
            t = self.types[name] = Type(name, None if base == "-" else base)
            for e in rest:
                element, kinds = e.split(":")
                kinds, _, targets = kinds.partition("<")
                t.elements[element] = (tuple(kinds.rstrip("*").split("|")), kinds.endswith("*"))
                if targets:
                    t.targets[element] = tuple(targets.split(","))

    def has(self, name: str | None) -> bool:
        return name in self.types

    def element(self, owner: str | None, name: str) -> tuple[tuple[str, ...], bool] | None:
        seen = set()
        while owner in self.types and owner not in seen:
            seen.add(owner)
            t = self.types[owner]
            if name in t.elements:
                return t.elements[name]
            owner = t.base
        return None

    def targets(self, owner: str | None, name: str) -> tuple[str, ...]:
        t = self.types.get(owner)
        return t.targets.get(name, ()) if t else ()

    def elements(self, owner: str) -> list[str]:
        out: set[str] = set()
        while owner in self.types:
            out |= set(self.types[owner].elements)
            owner = self.types[owner].base
        return sorted(out)

    def is_a(self, name: str, base: str) -> bool:
        while name is not None:
            if name == base:
                return True
            name = self.types[name].base if name in self.types else None
        return False
