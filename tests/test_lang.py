"""Parser, printer and analyzer."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom import functions
from pathloom.lang import tree as t
from pathloom.lang.parser import parse
from pathloom.lang.tree import POWER, show
from pathloom.model.r4 import R4
from pathloom.plans.analyzer import analyze, inspect

names = st.sampled_from(["a", "name", "div", "is", "contains", "a b", "x`y", "true", "_z", "é"])
leaves = st.one_of(
    st.just(t.Empty()),
    names.map(t.Name),
    st.sampled_from(["this", "index", "total"]).map(t.Special),
    st.sampled_from(["x", "vs-a", "a b"]).map(t.Env),
    st.text(max_size=8).filter(lambda s: "\x00" not in s and not any(0xD800 <= ord(ch) < 0xE000 for ch in s)).map(lambda s: t.Literal("String", s)),
    st.integers(0, 10**12).map(lambda n: t.Literal("Integer", str(n))),
    st.sampled_from(["1.10", "0.5"]).map(lambda s: t.Literal("Decimal", s)),
    st.sampled_from(["2014", "2014-01", "2014-01-25"]).map(lambda s: t.Literal("Date", s)),
    st.sampled_from(["2014T", "2014-01-25T14:30Z", "2014-01-25T14:30:00.000+02:00"]).map(lambda s: t.Literal("DateTime", s)),
    st.just(t.QuantityLit("4", "days", True)),
    st.just(t.QuantityLit("4.5", "mg", False)),
    st.sampled_from(["true", "false"]).map(lambda s: t.Literal("Boolean", s)),
)


def grow(e):
    calls = st.tuples(st.sampled_from(["f", "where", "is"]), st.lists(e, max_size=2)).map(lambda x: t.Call(x[0], tuple(x[1])))
    return st.one_of(
        st.tuples(st.sampled_from([o for o in POWER if o not in ("is", "as")]), e, e).map(lambda x: t.Binary(*x)),
        st.tuples(st.sampled_from("+-"), e).map(lambda x: t.Unary(*x)),
        st.tuples(e, e).map(lambda x: t.Index(*x)),
        st.tuples(e, st.one_of(calls, names.filter(lambda n: n != "true").map(t.Name))).map(lambda x: t.Dot(*x)),
        st.tuples(st.sampled_from(["is", "as"]), e, st.sampled_from(["Patient", "FHIR.Patient", "System.String"])).map(lambda x: t.TypeOp(*x)),
        calls,
    )


@settings(max_examples=400, deadline=None)
@given(st.recursive(leaves, grow, max_leaves=12))
def test_round_trip(tree):
    assert parse(show(tree)) == tree


def test_precedence():
    assert parse("-1.abs()") == t.Unary("-", t.Dot(t.Literal("Integer", "1"), t.Call("abs", ())))
    assert parse("1 + 2 * 3") == t.Binary("+", t.Literal("Integer", "1"), t.Binary("*", t.Literal("Integer", "2"), t.Literal("Integer", "3")))
    assert parse("a | b is C") == t.Binary("|", t.Name("a"), t.TypeOp("is", t.Name("b"), "C"))
    assert parse("1 + 2 is Integer") == t.TypeOp("is", t.Binary("+", t.Literal("Integer", "1"), t.Literal("Integer", "2")), "Integer")


def test_library_is_whole():
    functions.load()
    assert len(functions.REGISTRY) == 121


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("Patient.nam", "unknown-element"), ("Patient.name.given.foo()", "unknown-function"), ("Patient.name.first(1)", "wrong-arity"), ("%nope", "unknown-variable"),
        ("Patient.name is Nope", "unknown-type"), ("Patient.name.given + 'a'", "singleton-required"), ("Patient.active > 1", "operand-type"), ("Patient.active = 'x'", "equality-incompatible"),
        ("Patient.children().first()", "order-dependent"), ("HumanName.given", "datatype-root"), ("Patient.name.ofType(Observation)", "always-empty"), ("defineVariable('a').defineVariable('a')", "variable-redefined"),
        ("defineVariable('context')", "variable-override"), ("'a'.matches('(a+)+')", "regex-backtracking"), ("Observation.valueQuantity", "unknown-element"), ("1 +", "syntax"), ("Patient.active.upper()", "operand-type"),
        ("Patient.gender.startsWith(Patient.name.given)", "argument-singleton"),
    ],
)
def test_diagnostics(text, code):
    assert code in {d.code for d in analyze(text, R4, "Observation" if text.startswith("Observation") else "Patient")}


@pytest.mark.parametrize("text", ["Patient.name.first().given", "name.where(use = 'old').family.first()", "Patient.birthDate + 1 year > @2000", "telecom.exists(system = 'phone' and rank > 0)", "deceased.ofType(boolean)", "Patient.contained.ofType(Organization).name"])
def test_valid_expressions_have_no_error(text):
    assert not [d for d in analyze(text, R4, "Patient") if d.severity == "error"]


def test_touched_elements():
    assert inspect("Patient.name.where(use = 'x').family", R4, "Patient")[1] == {"Patient.name", "HumanName.use", "HumanName.family"}
