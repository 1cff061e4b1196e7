"""A table of expressions over one patient, all in a few queries."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pathloom.api import Engine
from pathloom.lang.errors import PathError, PathRuntimeError, PathSyntaxError, PathTypeError
from pathloom.model.r4 import R4
from pathloom.plans import coll as c
from pathloom.sources.resources import from_objects

PATIENT = {
    "resourceType": "Patient",
    "birthDate": "1974-12-25",
    "gender": "male",
    "id": "p1",
    "deceasedBoolean": False,
    "active": True,
    "name": [{"given": ["Ada", "Jane"], "family": "Moss", "use": "official"}, {"given": ["Jo"], "use": "usual"}, {"given": ["Ada", "Jane"], "family": "Reed", "use": "maiden"}],
    "telecom": [{"rank": 1, "value": "(02) 4444 1234", "system": "phone", "use": "work"}, {"use": "home"}],
    "contained": [{"name": "Org", "id": "o1", "resourceType": "Organization"}],
    "managingOrganization": {"display": "Main", "reference": "Organization/77"},
}
ENGINE = Engine(R4, now="2024-05-06T07:08:09.123Z")


@pytest.fixture(scope="module")
def patient(spark):
    return from_objects(spark, [PATIENT])


def shown(x: c.Coll):
    if x.ty.name == "Empty":
        return F.lit("[]")
    return F.to_json(F.transform(c.many(c.mapped(x, lambda v: c.to_text(v, x.ty), c.STRING)), lambda v: v))


def test_table(patient):
    with open(os.path.join(os.path.dirname(__file__), "expressions.txt")) as f:
        cases = [line.rstrip("\n").split(" => ") for line in f if line.strip() and not line.startswith("#")]
    wrong, compiled = [], []
    for text, want in cases:
        try:
            compiled.append((text, want, shown(ENGINE.compile(patient, text, kind="Patient"))))
        except PathError as e:
            if want != "!":
                wrong.append((text, want, str(e)))

    def run(part):
        try:
            row = patient.select(*[col.alias(f"c{i}") for i, (_, _, col) in enumerate(part)]).first()
        except Exception as e:
            if len(part) > 1:
                run(part[: len(part) // 2])
                run(part[len(part) // 2 :])
            elif part[0][1] != "!" or "PATH-RUNTIME" not in str(e):
                wrong.append((*part[0][:2], str(e)[:200]))
            return
        for (text, want, _), got in zip(part, row):
            expected = [] if want in ("{}", "") else want.split(" ; ")
            if json.loads(got) != expected:
                wrong.append((text, want, got))

    for i in range(0, len(compiled), 25):
        run(compiled[i : i + 25])
    assert not wrong


@pytest.mark.parametrize(
    ("text", "phase"),
    [("1..2", PathSyntaxError), ("'abc", PathSyntaxError), ("a.(b)", PathSyntaxError), ("'\\q'", PathSyntaxError), ("/* x", PathSyntaxError), ("(a)(b)", PathSyntaxError), ("(" * 600, PathSyntaxError), ("1 + true", PathTypeError), ("nope()", PathTypeError), ("%x", PathTypeError), ("name.given.upper(1)", PathTypeError), ("'a'.slice('u', 'n')", PathRuntimeError), ("conformsTo('http://x')", PathRuntimeError), ("ofType(Nope)", PathTypeError)],
)
def test_phases(patient, text, phase):
    with pytest.raises(phase):
        ENGINE.compile(patient, text, kind="Patient")


OBS = [
    {"id": "a", "effectiveDateTime": "2016-03-28", "status": "final", "resourceType": "Observation", "valueQuantity": {"code": "[lb_av]", "value": 185.5}, "code": {"coding": [{"code": "c", "display": "x", "system": "s"}]}, "extension": [{"valueString": "e", "url": "u"}]},
    {"id": "b", "valueString": "high", "status": "final", "resourceType": "Observation", "code": {"coding": [{"code": "d", "system": "s"}]}},
    {"id": "c", "status": "amended", "resourceType": "Observation", "code": {"coding": []}},
]


def test_choices_and_units(spark):
    df = from_objects(spark, OBS)
    e = ENGINE
    got = {
        r.id: r
        for r in e.project(
            df,
            {
                "n": "value.exists()",
                "q": "value.ofType(Quantity).value",
                "s": "value.ofType(string)",
                "heavy": "value.ofType(Quantity) > 80 'kg'",
                "isq": "value is Quantity",
                "direct": "valueQuantity.exists()",
                "same": "code.coding ~ code.coding",
                "ext": "extension('u').value.ofType(string)",
                "when": "effective < @2016-04",
            },
            kind="Observation",
            keep=["id"],
        ).collect()
    }
    assert [got[i].n for i in "abc"] == [True, True, False]
    assert float(got["a"].q) == 185.5 and got["b"].q is None and got["b"].s == "high"
    assert got["a"].heavy is True and got["b"].heavy is None
    assert [got[i].isq for i in "abc"] == [True, False, None]
    assert not got["a"].direct and got["a"].same and got["a"].when is True
    assert [got[i].ext for i in "ab"] == ["e", None]


def test_extensions_of_primitives(spark):
    p = {"resourceType": "Patient", "id": "p", "birthDate": "1974", "_birthDate": {"id": "x", "extension": [{"url": "time", "valueDateTime": "1974-12-25T09:15:00+01:00"}]}, "name": [{"given": ["A"], "family": "B", "_given": [{"extension": [{"valueString": "s", "url": "n"}]}]}]}
    df = from_objects(spark, [p])
    e = ENGINE
    r = e.project(df, {"t": "birthDate.extension('time').value.hourOf()", "i": "birthDate.id", "n": "birthDate.extension.count()", "no": "birthDate.extension('z').exists()", "g": "name.given.extension('n').value", "kept": "birthDate.where($this.exists()).extension('time').empty()"}, kind="Patient").first()
    assert (r.t, r.i, r.n, r.no, r.g, r.kept) == (9, "x", 1, False, "s", True)


def test_repeat_of_values_reaches_its_fixpoint(spark):
    df = spark.createDataFrame([("Patient", "a")], "resourceType string, id string")
    run = lambda e: sorted(r.value for r in ENGINE.evaluate(df, e).collect())
    assert run("1.repeat(iif($this < 10, $this + 1, {}))") == list(range(2, 11))
    assert run("(1 | 5).repeat(iif($this < 7, $this + 2, {}))") == [3, 5, 7]
    assert run("'a'.repeat(iif($this.length() < 5, $this & 'b', {}))") == ["ab", "abb", "abbb", "abbbb"]
    assert run("1.repeat(($this + 1) mod 4)") == [0, 1, 2, 3]
    with pytest.raises(Exception, match="PATH-RUNTIME"):
        run("1.repeat($this + 1)")


def test_questionnaire_repeat(spark):
    node = lambda link, *inner: {"linkId": link} | ({"item": list(inner)} if inner else {})
    q = {"resourceType": "Questionnaire", "id": "q"} | node("0", node("1", node("1.1", node("1.1.1")), node("1.2")), node("2"))
    df = from_objects(spark, [q])
    got = [r.value for r in ENGINE.evaluate(df, "Questionnaire.repeat(item).linkId").collect()]
    assert sorted(got) == ["1", "1.1", "1.1.1", "1.2", "2"]
    uneven = {"resourceType": "Questionnaire", "id": "u", "item": [{"linkId": "1", "text": "only top", "item": [{"linkId": "2", "item": [{"linkId": "3"}]}]}]}
    df = from_objects(spark, [uneven])
    assert [r.value for r in ENGINE.evaluate(df, "Questionnaire.repeat(item).text").collect()] == ["only top"]
    assert [r.value for r in ENGINE.evaluate(df, "Questionnaire.repeat(item).where(item.exists()).count()").collect()] == [2]
    assert sorted(r.value for r in ENGINE.evaluate(df, "Questionnaire.repeat(item).linkId").collect()) == ["1", "2", "3"]


def test_bundle_and_resolve(spark):
    from pathloom.sources.resources import bundle_entries

    b = {"resourceType": "Bundle", "id": "b", "entry": [{"fullUrl": "urn:1", "resource": {"resourceType": "Patient", "id": "p", "gender": "male"}}, {"fullUrl": "urn:2", "resource": {"resourceType": "Observation", "id": "o", "subject": {"reference": "Patient/p"}}}]}
    df = from_objects(spark, [b])
    got = ENGINE.evaluate(df, "entry.resource.ofType(Observation).subject.resolve().ofType(Patient).id", kind="Bundle").collect()
    assert [r.value for r in got] == ["p"]
    assert {r.id for r in bundle_entries(df).collect()} == {"p", "o"}
    # a path that begins with another type looks into the entries
    assert [r.value for r in ENGINE.evaluate(df, "Patient.gender").collect()] == ["male"]
    assert [r.value for r in ENGINE.evaluate(df, "Bundle.entry.count()").collect()] == [2]
    assert [r.id for r in ENGINE.filter(df, "Patient.gender = 'male'").collect()] == ["p"]
    assert [tuple(r) for r in ENGINE.project(df, {"who": "Observation.subject.reference"}, keep=["id"]).collect()] == [("o", "Patient/p")]


def test_schemaless(spark):
    from pathloom.sources.resources import schemaless

    df = schemaless(spark.createDataFrame([(1, '{"a": [{"b": 1}, {"b": [2, 3]}, {"c": null}]}'), (2, "{}")], "id int, value string"))
    got = {r.id: r for r in Engine().project(df, {"n": "value.a.b.count()", "x": {"path": "value.a.b.select(toInteger())", "collection": True}, "e": "value.z.empty()"}, keep=["id"]).collect()}
    assert (got[1].n, got[1].x, got[1].e) == (3, [1, 2, 3], True) and (got[2].n, got[2].x) == (0, [])


def test_narratives():
    from pathloom.functions.fhir import narrative_ok

    good = ["<div>x</div>", '<div lang="en"><p>a <b>b</b> &amp;</p></div>', "<div><img src='x'/></div>", "<div><!-- c -->t</div>"]
    bad = ["", "x", "<p>x</p>", "<div></div>", "<div><script>x</script></div>", '<div onclick="x">y</div>', "<div>x</div><div>y</div>", "<div><p>x</div></p>", "<div>&nbsp;</div>", "<div>x", '<div id="a" id="b">x</div>']
    assert all(map(narrative_ok, good)) and not any(map(narrative_ok, bad))
