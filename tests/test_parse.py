import pytest

from rowlens.errors import DiffError
from rowlens.functions import where
from rowlens.functions.mask import token
from rowlens.operators.infer import score
from rowlens.plans.options import Bound, Options, allowed, parse_budget, parse_tolerance
from rowlens.plans.schema import Column, check_renames, compare
from rowlens.plans.types import Domain, Kind, domain_of
from rowlens.sources import formats, lake, remote


@pytest.mark.parametrize("spec, want", [
    ("a = 1", [("a", "=", "1")]), ("a==1 and b<>'x and y'", [("a", "=", "1"), ("b", "!=", "x and y")]), ("a >= -2.5", [("a", ">=", "-2.5")]),
    ("name = 'it''s'", [("name", "=", "it's")]), ("a is null AND b IS NOT NULL", [("a", "null", ""), ("b", "not null", "")]), ("'odd col' < 3", [("odd col", "<", "3")]),
])
def test_where_grammar(spec, want):
    assert [(p.column, p.op, p.literal) for p in where.parse(spec)] == want


@pytest.mark.parametrize("spec", ["", "a", "a =", "= 1", "a = 1 and", "a = 1 or b = 2", "a = 'x", "a is", "a < > 1"])
def test_where_refused(spec):
    with pytest.raises(DiffError):
        where.parse([spec])


def test_tolerance_specs():
    assert parse_tolerance("0.01").default == Bound(0.01, 0)
    assert parse_tolerance("0.01,rel=1e-6").default == Bound(0.01, 1e-6)
    assert parse_tolerance(["price=0.5,rel=0.1", "abs=1"]).columns == {"price": Bound(0.5, 0.1)}
    for bad in ("-1", "nan", "inf", "0", "x", "rel=", "abs=1,abs=2", "c=foo=1"):
        with pytest.raises(DiffError):
            parse_tolerance(bad)


def test_budget():
    assert allowed(parse_budget("0.5%"), 1000, 1999) == 9
    assert allowed(parse_budget("100"), 1, 1) == 100
    for bad in ("-1", "x", "5 %%", ""):
        with pytest.raises(DiffError):
            parse_budget(bad)


@pytest.mark.parametrize("kw", [
    {"on_dup": "x"}, {"mode": "x"}, {"timestamp_precision": "min"}, {"summary": True, "tolerance": "1"}, {"summary": True, "output": "a.csv"}, {"output": "a.xls"},
    {"keyless": True, "key": ["a"]}, {"keyless": True, "tolerance": "1"}, {"keyless": True, "on_dup": "warn"}, {"keyless": True, "mode": "stream"}, {"max_diff": "many"},
])
def test_refusals(kw):
    with pytest.raises(DiffError):
        Options(**kw).check()


def test_domains():
    assert domain_of(Kind.INT, Kind.FLOAT) is Domain.FLOAT
    assert domain_of(Kind.STRING, Kind.BYTES) is Domain.BYTES
    assert domain_of(Kind.DATE, Kind.TIMESTAMP) is None


def test_schema_diff():
    c = lambda n, k, null=True: Column(n, k, null)
    d = compare([c("a", Kind.INT), c("b", Kind.STRING), c("c", Kind.DATE), c("x", Kind.INT)], [c("x", Kind.INT, False), c("c", Kind.TIMESTAMP), c("a", Kind.FLOAT), c("A", Kind.INT)])
    assert [x["name"] for x in d.added_columns] == ["A"] and [x["name"] for x in d.removed_columns] == ["b"]
    assert [(x["column"], x["comparable"]) for x in d.type_changes] == [("a", True), ("c", False)]
    assert [x["column"] for x in d.nullability_changes] == ["x"] and [a.name for a, _, _ in d.common] == ["a", "x"] and not d.same


def test_renames():
    assert check_renames(["a", "b"], ["x", "b"], {"x": "a", "b": "b"}) == {"x": "a"}
    for bad in ({"q": "a"}, {"x": "q"}, {"x": "b"}):
        with pytest.raises(DiffError):
            check_renames(["a", "b"], ["x", "b"], bad)


def test_small_things():
    assert token("42").startswith("xxh:") and len(token("42")) == 12 and token(None) is None
    assert (score("id", Kind.INT), score("order_id", Kind.STRING), score("n", Kind.FLOAT)) == (110, 55, 0)
    assert [formats.extension(x) for x in ("a.csv.gz", "b.parquet", "c.parquet.gz", "d.JSONL", "e.xls")] == [".csv", ".parquet", "", ".jsonl", ""]
    assert remote.s3a("s3://b/k") == "s3a://b/k"
    assert formats.delimiter_of("tab", ",") == "\t"
    with pytest.raises(DiffError):
        formats.delimiter_of("ab", ",")
    with pytest.raises(DiffError):
        lake.z85("abc")
