import math

import pytest

from treesum.sources import design
from treesum.sources.formula import DesignError, parse, term_name

COLUMNS = ["y", "a", "b", "c", "g", "odd name"]


def terms(right):
    return [term_name(t) for t in parse(f"y ~ {right}", COLUMNS).terms]


@pytest.mark.parametrize(
    ("right", "want"),
    [
        ("a + b", ["a", "b"]), ("a:b", ["a:b"]), ("a*b", ["a", "b", "a:b"]), ("b:a + a + a:b", ["a", "b:a"]), ("(a + b + c)^2", ["a", "b", "c", "a:b", "a:c", "b:c"]),
        ("(a + b)^2 - a:b", ["a", "b"]), ("a/b", ["a", "a:b"]), (". - g - `odd name`", ["a", "b", "c"]), ("a*b*c - a:b:c", ["a", "b", "c", "a:b", "a:c", "b:c"]),
        ("log(a) + I(b^2) - 1", ["log(a)", "I(b^2)"]), ("0 + a", ["a"]), ("`odd name` + factor(c):a", ["`odd name`", "factor(c):a"]), ("pmax(a, b, 2.5) + I(a/(b + 1))", ["pmax(a, b, 2.5)", "I(a / (b + 1))"]),
        ("a + offset(b) + a:a", ["a"]), ("(a + b):c", ["a:c", "b:c"]), ("a**1 - b + c", ["a", "c"]),
    ],
)
def test_terms(right, want):
    assert terms(right) == want


@pytest.mark.parametrize("bad", ["", "1", "a +", "a b", "a %in% b", "nothing", "foo(a)", "log(a, b)", "a:(b", "a^b", "a^0", "2", "log()", "a ~ b", "I(a:b)", "a,b", "log(nothing)", "poly(a, 2)", "a + -b", "a $ b"])
def test_what_cannot_be_read_raises(bad):
    with pytest.raises(DesignError):
        parse(f"y ~ {bad}", COLUMNS)


def test_frame(spark):
    rows = [(i, float(i), float(i % 3), 2.0, "uvw"[i % 3], 7.0) for i in range(1, 13)] + [(13, None, 1.0, 2.0, "u", 1.0), (14, 1.0, None, 2.0, "u", 1.0), (15, 1.0, 1.0, 2.0, None, 1.0)]
    d = spark.createDataFrame(rows, "id long, y double, a double, k double, g string, o double")
    f, made = design.formula_frame(d, "log(y) ~ a*g + I(a^2 + k) + log(k) + k:g + offset(o)", "id")
    # constant: log(k)
    assert made.names == ["a", "g.u", "g.v", "g.w", "I(a^2 + k)", "a:g.v", "a:g.w", "k:g.u", "k:g.v", "k:g.w"]
    got = {r["row_id"]: r for r in f.collect()}
    assert sorted(got) == list(range(1, 13))
    for i, r in got.items():
        a, g = i % 3, "uvw"[i % 3]
        assert abs(r["y"] - math.log(i)) < 1e-12 and r["offset"] == 7.0
        assert r["x"] == [a, *(float(g == v) for v in "uvw"), a * a + 2.0, a * (g == "v"), a * (g == "w"), *(2.0 * (g == v) for v in "uvw")]
    # frozen: other rows, other levels
    other = spark.createDataFrame([(1, 5.0, 4.0, 3.0, "z", 0.0)], d.schema)
    assert made.matrix(other, "id").first()[1:] == (4.0, 0.0, 0.0, 0.0, 19.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert design.split_probabilities(made, {"a:g": 3, ".default": 1})[5] == 3 / 14
    two = design.resolve(d.where("g <> 'w'"), ["a:g"])
    assert two.names == ["a:g.v"]


def test_quoted_names(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], ["id", "y", "odd name"])
    f, made = design.formula_frame(d, "y ~ `odd name` + I(`odd name` * 2)", "id")
    assert [r["x"] for r in f.orderBy("row_id").collect()] == [[3.0, 6.0], [5.0, 10.0]]
    assert made.names[0] == "odd name"
