from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.constraints import QueryError
from shelfwise.functions.expressions import column, evaluate
from shelfwise.operators.paging import Slice, window
from shelfwise.language import parse


@pytest.mark.parametrize(
    "text, value",
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("10 / 4", Decimal("2.5")), ("1 / 3", Decimal("0.3333333333333333")), ("2 / 3", Decimal("0.6666666666666667")), ("-7 % 3", -1), ("7 % -3", 1), ("-(3) + +4", 1),
        ("1 == 1.0", True), ("null == null", True), ("1 != 2 && !false", True), ("true ^ true", False), ("false || 2 > 1", True), ("null ?? 4", 4), ("$x ?? 4", 5), ("$m.a", 1), ("$m?.b", None), ("$n?.b", None),
        ("abs(-2.5)", Decimal("2.5")), ("ceil(1.2)", 2), ("floor(-1.2)", -2), ("round(123)", 100), ("round(0.0157)", Decimal("0.02")), ("sqrt(2)", Decimal("1.414213562373095")), ("pow(2, 10)", 1024), ("max(2, 3)", 3), ("min(2, 3)", 2), ("log(1)", 0),
        ("$xs.size()", 3), ("$xs.any(item > 2)", True), ("$xs.all(item > 2)", False), ("$xs.none(item > 9)", True), ("$xs[1]", 2), ("$m['a']", 1), ("'5' == 5", True), ("$xs.*[item * 2]", [2, 4, 6]), ("$ys.*![item]", [1]), ("$ys *? 0", [1, 0]), ("$m.entries.size()", 1),
    ],
)
def test_evaluate(text, value):
    variables = {"x": 5, "m": {"a": 1}, "n": None, "xs": [1, 2, 3], "ys": [1, None]}
    assert evaluate(text, variables) == value


@pytest.mark.parametrize("text", ["1 +", "foo(1)", "max(1)", "$unknown", "(1", "1 1", "true + 1", "$n.b"])
def test_errors(text):
    with pytest.raises(QueryError):
        evaluate(text, {"n": None})


def test_columns_agree_with_the_driver(spark):
    texts = ["$a + 2 * $b", "$a % 3", "abs($b - 20)", "$a >= $b || $a == 7", "max($a, $b)", "round($a)", "floor($b / 4)", "!($a > 5)", "$c ?? 9", "$c == null", "$xs.size()", "$xs.any(item > $a)"]
    df = spark.createDataFrame([(7, 10, None, [1, 2]), (123, 4, 3, [200])], "a int, b int, c int, xs array<int>")
    got = df.select(*(column(t, {k: F.col(k) for k in df.columns}).alias(f"x{i}") for i, t in enumerate(texts))).collect()
    for r, source in zip(got, df.collect()):
        for value, t in zip(r, texts):
            want = evaluate(t, source.asDict())
            assert float(value) == float(want) if not isinstance(want, bool) else value == want, t


@pytest.mark.parametrize(
    "text, total, want",
    [("page(1, 10)", 95, (0, 10)), ("page(10, 10)", 95, (90, 10)), ("page(11, 10)", 95, (0, 10)), ("page()", 5, (0, 20)), ("strip(5, 3)", 9, (5, 3)), ("strip(9, 3)", 9, (0, 3)), ("page(2, 10, spacing(gap(2, '$pageNumber == 1')))", 95, (8, 10)), ("page(2, 10, spacing(gap(20, '$pageNumber == 2')))", 95, (10, 0))],
)
def test_slices(text, total, want):
    assert window(parse(text), total) == Slice(*want)


def test_both_forms_divide_alike(spark):
    """Sixteen places, half up, of large and of fractional operands."""
    cases = [("1", "3"), ("2", "3"), ("123456789012345", "7"), ("-5", "8"), ("1234567.25", "0.125"), ("0.000001", "3"), ("10", "-6")]
    row = {"x": F.col("x"), "y": F.col("y")}
    for a, b in cases:
        df = spark.createDataFrame([(Decimal(a), Decimal(b))], "x decimal(21,6), y decimal(21,6)")
        assert df.select(column("$x / $y", row)).first()[0] == evaluate("$x / $y", {"x": Decimal(a), "y": Decimal(b)})
    assert spark.range(7, 8).select(column("$x / 7", {"x": F.col("id")})).first()[0] == 1
