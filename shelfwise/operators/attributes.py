"""Attribute and primary-key predicates as columns.

Under `not` every leaf is false, never null, for a missing value, so that it is a
complement. Elsewhere a leaf is left bare: a row is kept by a true value only, so
null is as good as false there, and a bare comparison reaches the scan.
Arrays match if any of their elements does. A literal that can't be taken in the
attribute's type makes the predicate false.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.catalog import Attribute
from shelfwise.constraints import Constraint, QueryError, Range


def converted(value: Any, type_: str) -> Any:
    """The literal in an attribute's type, or None if it has no such form."""
    try:
        if value is None:
            return None
        if type_ == "int":
            if isinstance(value, bool):
                return int(value)
            number = Decimal(str(value))
            return int(number) if number == number.to_integral_value() else number
        if type_ == "decimal":
            return Decimal(int(value)) if isinstance(value, bool) else Decimal(str(value))
        if type_ == "boolean":
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(value).lower())
        if type_ == "timestamp":
            return value if isinstance(value, datetime) else datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        if type_ == "date":
            return value.date() if isinstance(value, datetime) else value if isinstance(value, date) else date.fromisoformat(str(value))
        return str(value).lower() if isinstance(value, bool) else str(value)
    except (ValueError, InvalidOperation):
        return None


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def within(struct: Column, low: Any, high: Any) -> Column:
    """A range struct overlaps [low, high]; null bounds are open."""
    out = struct.isNotNull()
    if high is not None:
        out &= struct["from"].isNull() | (struct["from"] <= F.lit(high))
    if low is not None:
        out &= struct["to"].isNull() | (struct["to"] >= F.lit(low))
    return out


def _compared(attribute: Attribute, value: Any, how: Callable[[Column, Column], Column]) -> Callable[[Column], Column] | None:
    if attribute.range:
        # Lower bounds first, then upper ones; open ones are the least and the greatest.
        low, high = (value.low, value.high) if isinstance(value, Range) else (value, value)
        lo, hi = converted(low, attribute.type), converted(high, attribute.type)

        def key(f: Column, t: Column) -> Column:
            return F.struct(F.when(f.isNull(), 0).otherwise(1), f, F.when(t.isNull(), 1).otherwise(0), t)

        return lambda x: x.isNotNull() & how(key(x["from"], x["to"]), key(F.lit(lo).cast(_SQL[attribute.type]), F.lit(hi).cast(_SQL[attribute.type])))
    v = converted(value, attribute.type)
    return None if v is None else lambda x: how(x, F.lit(v))


_SQL = {"int": "int", "decimal": "decimal(20,4)", "string": "string", "timestamp": "timestamp", "date": "date", "boolean": "boolean"}

_TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "attributeEquals": lambda a, b: a == b,
    "attributeGreaterThan": lambda a, b: a > b,
    "attributeGreaterThanEquals": lambda a, b: a >= b,
    "attributeLessThan": lambda a, b: a < b,
    "attributeLessThanEquals": lambda a, b: a <= b,
    "attributeContains": lambda a, b: a.contains(b),
    "attributeStartsWith": lambda a, b: a.startswith(b),
    "attributeEndsWith": lambda a, b: a.endswith(b),
}


def attribute_test(c: Constraint, attribute: Attribute, col: Column, moment: Callable[[Any], Any], sure: bool = True) -> Column:
    """The predicate of an attribute constraint on a column; `sure` makes it two-valued."""
    name, values = c.values[0], c.values[1:]
    if not attribute.filterable and c.name != "attributeIs":
        raise QueryError(f"attribute {name} is not filterable")
    if c.name == "attributeIs":
        if values[0] not in ("NULL", "NOT_NULL"):
            raise QueryError(f"attributeIs knows NULL and NOT_NULL, not {values[0]}")
        return col.isNull() if values[0] == "NULL" else col.isNotNull()
    if c.name in ("attributeContains", "attributeStartsWith", "attributeEndsWith") and attribute.type != "string":
        raise QueryError(f"{c.name} needs a string attribute; {name} is not one")

    if c.name in _TESTS:
        test = _compared(attribute, values[0], _TESTS[c.name])
    elif c.name == "attributeBetween":
        lo, hi = (converted(v, attribute.type) for v in values[:2])
        if any(v is not None and k is None for v, k in zip(values, (lo, hi))):
            test = None
        elif attribute.range:
            test = lambda x: within(x, lo, hi)
        else:
            test = lambda x: _all([x >= F.lit(lo)] * (lo is not None) + [x <= F.lit(hi)] * (hi is not None))
    elif c.name == "attributeInSet":
        kept = [k for k in (converted(v, attribute.type) for v in values) if k is not None]
        if attribute.range:
            tests = [_compared(attribute, v, _TESTS["attributeEquals"]) for v in values]
            test = lambda x: _any([t(x) for t in tests])
        else:
            test = (lambda x: x.isin(*kept)) if kept else None
    elif c.name == "attributeInRange":
        v = converted(moment(values[0]), attribute.type)
        if not attribute.range:
            raise QueryError(f"attributeInRange needs a range attribute; {name} is not one")
        test = None if v is None else lambda x: within(x, v, v)
    else:
        raise QueryError(f"unknown attribute constraint {c.name}")
    if test is None:
        return F.lit(False)
    out = F.exists(col, lambda x: _sure(test(x))) if attribute.array else test(col)
    return _sure(out) if sure else out


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | _sure(c)
    return out


def key_test(c: Constraint, pk: Column) -> Column:
    v = c.values
    if c.name == "entityPrimaryKeyInSet":
        return pk.isin(*v) if v else F.lit(False)
    if c.name == "entityPrimaryKeyBetween":
        return _all([pk >= v[0]] * (v[0] is not None) + [pk <= v[1]] * (v[1] is not None))
    return {"entityPrimaryKeyGreaterThan": pk > v[0], "entityPrimaryKeyGreaterThanEquals": pk >= v[0], "entityPrimaryKeyLessThan": pk < v[0], "entityPrimaryKeyLessThanEquals": pk <= v[0]}[c.name]
