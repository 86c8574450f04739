"""The scalar expression language: one parser, two back ends.

`evaluate` computes a value on the driver, from variables and with decimal
arithmetic (page gaps); `column` gives a Spark Column over bound columns
(conditional facets, histogram values).

Precedence, loosest first:  ??  ||  ^  &&  == !=  > >= < <=  + -  * / %  unary.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Mapping
from decimal import ROUND_CEILING, ROUND_FLOOR, ROUND_HALF_UP, Context, Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.constraints import QueryError

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<var>\$[A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)|(?P<sign>\?\*\?|\*\?|\?\?|\?\.|\.\*!?\[|\|\||&&|==|!=|>=|<=|[-+*/%<>!^().,\[\]]))""")
#: Binary operators by level, loosest first.
_LEVELS = (("??", "*?", "?*?"), ("||",), ("^",), ("&&",), ("==", "!="), (">", ">=", "<", "<="), ("+", "-"), ("*", "/", "%"))
DECIMAL64 = Context(prec=16, rounding=ROUND_HALF_UP)
#: More digits than operands and results have.
_WIDE = Context(prec=60)


class Expression(tuple):
    """(operator, operands...)."""


def parse(text: str) -> Expression:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read the expression at {text[at:at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    pos = 0

    def peek() -> str:
        return tokens[pos][1] if tokens[pos][0] == "sign" else ""

    def take(expected: str = "") -> tuple[str, str]:
        nonlocal pos
        if expected and peek() != expected:
            raise QueryError(f"expected {expected}, found {tokens[pos][1] or 'the end'}")
        pos += 1
        return tokens[pos - 1]

    def binary(level: int) -> Expression:
        if level == len(_LEVELS):
            return unary()
        left = binary(level + 1)
        while peek() in _LEVELS[level] and peek():
            left = Expression((take()[1], left, binary(level + 1)))
        return left

    def unary() -> Expression:
        if peek() in ("-", "+", "!"):
            return Expression(("unary" + take()[1], unary()))
        return postfix(primary())

    def items(end: str) -> list[Expression]:
        out = []
        while peek() != end:
            out.append(binary(0))
            if peek() != end:
                take(",")
        take(end)
        return out

    def postfix(e: Expression) -> Expression:
        while peek() in (".", "?.", "[", ".*[", ".*![") and peek():
            sign = take()[1]
            if sign == "[":
                e = Expression(("item", e, binary(0)))
                take("]")
            elif sign in (".*[", ".*!["):
                e = Expression(("spread" if sign == ".*[" else "compact", e, binary(0)))
                take("]")
            else:
                kind, name = take()
                if kind != "name":
                    raise QueryError(f"expected a property, found {name}")
                if peek() == "(":
                    take()
                    e = Expression(("method", name, e, *items(")")))
                else:
                    e = Expression(("property" if sign == "." else "safe", e, name))
        return e

    def primary() -> Expression:
        kind, text = take()
        if kind == "number":
            return Expression(("value", Decimal(text)))
        if kind == "string":
            return Expression(("value", re.sub(r"\\(.)", r"\1", text[1:-1])))
        if kind == "var":
            return Expression(("var", text[1:]))
        if kind == "name":
            if peek() == "(":
                take()
                return Expression(("call", text, *items(")")))
            if text in ("true", "false", "null"):
                return Expression(("value", {"true": True, "false": False, "null": None}[text]))
            return Expression(("var", text))  # names inside a spread are the item's own
        if text == "(":
            e = binary(0)
            take(")")
            return e
        raise QueryError(f"unexpected {text or 'end'} in the expression")

    out = binary(0)
    if tokens[pos][0] != "end":
        raise QueryError(f"unexpected {tokens[pos][1]} after the expression")
    return out


def _number(x: Any) -> Decimal:
    if isinstance(x, bool) or x is None:
        raise QueryError(f"{x} is not a number")
    return x if isinstance(x, Decimal) else Decimal(str(x))


def _plain(x: Decimal) -> Decimal:
    """Without trailing zeros."""
    y = _WIDE.normalize(x)
    return y.quantize(Decimal(1), context=_WIDE) if y.as_tuple().exponent > 0 else y


def _divided(a: Decimal, b: Decimal) -> Decimal:
    """Scale 16, half up, trailing zeros dropped."""
    return _plain(_WIDE.divide(a, b).quantize(Decimal(1).scaleb(-16), rounding=ROUND_HALF_UP, context=_WIDE))


def _like(left: Any, right: Any) -> Any:
    """The right operand in the left one's type."""
    if isinstance(left, bool) or left is None or right is None:
        return right
    if isinstance(left, (int, Decimal)):
        return _number(right)
    return str(right) if isinstance(left, str) else right


#: One significant digit, half up: round(123) is 1E+2.
_ONE_DIGIT = Context(prec=1, rounding=ROUND_HALF_UP)
_CALLS: dict[str, tuple[tuple[int, ...], Callable]] = {
    "abs": ((1,), lambda x: abs(_number(x))),
    "ceil": ((1,), lambda x: _number(x).to_integral_value(ROUND_CEILING)),
    "floor": ((1,), lambda x: _number(x).to_integral_value(ROUND_FLOOR)),
    "round": ((1,), lambda x: _ONE_DIGIT.plus(_number(x))),
    "sqrt": ((1,), lambda x: DECIMAL64.sqrt(_number(x))),
    "log": ((1,), lambda x: DECIMAL64.ln(_number(x))),
    "pow": ((2,), lambda x, n: _number(x) ** int(_number(n))),
    "max": ((2,), lambda a, b: max(_number(a), _number(b))),
    "min": ((2,), lambda a, b: min(_number(a), _number(b))),
    "random": ((0, 1), lambda bound=None: Decimal(random.randrange(int(bound)) if bound is not None else random.getrandbits(63))),
}


def evaluate(e: Expression | str, variables: Mapping[str, Any]) -> Any:
    """The value on the driver; variables without the $."""
    if isinstance(e, str):
        e = parse(e)
    op, *args = e
    go = lambda x: evaluate(x, variables)
    if op == "value":
        return args[0]
    if op == "var":
        if args[0] not in variables:
            raise QueryError(f"unknown variable ${args[0]}")
        return variables[args[0]]
    if op == "call":
        name, *operands = args
        if name not in _CALLS or len(operands) not in _CALLS[name][0]:
            raise QueryError(f"unknown function {name} of {len(operands)} arguments")
        return _CALLS[name][1](*map(go, operands))
    if op == "method":
        name, items, *operands = args
        items = go(items)
        if name == "size":
            return Decimal(len(items))
        test = lambda x: bool(evaluate(operands[0], {**variables, **(x if isinstance(x, Mapping) else {}), "item": x}))
        if name in ("any", "all", "none"):
            return {"any": any, "all": all, "none": lambda xs: not any(xs)}[name](map(test, items))
        raise QueryError(f"unknown method {name}")
    if op in ("property", "safe"):
        of, name = go(args[0]), args[1]
        if of is None:
            if op == "safe":
                return None
            raise QueryError(f"{name} of null")
        if name == "entries" and isinstance(of, Mapping):
            return [{"key": k, "value": v} for k, v in of.items()]
        return of.get(name) if isinstance(of, Mapping) else getattr(of, {"from": "low", "to": "high"}.get(name, name))
    if op == "item":
        of, key = go(args[0]), go(args[1])
        return None if of is None else of.get(key) if isinstance(of, Mapping) else of[int(key)]
    if op in ("spread", "compact"):
        of = go(args[0]) or []
        out = [evaluate(args[1], {**variables, **(x if isinstance(x, Mapping) else {}), "item": x}) for x in of]
        return [x for x in out if x is not None] if op == "compact" else out
    if op == "unary-":
        return -_number(go(args[0]))
    if op == "unary+":
        return _number(go(args[0]))
    if op == "unary!":
        return not go(args[0])
    a, b = go(args[0]), go(args[1])
    if op == "??":
        return b if a is None else a
    if op in ("*?", "?*?"):
        if a is None:
            return None
        return {k: b if v is None else v for k, v in a.items()} if isinstance(a, Mapping) else [b if x is None else x for x in a]
    if op == "==":
        return a == _like(a, b)
    if op == "!=":
        return a != _like(a, b)
    if op in ("&&", "||", "^"):
        return {"&&": a and b, "||": a or b, "^": bool(a) != bool(b)}[op]
    if op in (">", ">=", "<", "<="):
        b = _like(a, b)
        return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    a, b = _number(a), _number(b)
    if op == "/":
        return _divided(a, b)
    if op == "%":
        return a - b * (a / b).to_integral_value("ROUND_DOWN")
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _one_digit(x: Column) -> Column:
    """round(): one significant digit, half up."""
    scale = F.floor(F.log10(F.abs(x).cast("double")))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x.cast("double") / F.pow(F.lit(10.0), scale)) * F.pow(F.lit(10.0), scale))


def _quotient(a: Column, b: Column) -> Column:
    """Scale 16, half up, as on the driver.

    Both operands are brought to whole numbers, of 22 and 15 digits at most, whose
    quotient Spark keeps to exactly 16 places: whole operands as they are, others
    times 10^6.
    """
    x, y = a.cast("decimal(28,6)"), b.cast("decimal(21,6)")
    whole = (x == F.floor(x)) & (y == F.floor(y))
    scaled = lambda v, digits: F.when(whole, v).otherwise(v * F.lit(1_000_000).cast("decimal(7,0)")).cast(f"decimal({digits},0)")
    return scaled(x, 22) / scaled(y, 15)


_NATIVE: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": _one_digit, "sqrt": lambda x: F.sqrt(x.cast("double")), "log": lambda x: F.ln(x.cast("double")),
    "pow": lambda x, n: F.pow(x.cast("double"), n), "max": F.greatest, "min": F.least,
    "random": lambda bound=None: F.floor(F.rand() * (bound if bound is not None else F.lit(2.0**63))),
}


def column(e: Expression | str, variables: Mapping[str, Column | Mapping]) -> Column:
    """The expression over columns; a variable is a Column or a tree of them by property name."""
    if isinstance(e, str):
        e = parse(e)
    out = _column(e, variables)
    if isinstance(out, Mapping):
        raise QueryError("the expression is an object, not a value")
    return out


def _column(e: Expression, variables: Mapping) -> Any:
    op, *args = e
    go = lambda x: _column(x, variables)
    if op == "value":
        v = args[0]
        if isinstance(v, Decimal):
            return F.lit(int(v)) if v == v.to_integral_value() else F.lit(v)
        return F.lit(v)
    if op == "var":
        if args[0] not in variables:
            raise QueryError(f"unknown variable ${args[0]}")
        return variables[args[0]]
    if op == "call":
        if args[0] not in _NATIVE:
            raise QueryError(f"unknown function {args[0]}")
        return _NATIVE[args[0]](*map(go, args[1:]))
    if op == "method":
        name, items, *operands = args
        xs = go(items)
        if name == "size":
            return F.size(xs)
        test = lambda x: _column(operands[0], {**variables, "item": x})
        if name in ("any", "all", "none"):
            return {"any": lambda: F.exists(xs, test), "all": lambda: F.forall(xs, test), "none": lambda: ~F.exists(xs, test)}[name]()
        raise QueryError(f"unknown method {name}")
    if op in ("property", "safe"):
        of = go(args[0])
        if isinstance(of, Mapping):
            if args[1] not in of:
                raise QueryError(f"unknown property {args[1]}")
            return of[args[1]]
        return F.map_entries(of) if args[1] == "entries" else of.getField(args[1])
    if op == "item":
        of = go(args[0])
        if isinstance(of, Mapping):
            if args[1][0] != "value" or args[1][1] not in of:
                raise QueryError(f"unknown element {args[1][-1]}")
            return of[args[1][1]]
        return of.getItem(int(args[1][1])) if args[1][0] == "value" and isinstance(args[1][1], Decimal) else of.getItem(args[1][1]) if args[1][0] == "value" else of[go(args[1])]
    if op in ("spread", "compact"):
        out = F.transform(go(args[0]), lambda x: _column(args[1], {**variables, "item": x}))
        return F.filter(out, lambda x: x.isNotNull()) if op == "compact" else out
    if op.startswith("unary"):
        x = go(args[0])
        return {"-": lambda: -x, "+": lambda: x, "!": lambda: ~x}[op[5]]()
    if op in ("*?", "?*?"):
        d = go(args[1])
        return F.transform(go(args[0]), lambda x: F.coalesce(x, d))
    a, b = go(args[0]), go(args[1])
    return {
        "??": lambda: F.coalesce(a, b), "==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), "&&": lambda: a & b, "||": lambda: a | b, "^": lambda: a != b,
        ">": lambda: a > b, ">=": lambda: a >= b, "<": lambda: a < b, "<=": lambda: a <= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b,
        "/": lambda: _quotient(a, b), "%": lambda: a % b,
    }[op]()
