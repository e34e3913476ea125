"""Arithmetic in a column: each row's expression is read and computed in its row, by Columns alone.

An expression is cut into tokens; a fold over them orders operators by precedence into postfix (a stack of waiting operators, kept
as an array); a second fold computes the postfix on a stack of values. Rows may hold different expressions: there is one
projection for all, no Python worker and nothing on the driver.

Grammar: numbers (``12``, ``.5``, ``1e-3``), names, ``+ - * / % // ^ **``, parentheses, signs and calls of one argument. A power
groups to the right and binds closer than a sign before it, so ``-2^2`` is -4 and ``2^-1`` is 0.5; all else groups to the left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the longest expression, in characters.
MOST_CHARS = 500
#: A call is one token, its name with the bracket, so a name and a call are told apart; what matches nothing else is no arithmetic.
TOKEN = r"[A-Za-z_][A-Za-z_0-9]*[ \t]*\(|[A-Za-z_][A-Za-z_0-9]*|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|\*\*|//|\S"
#: Waiting operators are written with their precedence in front: a bracket 0, sums 1, products 2, signs 3, powers 4.
BINARY = {"+": "1+", "-": "1-", "*": "2*", "/": "2/", "%": "2%", "//": "2|", "^": "4^", "**": "4^"}
SIGNS = {"+": "3+", "-": "3-"}
OPEN = "0("
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt, "abs": F.abs, "exp": F.exp, "ln": F.ln, "log": F.ln, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "sign": F.signum,
}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}
_TEXTS = "array<string>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; Catalyst computes an expression as often as it is written."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def tokens(c: Column) -> Column:
    """The tokens of an expression, in order; white space parts them and goes."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def postfix(c: Column) -> Column:
    """An expression in postfix, as an array: numbers and names as they stand, operators with their precedence, calls as ``name(``.

    Null if it is no expression: operands and operators out of place, brackets that don't match, other characters, nothing at all, or
    more than ``MOST_CHARS`` characters.
    """
    state = lambda out, waiting, operand, fine: F.struct(out.alias("out"), waiting.alias("waiting"), operand.alias("operand"), fine.alias("fine"))
    none, yes, no = F.array().cast(_TEXTS), F.lit(True), F.lit(False)

    def step(acc: Column, t: Column) -> Column:
        out, waiting, operand = acc["out"], acc["waiting"], acc["operand"]

        def told(depth: Column) -> Column:
            """``depth``: waiting operators above the last open bracket, and it (0: no bracket is open)."""
            above = F.when(depth > 0, depth - 1).otherwise(F.size(waiting))
            upper, lower = F.slice(waiting, F.size(waiting) - above + 1, above), F.slice(waiting, 1, F.size(waiting) - above)

            def closed(rest: Column) -> Column:
                """Below a closed bracket: a call goes out with it."""
                last = F.try_element_at(rest, F.lit(-1))
                called = F.coalesce(F.endswith(last, F.lit("(")) & (last != OPEN), no)
                return state(F.concat(out, F.reverse(upper), F.when(called, F.slice(rest, -1, 1)).otherwise(none)), F.when(called, F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest), no, acc["fine"])

            op = _mapped(t, BINARY)
            going = F.when(op == "4^", none).otherwise(F.filter(upper, lambda w: F.substring(w, 1, 1) >= F.substring(op, 1, 1)))
            binary = state(F.concat(out, F.reverse(going)), F.concat(lower, F.when(op == "4^", upper).otherwise(F.filter(upper, lambda w: F.substring(w, 1, 1) < F.substring(op, 1, 1))), F.array(op)), yes, acc["fine"])
            failed = state(none, none, no, no)
            return (
                F.when(~acc["fine"], acc)
                .when(operand & t.rlike(r"^[A-Za-z_].*\($"), state(out, F.concat(waiting, F.array(F.concat(F.lit("9"), F.regexp_replace(t, r"[ \t]", "")), F.lit(OPEN))), yes, yes))
                .when(operand & t.rlike(r"^[A-Za-z_0-9.]") & (t != "."), state(F.concat(out, F.array(t)), waiting, no, yes))
                .when(operand & (t == "("), state(out, F.concat(waiting, F.array(F.lit(OPEN))), yes, yes))
                .when(operand & t.isin(*SIGNS), state(out, F.concat(waiting, F.array(_mapped(t, SIGNS))), yes, yes))
                .when(~operand & t.isin(*BINARY), binary)
                .when(~operand & (t == ")") & (depth > 0), _bound(F.slice(lower, 1, F.size(lower) - 1), closed))
                .otherwise(failed)
            )

        return _bound(F.array_position(F.reverse(waiting), OPEN).cast("int"), told)

    def finished(end: Column) -> Column:
        fine = end["fine"] & ~end["operand"] & ~F.array_contains(end["waiting"], OPEN)
        return F.when(fine, F.concat(end["out"], F.reverse(end["waiting"])))

    return F.when(F.length(c) <= MOST_CHARS, F.aggregate(tokens(c), state(none, none, yes, yes), step, finished))


def evaluate(c: Column, values: dict[str, Column] | None = None) -> Column:
    """The value of each row's expression as a double.

    ``values`` are what names stand for, Columns of the same row; ``pi`` and ``e`` are known. Null for what is no expression (see
    ``postfix``), unknown names and functions, null values, and results that are no finite number (division by zero, the root of a negative number).
    """
    known = {k: F.lit(v) for k, v in CONSTANTS.items()} | {k: v.cast("double") for k, v in (values or {}).items()}

    def operand(t: Column) -> Column:
        found = F.when(t.rlike("^[0-9.]"), t.try_cast("double"))
        for name, value in known.items():
            found = found.when(t == name, value)
        return found

    def called(t: Column, x: Column) -> Column:
        found = F.when(t == "3-", -x).when(t == "3+", x)
        for name, f in FUNCTIONS.items():
            found = found.when(t == f"9{name}(", f(x))
        return found

    def applied(t: Column, a: Column, b: Column) -> Column:
        # The remainder is exact and has the sign of the divisor; the whole quotient is what is left without it.
        rest = F.when(b != 0, a % b)
        rest = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
        whole = F.floor(F.try_divide(a - rest, b) + 0.5).cast("double")
        return F.when(t == "1+", a + b).when(t == "1-", a - b).when(t == "2*", a * b).when(t == "2/", F.try_divide(a, b)).when(t == "4^", F.pow(a, b)).when(t == "2|", whole).when(t == "2%", rest)

    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        top, under = F.get(stack, n - 1), F.get(stack, n - 2)
        two, one = t.isin(*set(BINARY.values())), t.isin(*SIGNS.values()) | t.rlike(r"^9.*\($")
        return (
            F.when(two, F.concat(F.slice(stack, 1, n - 2), F.array(applied(t, under, top))))
            .when(one, F.concat(F.slice(stack, 1, n - 1), F.array(called(t, top))))
            .otherwise(F.concat(stack, F.array(operand(t))))
        )

    value = F.aggregate(postfix(c), F.array().cast("array<double>"), step, lambda stack: F.get(stack, F.lit(0)))
    return _bound(value, lambda x: F.when((F.abs(x) < float("inf")) & ~F.isnan(x), x))
