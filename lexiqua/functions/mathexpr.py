"""Arithmetic expressions compiled to Columns, and units.

An expression is parsed to a syntax tree on the driver and each node becomes a Column; anything but arithmetic on numbers and
named values is refused. Nothing is ever evaluated as Python.
"""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiqua.functions import units

#: Limits of an expression.
MOST_CHARS, MOST_STEPS = 500, 50
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Pow: F.pow, ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b)), ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b))}
_FUNCTIONS = {"sqrt": F.sqrt, "abs": F.abs, "exp": F.exp, "ln": F.log, "log": F.log, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil}
_CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}
#: Unit, dimension, factor to the base unit, and what is added after it.
UNITS = {
    "m": ("length", 1.0, 0.0), "km": ("length", 1000.0, 0.0), "cm": ("length", 0.01, 0.0), "mm": ("length", 0.001, 0.0), "mile": ("length", 1609.344, 0.0), "yard": ("length", 0.9144, 0.0), "foot": ("length", 0.3048, 0.0), "inch": ("length", 0.0254, 0.0),
    "s": ("time", 1.0, 0.0), "min": ("time", 60.0, 0.0), "hour": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 0.001, 0.0), "lb": ("mass", 0.45359237, 0.0), "ounce": ("mass", 0.028349523125, 0.0),
    "m/s": ("speed", 1.0, 0.0), "km/h": ("speed", 1000.0 / 3600.0, 0.0), "mph": ("speed", 0.44704, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0),
    "J": ("energy", 1.0, 0.0), "kJ": ("energy", 1000.0, 0.0), "cal": ("energy", 4.184, 0.0), "L": ("volume", 0.001, 0.0), "m**3": ("volume", 1.0, 0.0), "gallon": ("volume", 0.003785411784, 0.0),
}


class ExpressionError(ValueError):
    """An expression that isn't plain arithmetic, or a unit that can't be converted."""


def compile_expression(expression: str, values: dict[str, Column]) -> Column:
    """``expression`` over named Columns. ``^`` is a power; division by zero is null."""
    if len(expression) > MOST_CHARS:
        raise ExpressionError(f"more than {MOST_CHARS} characters")
    try:
        tree = ast.parse(expression.replace("^", "**").strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {expression}") from e

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name) if name in values:
                return values[name].cast("double")
            case ast.Name(id=name) if name in _CONSTANTS:
                return F.lit(_CONSTANTS[name])
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](build(a), build(b))
            case ast.Call(func=ast.Name(id=name), args=[x], keywords=[]) if name in _FUNCTIONS:
                return _FUNCTIONS[name](build(x))
        raise ExpressionError(f"not arithmetic: {ast.unparse(node)}")

    return build(tree)


def convert(value: Column, from_unit: str, to_unit: str) -> Column:
    """``value`` in another unit. Common units are factors of the plan; any others (see ``units``) are read there, and are null if they don't convert."""
    if from_unit not in UNITS or to_unit not in UNITS:
        return units.convert(value, F.lit(from_unit), F.lit(to_unit))["result"]
    (kind, factor, more), (other, divisor, less) = UNITS[from_unit], UNITS[to_unit]
    if kind != other:
        raise ExpressionError(f"{from_unit} is a {kind}, {to_unit} a {other}")
    return (value * factor + more - less) / divisor


def solve_steps(given: dict[str, Column], steps: list[dict]) -> dict[str, Column]:
    """Steps ``{expression, assign, from_unit?, to_unit?}`` in a row over named values; a step may use what earlier ones assign."""
    if len(steps) > MOST_STEPS:
        raise ExpressionError(f"more than {MOST_STEPS} steps")
    known = dict(given)
    for step in steps:
        value = compile_expression(step["expression"], known)
        if step.get("from_unit") and step.get("to_unit"):
            value = convert(value, step["from_unit"], step["to_unit"])
        known[step["assign"]] = value
    return known


def triangular(n: Column) -> Column:
    """1 + 2 + ... + n for whole n of 0 or more; an error otherwise."""
    return F.when((n >= 0) & (n == F.floor(n)), n * (n + 1) / 2).otherwise(F.raise_error(F.lit("n must be a whole number of 0 or more")).cast("double"))


#: The distinct expressions that formulas found in texts came to.
GENERATED = [
    "c**2*m", "-C*H**2 + CH", "turning", "down", "by", "C*H**2", "1000*cal", "x", "smelly", "n**4", "m/n", "kx", "c", "bladder", "aryl", "a*c", "a", "DeltaE", "Da", "CHCO - 2", "CF*t", "1418*dinars", "100*kg",
]


def names_of(expression: str) -> list[str]:
    """The names that an expression needs values for, in order of the alphabet."""
    return sorted({n.id for n in ast.walk(ast.parse(expression.replace("^", "**"), mode="eval")) if isinstance(n, ast.Name)} - set(_CONSTANTS) - set(_FUNCTIONS))


def shown(c: Column) -> Column:
    """A number to six digits, without zeros at the end; with an exponent below 0.0001 and from a million on."""
    c = c.cast("double")
    written = F.format_string("%.5e", c)
    mantissa, exponent = F.substring_index(written, "e", 1), F.substring_index(written, "e", -1).cast("int")
    bare = lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    plain = F.printf(F.concat(F.lit("%."), (F.lit(5) - F.when(exponent.between(-4, 5), exponent).otherwise(0)).cast("string"), F.lit("f")), c)
    return F.when(exponent.between(-4, 5), bare(plain)).otherwise(F.concat(bare(mantissa), F.lit("e"), F.substring_index(written, "e", -1)))


def _solved(given: dict[str, Column], steps: list[dict]) -> list[tuple[dict, Column]]:
    known = solve_steps(given, steps)
    return [(step, known[step["assign"]]) for step in steps]


def _unit(step: dict) -> str:
    return step.get("to_unit") or step.get("unit") or ""


def render_annotated(given: dict[str, Column], steps: list[dict]) -> Column:
    """A solution as a text: what is given, each step with its result, and the last result as the answer."""
    out = [F.lit("Given:")] + [F.concat(F.lit(f"  {k} = "), shown(v)) for k, v in given.items()] + [F.lit("Steps:")]
    solved = _solved(given, steps)
    for i, (step, value) in enumerate(solved, 1):
        told = F.concat(F.lit("    Result: "), shown(value), F.lit(f" {_unit(step)}".rstrip()))
        out += [F.lit(f"  {i}. {step.get('description', step['assign'])}"), F.lit(f"    Formula: {step['expression']}"), F.when(value.isNull(), "    Error: no value").otherwise(told)]
    step, value = solved[-1]
    return F.concat_ws("\n", *out, F.when(value.isNull(), "Answer: could not be determined").otherwise(F.concat(F.lit(f"Answer: {step['assign']} = "), shown(value), F.lit(f" {_unit(step)}".rstrip()))))


def render_json(given: dict[str, Column], steps: list[dict]) -> Column:
    """A solution as JSON: ``given``, ``steps`` (expression, result, unit) and ``answer``."""
    solved = _solved(given, steps)
    told = [F.struct(F.lit(s["expression"]).alias("expression"), F.lit(s["assign"]).alias("assign"), v.alias("result"), F.lit(_unit(s)).alias("unit")) for s, v in solved]
    return F.to_json(F.struct(F.struct(*(v.alias(k) for k, v in given.items())).alias("given"), F.array(*told).alias("steps"), solved[-1][1].alias("answer")))


def render_latex(given: dict[str, Column], steps: list[dict]) -> Column:
    """A solution as LaTeX: given values, numbered steps with their formula and result, the answer in bold."""
    out = [F.lit(r"\textbf{Given:}")] + [F.concat(F.lit(f"  ${k} = "), shown(v), F.lit("$")) for k, v in given.items()] + [F.lit(r"\textbf{Steps:}")]
    solved = _solved(given, steps)
    unit = lambda s: r"\,\text{" + _unit(s) + "}" if _unit(s) else ""
    for i, (step, value) in enumerate(solved, 1):
        out += [F.lit(f"  {i}. {step.get('description', step['assign'])}"), F.lit(f"  $${step['expression']}$$"), F.concat(F.lit("  $= "), shown(value), F.lit(f"{unit(step)}$"))]
    step, value = solved[-1]
    return F.concat_ws("\n", *out, F.concat(F.lit(r"\textbf{Answer:} $" + f"{step['assign']} = "), shown(value), F.lit(f"{unit(step)}$")))


def heat_balance(q: Column, w: Column) -> Column:
    """The change of inner energy: heat in less work done."""
    return q - w


def half_heat_balance(q: Column, w: Column) -> Column:
    return heat_balance(q, w) / 2


def curve(expression: str, name: str, start: Column, end: Column, points: int, values: dict[str, Column] | None = None) -> Column:
    """``points`` places from ``start`` to ``end``, evenly, as structs ``x`` and ``y``, the expression's value there."""
    at = F.sequence(F.lit(0), F.lit(points - 1))
    x = lambda i: start + (end - start) * i / float(max(1, points - 1))
    return F.transform(at, lambda i: F.struct(x(i).alias("x"), compile_expression(expression, {**(values or {}), name: x(i)}).alias("y")))
