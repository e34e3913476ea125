"""Unit algebra in a column: any unit text is read to exponents of base dimensions, a factor and an offset.

A text is a product of named units with prefixes, powers and brackets: ``kN*m/s**2``, ``kg m^2 / s^2``, ``miles per hour``. It goes
through the same tokens and precedence as arithmetic (``rowexpr``), and a fold over its postfix multiplies units. Two texts
convert if their exponents agree. All of it is Columns, so each row may have units of its own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiqua.functions import rowexpr

#: Base dimensions, in the order of all exponents below.
DIMENSIONS = ("length", "mass", "time", "current", "temperature", "substance", "luminosity")
#: Prefixes by sign and by name.
PREFIXES = {
    "Q": 1e30, "R": 1e27, "Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24,
}
LONG_PREFIXES = {"tera": 1e12, "giga": 1e9, "mega": 1e6, "kilo": 1e3, "hecto": 1e2, "deca": 1e1, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12}
#: Units that take prefixes; exponents of the base dimensions and the factor to base units.
PREFIXED = {
    "m": ((1, 0, 0, 0, 0, 0, 0), 1.0), "g": ((0, 1, 0, 0, 0, 0, 0), 1e-3), "s": ((0, 0, 1, 0, 0, 0, 0), 1.0), "A": ((0, 0, 0, 1, 0, 0, 0), 1.0), "K": ((0, 0, 0, 0, 1, 0, 0), 1.0), "mol": ((0, 0, 0, 0, 0, 1, 0), 1.0), "cd": ((0, 0, 0, 0, 0, 0, 1), 1.0),
    "Hz": ((0, 0, -1, 0, 0, 0, 0), 1.0), "N": ((1, 1, -2, 0, 0, 0, 0), 1.0), "Pa": ((-1, 1, -2, 0, 0, 0, 0), 1.0), "J": ((2, 1, -2, 0, 0, 0, 0), 1.0), "W": ((2, 1, -3, 0, 0, 0, 0), 1.0), "C": ((0, 0, 1, 1, 0, 0, 0), 1.0), "V": ((2, 1, -3, -1, 0, 0, 0), 1.0),
    "F": ((-2, -1, 4, 2, 0, 0, 0), 1.0), "ohm": ((2, 1, -3, -2, 0, 0, 0), 1.0), "S": ((-2, -1, 3, 2, 0, 0, 0), 1.0), "Wb": ((2, 1, -2, -1, 0, 0, 0), 1.0), "T": ((0, 1, -2, -1, 0, 0, 0), 1.0), "H": ((2, 1, -2, -2, 0, 0, 0), 1.0), "lm": ((0, 0, 0, 0, 0, 0, 1), 1.0), "lx": ((-2, 0, 0, 0, 0, 0, 1), 1.0),
    "Bq": ((0, 0, -1, 0, 0, 0, 0), 1.0), "Gy": ((2, 0, -2, 0, 0, 0, 0), 1.0), "kat": ((0, 0, -1, 0, 0, 1, 0), 1.0), "L": ((3, 0, 0, 0, 0, 0, 0), 1e-3), "l": ((3, 0, 0, 0, 0, 0, 0), 1e-3), "t": ((0, 1, 0, 0, 0, 0, 0), 1e3), "bar": ((-1, 1, -2, 0, 0, 0, 0), 1e5), "eV": ((2, 1, -2, 0, 0, 0, 0), 1.602176634e-19), "cal": ((2, 1, -2, 0, 0, 0, 0), 4.184), "Wh": ((2, 1, -2, 0, 0, 0, 0), 3600.0), "rad": ((0, 0, 0, 0, 0, 0, 0), 1.0),
}
#: Units without prefixes.
PLAIN = {
    "min": ((0, 0, 1, 0, 0, 0, 0), 60.0), "hour": ((0, 0, 1, 0, 0, 0, 0), 3600.0), "day": ((0, 0, 1, 0, 0, 0, 0), 86400.0), "week": ((0, 0, 1, 0, 0, 0, 0), 604800.0), "year": ((0, 0, 1, 0, 0, 0, 0), 31557600.0),
    "inch": ((1, 0, 0, 0, 0, 0, 0), 0.0254), "foot": ((1, 0, 0, 0, 0, 0, 0), 0.3048), "yard": ((1, 0, 0, 0, 0, 0, 0), 0.9144), "mile": ((1, 0, 0, 0, 0, 0, 0), 1609.344), "nautical_mile": ((1, 0, 0, 0, 0, 0, 0), 1852.0), "angstrom": ((1, 0, 0, 0, 0, 0, 0), 1e-10), "au": ((1, 0, 0, 0, 0, 0, 0), 149597870700.0), "light_year": ((1, 0, 0, 0, 0, 0, 0), 9460730472580800.0),
    "lb": ((0, 1, 0, 0, 0, 0, 0), 0.45359237), "ounce": ((0, 1, 0, 0, 0, 0, 0), 0.028349523125), "stone": ((0, 1, 0, 0, 0, 0, 0), 6.35029318), "acre": ((2, 0, 0, 0, 0, 0, 0), 4046.8564224), "hectare": ((2, 0, 0, 0, 0, 0, 0), 1e4), "gallon": ((3, 0, 0, 0, 0, 0, 0), 0.003785411784), "pint": ((3, 0, 0, 0, 0, 0, 0), 0.000473176473), "cup": ((3, 0, 0, 0, 0, 0, 0), 0.0002365882365),
    "mph": ((1, 0, -1, 0, 0, 0, 0), 0.44704), "kph": ((1, 0, -1, 0, 0, 0, 0), 1 / 3.6), "knot": ((1, 0, -1, 0, 0, 0, 0), 1852 / 3600), "lbf": ((1, 1, -2, 0, 0, 0, 0), 4.4482216152605), "atm": ((-1, 1, -2, 0, 0, 0, 0), 101325.0), "psi": ((-1, 1, -2, 0, 0, 0, 0), 6894.757293168361), "mmHg": ((-1, 1, -2, 0, 0, 0, 0), 133.322387415), "btu": ((2, 1, -2, 0, 0, 0, 0), 1055.05585262), "hp": ((2, 1, -3, 0, 0, 0, 0), 745.6998715822702),
    "deg": ((0, 0, 0, 0, 0, 0, 0), 3.141592653589793 / 180), "percent": ((0, 0, 0, 0, 0, 0, 0), 0.01), "dozen": ((0, 0, 0, 0, 0, 0, 0), 12.0), "delta_degC": ((0, 0, 0, 0, 1, 0, 0), 1.0), "delta_degF": ((0, 0, 0, 0, 1, 0, 0), 5 / 9), "degR": ((0, 0, 0, 0, 1, 0, 0), 5 / 9),
}
#: Temperatures with an offset, in kelvins; they stand alone, never in a product.
OFFSET = {"degC": (1.0, 273.15), "degF": (5 / 9, 459.67 * 5 / 9)}
#: Other names of units.
NAMES = {
    "meter": "m", "metre": "m", "gram": "g", "second": "s", "ampere": "A", "kelvin": "K", "mole": "mol", "candela": "cd", "hertz": "Hz", "newton": "N", "pascal": "Pa", "joule": "J", "watt": "W", "coulomb": "C", "volt": "V", "farad": "F", "siemens": "S", "weber": "Wb", "tesla": "T", "henry": "H", "liter": "L", "litre": "L", "tonne": "t", "calorie": "cal", "radian": "rad", "electron_volt": "eV",
    "minute": "min", "h": "hour", "hr": "hour", "d": "day", "wk": "week", "yr": "year", "in": "inch", "ft": "foot", "feet": "foot", "yd": "yard", "mi": "mile", "nmi": "nautical_mile", "ly": "light_year", "pound": "lb", "oz": "ounce", "ha": "hectare", "gal": "gallon", "horsepower": "hp", "degree": "deg", "celsius": "degC", "fahrenheit": "degF", "atmosphere": "atm", "torr": "mmHg",
}
_UNIT = "struct<dims:array<double>,factor:double,offset:double,alone:boolean,number:boolean>"


def _table() -> dict[str, tuple[tuple, float, float]]:
    """Every unit name: its exponents, factor and offset. Prefixed names are made from prefixes and units; a unit's own name wins over a prefixed one."""
    own = {k: (*v, 0.0) for k, v in (PREFIXED | PLAIN).items()} | {k: ((0, 0, 0, 0, 1, 0, 0), f, o) for k, (f, o) in OFFSET.items()}
    out = dict(own)
    for name, unit in NAMES.items():
        out[name] = own[unit]
        if len(name) > 3 and not name.endswith(("s", "z", "feet")):
            out[f"{name}s"] = own[unit]
    for unit in ("inch", "foot", "yard", "mile", "hour", "day", "week", "year", "ounce", "acre", "hectare", "gallon", "pint", "cup", "knot", "stone", "ohm"):
        out[f"{unit}es" if unit == "inch" else f"{unit}s"] = own[unit]
    for p, scale in PREFIXES.items():
        for unit, (dims, factor) in PREFIXED.items():
            out.setdefault(p + unit, (dims, factor * scale, 0.0))
    for p, scale in LONG_PREFIXES.items():
        for name, unit in NAMES.items():
            if unit in PREFIXED:
                dims, factor = PREFIXED[unit]
                out.setdefault(p + name, (dims, factor * scale, 0.0))
                out.setdefault(f"{p}{name}s", (dims, factor * scale, 0.0))
    return out


TABLE = _table()


def _struct(dims: Column, factor: Column, offset: Column, alone: Column, number: Column) -> Column:
    return F.struct(dims.alias("dims"), factor.cast("double").alias("factor"), offset.cast("double").alias("offset"), alone.alias("alone"), number.alias("number")).cast(_UNIT)


def _known() -> Column:
    """The table as one literal: names to exponents, factor and offset."""
    rows = {name: [*map(float, dims), factor, offset] for name, (dims, factor, offset) in TABLE.items()}
    return F.from_json(F.lit(json.dumps(rows)), "map<string,array<double>>")


def written(c: Column) -> Column:
    """A unit text as a product: ``per`` and words next to each other become signs, squares and cubes powers."""
    c = F.regexp_replace(F.trim(c), r"\s+per\s+", "/")
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("·"), F.lit("*")), "²", "^2"), "³", "^3")
    return F.regexp_replace(c, r"(?<=[\w)])\s+(?=[A-Za-zµ(])", "*")


def parse(c: Column) -> Column:
    """A unit text's ``dims`` (exponents by ``DIMENSIONS``), ``factor``, ``offset``, ``alone`` (it has an offset); null for what is no unit.

    An empty text is the unit 1. A null is null. Names are case-sensitive; micro may be written ``u`` or ``µ``.
    """
    one, known, no, yes = F.array(*(F.lit(0.0) for _ in DIMENSIONS)), _known(), F.lit(False), F.lit(True)
    n = len(DIMENSIONS)

    def operand(t: Column) -> Column:
        number = _struct(one, t.try_cast("double"), F.lit(0.0), no, yes)
        unit = lambda x: F.when(x.isNotNull(), _struct(F.slice(x, 1, n), x[n], x[n + 1], x[n + 1] != 0, no))
        return F.when(t.rlike("^[0-9.]"), number).otherwise(rowexpr._bound(known[t], unit))

    def applied(t: Column, a: Column, b: Column) -> Column:
        fine = ~a["alone"] & ~b["alone"]
        both = lambda f: F.zip_with(a["dims"], b["dims"], f)
        times = _struct(both(lambda x, y: x + y), a["factor"] * b["factor"], F.lit(0.0), no, a["number"] & b["number"])
        over = _struct(both(lambda x, y: x - y), F.try_divide(a["factor"], b["factor"]), F.lit(0.0), no, a["number"] & b["number"])
        power = _struct(F.transform(a["dims"], lambda x: x * b["factor"]), F.pow(a["factor"], b["factor"]), F.lit(0.0), no, a["number"])
        return F.when(fine & (t == "2*"), times).when(fine & (t == "2/"), over).when(fine & (t == "4^") & b["number"], power)

    def step(stack: Column, t: Column) -> Column:
        size = F.size(stack)
        top, under = F.get(stack, size - 1), F.get(stack, size - 2)
        signed = F.when(top["number"], _struct(top["dims"], F.when(t == "3-", -top["factor"]).otherwise(top["factor"]), F.lit(0.0), no, yes))
        return (
            F.when(t.isin(*set(rowexpr.BINARY.values())), F.concat(F.slice(stack, 1, size - 2), F.array(applied(t, under, top))))
            .when(t.isin(*rowexpr.SIGNS.values()), F.concat(F.slice(stack, 1, size - 1), F.array(signed)))
            .when(t.rlike(r"^9.*\($"), F.concat(F.slice(stack, 1, size - 1), F.array(F.lit(None).cast(_UNIT)))).otherwise(F.concat(stack, F.array(operand(t))))
        )

    text = written(c)
    found = F.aggregate(rowexpr.postfix(F.regexp_replace(text, "µ", "u")), F.array().cast(f"array<{_UNIT}>"), step, lambda stack: F.get(stack, F.lit(0)))
    return F.when(text == "", _struct(one, F.lit(1.0), F.lit(0.0), no, yes)).otherwise(found)


def shown_dimensions(dims: Column) -> Column:
    """Exponents as a text: ``length^2*mass/...`` written with negative powers; ``dimensionless`` without any."""
    named = F.zip_with(dims, F.array(*map(F.lit, DIMENSIONS)), lambda e, name: F.when(e == 1, name).when(e != 0, F.concat(name, F.lit("^"), F.when(e == F.floor(e), e.cast("int").cast("string")).otherwise(e.cast("string")))))
    text = F.array_join(F.filter(named, lambda x: x.isNotNull()), "*")
    return F.when(text == "", "dimensionless").otherwise(text)


def convert(value: Column, from_unit: Column, to_unit: Column) -> Column:
    """``value`` of one unit in another: ``result``, and ``error`` where there is none (an unknown unit, or other dimensions).

    Exponents agree if they differ by less than 1e-9. A null value has neither; a null unit is unknown.
    """

    def told(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        unknown = F.when(a.isNull(), F.concat(F.lit("unknown unit: "), F.coalesce(from_unit, F.lit("null")))).when(b.isNull(), F.concat(F.lit("unknown unit: "), F.coalesce(to_unit, F.lit("null"))))
        alike = ~F.exists(F.zip_with(a["dims"], b["dims"], lambda x, y: F.abs(x - y)), lambda d: d > 1e-9)
        error = F.when(unknown.isNotNull(), unknown).when(~alike, F.concat(from_unit, F.lit(" is "), shown_dimensions(a["dims"]), F.lit(", "), to_unit, F.lit(" is "), shown_dimensions(b["dims"])))
        result = F.when(error.isNull(), (value.cast("double") * a["factor"] + a["offset"] - b["offset"]) / b["factor"])
        return F.struct(result.alias("result"), F.when(value.isNotNull(), error).alias("error"))

    return rowexpr._bound(F.struct(parse(from_unit).alias("a"), parse(to_unit).alias("b")), told)
