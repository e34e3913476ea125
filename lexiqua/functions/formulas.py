"""The formula catalogue: named formulas of 14 domains as SQL expressions over named arguments.

Entries lie in ``catalogue/<domain>.txt``, one a line: ``name(args) = expression``; ``aggregate`` before the expression marks
one over rows. A formula is known by domain and name, as names recur with other meanings. Division by zero is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from importlib.resources import files

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DOMAINS = "algebra calculus complex_numbers economics finance geometry linear_algebra math physics probability statistics thermodynamics trigonometry vectors".split()
_COMB = "CASE WHEN {k} < 0 OR {k} > {n} THEN 0D WHEN {k} = 0 THEN 1D ELSE round(aggregate(sequence(1, cast({k} AS int)), 1D, (a_, i_) -> a_ * ({n} - {k} + i_) / i_)) END"


@dataclass(frozen=True)
class Formula:
    domain: str
    name: str
    args: tuple[str, ...]
    body: str
    over_rows: bool

    @property
    def solved(self) -> bool:
        return self.body != "NULL"

    @property
    def takes_functions(self) -> tuple[str, ...]:
        return tuple(a for a in self.args if re.search(rf"\b{re.escape(a)}\(", self.body))

    def sql(self, values: dict[str, str] | None = None, functions: dict[str, Callable[[str], str]] | None = None) -> str:
        """The expression with ``values`` (SQL text) for its arguments; arguments that are functions take them from ``functions``."""
        values, functions = values or {}, functions or {}
        if missing := [a for a in self.args if a.lstrip("*") not in values and a not in functions]:
            raise KeyError(f"{self.name} needs {', '.join(missing)}")
        if self.args and self.args[0].startswith("*"):
            return f"array({values[self.args[0][1:]]})"
        text = self.body
        for f, build in functions.items():
            text = _expand(text, f, lambda x, build=build: f"({build(x)})")
        text = _expand(text, "comb", lambda x: "(" + _COMB.format(n=f"({_two(x)[0]})", k=f"({_two(x)[1]})") + ")")
        text = _expand(text, "factorial", lambda x: f"factorial\0(cast({x} AS int))")
        names = sorted((a for a in self.args if a in values), key=len, reverse=True)
        return re.sub(r"(?<![\w.'])(" + "|".join(map(re.escape, names)) + r")\b(?!\()", lambda m: f"({values[m[1]]})", text) if names else text

    def column(self, functions: dict[str, Callable[[str], str]] | None = None, **values: str) -> Column:
        return F.expr(self.sql(values, functions))


def _two(text: str) -> list[str]:
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            return [text[:i].strip(), text[i + 1 :].strip()]
    raise ValueError(text)


def _expand(text: str, name: str, build: Callable[[str], str]) -> str:
    """Each call of ``name`` replaced, the inner ones first."""
    while m := re.search(rf"(?<![\w.]){name}\(", text):
        depth, i = 1, m.end()
        while depth:
            depth += (text[i] == "(") - (text[i] == ")")
            i += 1
        text = text[: m.start()] + build(_expand(text[m.end() : i - 1], name, build)).replace(f"{name}(", f"{name}\0(") + text[i:]
    return text.replace("\0", "")


@cache
def catalogue(domain: str) -> dict[str, tuple[Formula, ...]]:
    """A domain's formulas by name; some have a form over rows and one over arrays."""
    found: dict[str, tuple[Formula, ...]] = {}
    for line in files("lexiqua.functions").joinpath(f"catalogue/{domain}.txt").read_text().splitlines():
        m = re.fullmatch(r"(\w+)\((.*?)\) = (aggregate (?!\())?(.*)", line)
        if m is None:
            raise ValueError(line)
        over = line.partition(" = ")[2].startswith("aggregate ")
        body = line.partition(" = ")[2].removeprefix("aggregate ") if over else line.partition(" = ")[2]
        body = re.sub(r"\s+\((?:Σ|var-args).*$|\s+—.*$", "", body).strip("`")
        found[m[1]] = (*found.get(m[1], ()), Formula(domain, m[1], tuple(filter(None, (a.strip() for a in m[2].split(",")))), body, over))
    return found


def formula(domain: str, name: str, over_rows: bool = False) -> Formula:
    return next(f for f in catalogue(domain)[name] if f.over_rows == over_rows)


def evaluated(domain: str, name: str, values: dict[str, str]) -> Column:
    """``value`` and ``detail`` of a formula by its name (in any case of letters), for values (SQL text) by theirs.

    An argument's own name comes first, then the same in another case. Where one is missing, the formula isn't there, or it
    isn't solved, the value is null and the detail says so.
    """
    told = lambda value, detail: F.struct(value.alias("value"), detail.alias("detail"))
    none = F.lit(None).cast("double")
    found = next((f for n, forms in catalogue(domain).items() if n.lower() == name.lower() for f in forms if not f.over_rows), None)
    if found is None or not found.solved:
        return told(none, F.lit(f"no formula {name} of {domain}" if found is None else f"{found.name} has no expression"))
    low = {k.lower(): v for k, v in values.items()}
    given = {a: values.get(a, low.get(a.lower())) for a in (a.lstrip("*") for a in found.args)}
    if missing := [a for a, v in given.items() if v is None]:
        return told(none, F.lit(f"missing: {', '.join(missing)}"))
    value = found.column(**given).cast("double")
    return told(value, F.when(value.isNull(), "no value").otherwise(f"{found.name}({', '.join(given)})"))


def every() -> list[Formula]:
    return [f for d in DOMAINS for forms in catalogue(d).values() for f in forms]


def register(spark: SparkSession) -> None:
    """``erf``, which Spark has not, as a vectorised function of the session."""

    @F.pandas_udf("double")
    def erf(x: pd.Series) -> pd.Series:
        from math import erf as one

        return x.map(one, na_action="ignore")

    spark.udf.register("erf", erf)


def in_parts(columns: dict[str, Column], many: int = 20) -> list[Column]:
    """Columns by name for one projection of many formulas.

    A projection in a generated stage is one method, and one of some thousand bytes is too long to be compiled and is interpreted. An
    expression that isn't generated takes the projection out of that stage, where it is cut into methods that are compiled.
    """
    apart = lambda c: F.get(F.transform(F.array(c), lambda x: x), F.lit(0))
    return [(apart(c) if i == 0 and len(columns) >= many else c).alias(name) for i, (name, c) in enumerate(columns.items())]
