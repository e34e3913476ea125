import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql.functions import spark_partition_id

from lexiqua.functions import polynomials as p
from lexiqua.operators import reports

KNOWN = {
    "x*y = 6, x + y = 5": [(2, 3), (3, 2)], "x^2 + y^2 = 25, x = y + 1": [(-3, -4), (4, 3)], "x^2 = 2": [(-math.sqrt(2),), (math.sqrt(2),)], "x^2+1=0": [], "(x-1)^2*(x+2) = 0": [(-2,), (1,)], "x^2 + y^2 = 1, y = 1": [(0, 1)],
    "2x + 3y = 5, x - y = 1": [(1.6, 0.6)], "x+y=1,x+y=2": [], "x^3 - x = 0": [(-1,), (0,), (1,)], "x = y^2, y = x^2": [(0, 0), (1, 1)], "x^2-2*x*y+y^2=0, x+y=4": [(2, 2)], "x=1,x=2": [], "x*y=1,x*y=2": [], "0x = 1": [], "3 = x / 2": [(6,)],
    "x+y+z=6, x*y+y*z+z*x=11, x*y*z=6": sorted(itertools.permutations((1, 2, 3))), "x^2=4, y^2=9, x=2": [(2, -3), (2, 3)],
}
UNSOLVED = {"x + y = 1, 2x + 2y = 2": "not finitely many solutions", "x*y=0": "not finitely many solutions", "sin(x)=1": "not a polynomial", "nothing": "no equation", "x==1": "no equation", "x=1=2": "no equation", "1/x=2": "not a polynomial", "a*b=1,b*c=1,c*d=1,d*a=1": "too many unknowns", "x^99=1": "not a polynomial", "1=1": "no unknown", "x = __import__('os')": "not a polynomial"}


def test_known_systems():
    for said, want in KNOWN.items():
        got = [tuple(s.values()) for s in p.solve(said)]
        assert len(got) == len(want) and all(math.isclose(a, b, abs_tol=1e-12) for g, w in zip(got, want) for a, b in zip(g, w)), (said, got)
    for said, reason in UNSOLVED.items():
        with pytest.raises(p.Unsolved, match=reason):
            p.solve(said)


def test_real_roots_of_random_polynomials():
    rng = random.Random(1)
    for _ in range(60):
        roots = sorted({Fraction(rng.randint(-20, 20), rng.randint(1, 6)) for _ in range(rng.randint(0, 5))})
        c = [Fraction(1)]
        for r in [*roots, *roots[:1]]:  # the first one twice
            c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
        c = [sum(c[j] * (1, 0, 1)[i - j] for j in range(len(c)) if 0 <= i - j <= 2) for i in range(len(c) + 2)]  # and no real roots of x^2 + 1
        got = p.real_roots(c)
        assert len(got) == len(roots) and all(abs(a - b) <= abs(b) / 2**59 for a, b in zip(got, roots))
    some = [Fraction(x) for x in (-3, 1, 0, -4, 2, 1)]
    assert np.allclose([float(x) for x in p.real_roots(some)], sorted(r.real for r in np.roots([float(x) for x in some[::-1]]) if abs(r.imag) < 1e-9))


def test_rows_of_systems(spark):
    eleven = ", ".join(f"x{i} = {i}" for i in range(11))
    said = [*KNOWN, *UNSOLVED, None, eleven, f"{eleven}, x3 = 4"]
    rows = reports.solve_systems(spark.createDataFrame(list(enumerate(said)), "i int, t string"), "i", "t").collect()
    got = {r.i: r for r in rows}
    assert [len(got[i].solutions) for i in range(len(KNOWN))] == [len(w) for w in KNOWN.values()] and all(r.reason for r in rows[len(KNOWN) : -2])
    one, none = got[len(said) - 2], got[len(said) - 1]
    assert one.solutions == [{f"x{i}": float(i) for i in range(11)}] and none.solutions == []  # every equation is read
    linear = {r.i: r.solution for r in reports.solve_equations(spark.createDataFrame(list(enumerate(said)), "i int, t string"), "i", "t").collect()}
    assert linear[len(said) - 2] is not None and linear[len(said) - 1] is None and linear[0] is None


def test_isolated_roots_take_whole_numbers_only(monkeypatch):
    """An isolated root is bisected by signs: powers of fractions are not taken sixty times for each root."""
    taken = []
    power = Fraction.__pow__
    monkeypatch.setattr(Fraction, "__pow__", lambda a, b: taken.append(1) or power(a, b))
    got = p.real_roots([Fraction(7), Fraction(-10), Fraction(1)])
    assert np.allclose([float(x) for x in got], [5 - math.sqrt(18), 5 + math.sqrt(18)], rtol=1e-15) and len(taken) < 200


def test_systems_of_one_file_are_dealt_to_tasks(spark):
    rows = spark.range(400, numPartitions=1).selectExpr("id", "concat('x*y = ', id % 7, ', x + y = 9') AS t")
    for solved in (reports.solve_systems(rows, "id", "t"), reports.solve_equations(rows, "id", "t")):
        assert solved.select(spark_partition_id()).distinct().count() > 3
    assert sum(len(r.solutions) for r in reports.solve_systems(rows, "id", "t").collect()) == 800
