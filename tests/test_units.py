import math

from pyspark.sql import functions as F

from lexiqua.functions import mathexpr, units

KNOWN = [
    (1.0, "kN*m/s**2", "N*m/s^2", 1000.0), (60.0, "miles per hour", "m/s", 26.8224), (1.0, "kg m^2 / s^2", "J", 1.0), (100.0, "degC", "degF", 212.0), (-40.0, "degF", "degC", -40.0), (5.0, "km", "mile", 5000 / 1609.344), (1.0, "1/(kg*m)", "1/(g*cm)", 1e-5),
    (2.0, "m²", "cm^2", 20000.0), (1.0, "kWh", "J", 3.6e6), (3.0, "", "percent", 300.0), (1.0, "m^0.5", "cm^0.5", 10.0), (1.0, "µm", "nm", 1000.0), (9.0, "kilometers", "feet", 9000 / 0.3048), (1.0, "N", "kg*m/s^2", 1.0), (1.0, "V*A", "W", 1.0), (1.0, "ohm*F", "s", 1.0), (180.0, "deg", "rad", math.pi),
    (1.0, "delta_degC", "delta_degF", 1.8), (1.0, "(m/s)/s", "m/s^2", 1.0), (1.0, "J/(kg*K)", "cal/(g*K)", 1 / 4184), (2.0, "2*m", "m", 4.0), (1.0, "m/s^-(1)", "m*s", 1.0), (1.0, "dam", "m", 10.0), (1.0, "min", "s", 60.0), (1.0, "cd", "mcd", 1000.0), (1.0, "Pa", "mPa", 1000.0),
]
WRONG = [(1.0, "m", "s", "m is length, s is time"), (1.0, "foo", "m", "unknown unit: foo"), (1.0, "m", "degC*m", "unknown unit: degC*m"), (1.0, None, "m", "unknown unit: null"), (1.0, "m +", "m", "unknown unit: m +"), (1.0, "m^s", "m", "unknown unit: m^s"), (1.0, "N", "", "N is length*mass*time^-2,  is dimensionless"), (1.0, "sin(m)", "m", "unknown unit: sin(m)"), (None, "m", "s", None)]


def test_conversions(spark):
    rows = [(v, a, b) for v, a, b, _ in KNOWN + WRONG]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v double, a string, b string")
    got = [r.r for r in df.select("i", units.convert(F.col("v"), F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()]
    for (v, a, b, want), r in zip(KNOWN, got):
        assert r.error is None and math.isclose(r.result, want, rel_tol=1e-12, abs_tol=1e-12), (a, b, r)
    assert [tuple(r) for r in got[len(KNOWN) :]] == [(None, e) for *_, e in WRONG]


def test_every_unit_converts_to_its_base(spark):
    """Each name alone: exponents and factor are the table's."""
    df = spark.createDataFrame([(n,) for n in units.TABLE], "n string")
    for r in df.select("n", units.parse(F.col("n")).alias("u")).collect():
        dims, factor, offset = units.TABLE[r.n]
        assert r.u is not None and list(r.u.dims) == list(map(float, dims)) and r.u.factor == factor and r.u.offset == offset, r.n


def test_steps_take_any_unit(spark):
    known = mathexpr.solve_steps({"f": F.lit(3.0)}, [{"expression": "f * 2", "assign": "w", "from_unit": "kN*m", "to_unit": "J"}])
    assert spark.range(1).select(known["w"]).first()[0] == 6000.0
