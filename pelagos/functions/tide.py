"""Arguments of the tide: mean longitudes, node factors and phases by constituent, as steps of SQL expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Coefficients of mean longitudes in degrees by powers of Julian centuries since 2000.
LONGITUDES = {
    "s": (218.3164591, 481267.88134236, -0.0013268, 1 / 538841.0 - 1 / 65194000.0),
    "h": (280.46645, 36000.76983, 0.0003032),
    "p": (83.353243, 4069.0137111, -0.0103238, -1 / 80053.0, 1 / 18999000.0),
    "n": (125.044555, -1934.1361849, 0.0020762, 1 / 467410.0, -1 / 60616000.0),
    "pp": (280.46645 - 357.5291, 36000.76932 - 35999.0503, 0.0003032 + 0.0001559, 0.00000048),
}
# The obliquity of the ecliptic in arc seconds by powers of ten thousand years.
OBLIQUITY = (84381.448, -4680.93, -1.55, 1999.25, -51.38, -249.67, -39.05, 7.12, 27.87, 5.79, 2.45)
#: Fixed value: the inclination of the moon's orbit in degrees.
INCLINATION = 5.145
# Multiples of hour angle, s, h, p and pp, then degrees, and the node correction of each constituent.
CONSTITUENTS = {
    "M2": ((2, 0, 0, 0, 0), 0, "m2"), "S2": ((2, 2, -2, 0, 0), 0, None), "N2": ((2, -1, 0, 1, 0), 0, "m2"), "K2": ((2, 2, 0, 0, 0), 0, "k2"),
    "K1": ((1, 1, 0, 0, 0), -90, "k1"), "O1": ((1, -1, 0, 0, 0), 90, "o1"), "P1": ((1, 1, -2, 0, 0), 90, None), "Q1": ((1, -2, 0, 1, 0), 90, "o1"),
    "SA": ((0, 0, 1, 0, -1), 0, None), "SSA": ((0, 0, 2, 0, 0), 0, None),
}
# Shallow-water constituents as products of others.
COMPOUNDS = {"M4": ("M2", "M2"), "MS4": ("M2", "S2"), "MN4": ("M2", "N2")}


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _polynomial(c: tuple[float, ...], x: str) -> str:
    out = _number(c[-1])
    for a in reversed(c[:-1]):
        out = f"({_number(a)} + {x} * {out})"
    return out


def _turn(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


def steps(seconds: str) -> list[dict[str, str]]:
    """Columns to add one step after the other, each from those before; ``seconds`` since 1970. The last step has ``v_``, ``f_`` and ``u_`` of all constituents."""
    i = f"radians({_number(INCLINATION)})"
    node = [
        {"days": f"({seconds} / 86400)"},
        {"t": f"((days - {_number(10957.5)}) / 36525)"},
        {k: _turn(_polynomial(c, "t")) for k, c in LONGITUDES.items()} | {
            "w": f"radians({_polynomial(OBLIQUITY, '(t / 100)')} / 3600)", "hour": "((days + 0.5 - floor(days + 0.5)) * 360)",
        },
        {"ts_": _turn("hour + h - s"), "tilt": f"acos(cos({i}) * cos(w) - sin({i}) * sin(w) * cos(radians(n)))", "half": "(radians(n) / 2)"},
        {
            "e1": f"(atan(cos((w - {i}) / 2) / cos((w + {i}) / 2) * tan(half)) - half)",
            "e2": f"(atan(sin((w - {i}) / 2) / sin((w + {i}) / 2) * tan(half)) - half)",
        },
        {"xi": "(-(e1 + e2))", "nu": "(e1 - e2)"},
        {
            "nu1": "atan(sin(2 * tilt) * sin(nu) / (sin(2 * tilt) * cos(nu) + 0.3347))",
            "nu2": "(atan(power(sin(tilt), 2) * sin(2 * nu) / (power(sin(tilt), 2) * cos(2 * nu) + 0.0727)) / 2)",
            "mean2": f"(1 - 1.5 * power(sin({i}), 2))",
        },
        {
            "f_m2": f"(power(cos(tilt / 2), 4) / (power(cos(w / 2), 4) * power(cos({i} / 2), 4)))", "u_m2": "degrees(2 * xi - 2 * nu)",
            "f_o1": f"(sin(tilt) * power(cos(tilt / 2), 2) / (sin(w) * power(cos(w / 2), 2) * power(cos({i} / 2), 4)))", "u_o1": "degrees(2 * xi - nu)",
            "f_k1": "(sqrt(0.2523 * power(sin(2 * tilt), 2) + 0.1689 * sin(2 * tilt) * cos(nu) + 0.0283) / (0.5023 * sin(2 * w) * mean2 + 0.1681))", "u_k1": "degrees(-nu1)",
            "f_k2": "(sqrt(0.2523 * power(sin(tilt), 4) + 0.0367 * power(sin(tilt), 2) * cos(2 * nu) + 0.0013) / (0.5023 * power(sin(w), 2) * mean2 + 0.0365))", "u_k2": "degrees(-2 * nu2)",
        },
    ]
    last = {}
    for name, (k, extra, kind) in CONSTITUENTS.items():
        last[f"v_{name}"] = _turn(" + ".join(f"{a} * {x}" for a, x in zip(k, ("ts_", "s", "h", "p", "pp"), strict=True)) + f" + {extra}")
        last[f"fa_{name}"], last[f"ua_{name}"] = (f"f_{kind}", f"u_{kind}") if kind else ("CAST(1.0 AS DOUBLE)", "CAST(0.0 AS DOUBLE)")
    more = {}
    for name, (a, b) in COMPOUNDS.items():
        more |= {f"v_{name}": _turn(f"v_{a} + v_{b}"), f"fa_{name}": f"(fa_{a} * fa_{b})", f"ua_{name}": f"(ua_{a} + ua_{b})"}
    return [*node, last, more]


def arguments(times: DataFrame, seconds: str) -> DataFrame:
    """``times`` with ``v_``, ``fa_`` and ``ua_`` (argument, node factor, node phase) of every constituent and what leads to them; columns of ``times`` must not have the names of ``steps``."""
    for step in steps(seconds):
        times = times.selectExpr("*", *(f"{x} AS {n}" for n, x in step.items()))
    return times


def heights(times: DataFrame, seconds: str, mean: float, harmonics: Iterable[tuple[str, float, float]]) -> DataFrame:
    """``times`` with ``height``: the mean level plus each constituent's (name, amplitude, phase lag) share at its time."""
    part = lambda n, a, g: F.lit(a) * F.col(f"fa_{n}") * F.cos(F.radians(F.col(f"v_{n}") + F.col(f"ua_{n}") - F.lit(g)))
    total = F.lit(mean)
    for h in harmonics:
        total = total + part(*h)
    row = times.select(F.struct(*times.columns).alias("_row"), F.col(seconds).alias("_seconds"))  # columns of any name
    return arguments(row, "_seconds").select("_row.*", total.alias("height"))
