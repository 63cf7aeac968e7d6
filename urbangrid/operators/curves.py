"""The curve y = a * x^b + c by least squares within bounds.

For a given b the best a and c within their bounds follow from a few sums, so b alone is searched: a grid over its bounds, then Gauss-Newton steps from
the grid's minima, each kept in a bracket that at least halves.  A step is one aggregate over two columns; no row is copied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

# sums over all rows, with z = (x / geometric mean)^b
_SUMS = {"z": lambda z, l, y: z, "zz": lambda z, l, y: z * z, "zy": lambda z, l, y: z * y}
_SLOPES = {**_SUMS, "zl": lambda z, l, y: z * l, "zzl": lambda z, l, y: z * z * l, "zly": lambda z, l, y: z * l * y, "zzll": lambda z, l, y: z * z * l * l}


@dataclass
class _Data:
    """Rows as l (ln x less its mean) and y (less its mean), and what is known of them."""

    rows: DataFrame
    n: int
    mean_l: float
    mean_y: float
    yy: float
    bound: float


@dataclass
class _Point:
    b: float
    a: float  # of (x / geometric mean)^b
    c: float  # of y less its mean
    sse: float
    step: float


def _best_line(s: dict, d: _Data, b: float) -> tuple[float, float, float, bool, bool]:
    """a, c, the sum of squares, and whether a and c are off their bounds: the least of the inner minimum and those of the four edges."""
    top = d.bound * math.exp(min(700.0, b * d.mean_l))
    low_c, high_c = -d.bound - d.mean_y, d.bound - d.mean_y
    clip = lambda v, lo, hi: min(hi, max(lo, v))
    sse = lambda a, c: d.yy + a * a * s["zz"] + c * c * d.n - 2 * a * s["zy"] + 2 * a * c * s["z"]
    tried = [(a, clip(-a * s["z"] / d.n, low_c, high_c), False, None) for a in (-top, top)]
    if s["zz"] > 0:
        tried += [(clip((s["zy"] - c * s["z"]) / s["zz"], -top, top), c, None, False) for c in (low_c, high_c)]
    spread = s["zz"] - s["z"] ** 2 / d.n
    if spread > 1e-12 * s["zz"]:
        a = s["zy"] / spread
        c = -a * s["z"] / d.n
        if abs(a) <= top and low_c <= c <= high_c:
            tried.append((a, c, True, True))
    a, c, free_a, free_c = min(tried, key=lambda t: sse(t[0], t[1]))
    return a, c, sse(a, c), -top < a < top if free_a is None else free_a, low_c < c < high_c if free_c is None else free_c


def _point(b: float, s: dict, d: _Data) -> _Point:
    a, c, sse, free_a, free_c = _best_line(s, d, b)
    if "zl" not in s:
        return _Point(b, a, c, sse, 0.0)
    m = d.mean_l
    # slope of the curve in b: a * z * ln x, less what free a and c take up
    dz, d1 = a * (s["zzl"] + m * s["zz"]), a * (s["zl"] + m * s["z"])
    dd = a * a * (s["zzll"] + 2 * m * s["zzl"] + m * m * s["zz"])
    dr = a * (s["zly"] + m * s["zy"]) - a * dz - c * d1
    if free_a and free_c:
        det = s["zz"] * d.n - s["z"] ** 2
        dd -= (dz * dz * d.n - 2 * dz * d1 * s["z"] + d1 * d1 * s["zz"]) / det if det > 0 else 0.0
    elif free_a:
        dd -= dz * dz / s["zz"]
    elif free_c:
        dd -= d1 * d1 / d.n
    return _Point(b, a, c, sse, dr / dd if dd > 0 else 0.0)


def _points(d: _Data, bs: list[float], sums: dict) -> list[_Point]:
    """One aggregate for all trial values of b."""
    l, y = F.col("l"), F.col("y")
    row = d.rows.agg(*[F.sum(f(F.exp(l * b), l, y)).alias(f"{t}{k}") for k, b in enumerate(bs) for t, f in sums.items()]).first()
    found = [(b, {t: row[f"{t}{k}"] for t in sums}) for k, b in enumerate(bs)]
    return [_point(b, s, d) for b, s in found if all(math.isfinite(v) for v in s.values())]


def fit_power(df: DataFrame, x: str, y: str, lo: float = -10.0, hi: float = 10.0, points: int = 41, rounds: int = 40, bound: float = 100.0, tol: float = 1e-9) -> dict[str, float]:
    """a, b, c with a and c within +-bound and b within lo..hi.

    Rows whose x is not above 0, or whose x or y is null or not finite, have no curve and take no part; a table without others is an error.  Equal x
    throughout leaves b open: then any b fits, and the first tried of the best is given.  Two columns of numbers are written once, as every step reads them.
    """
    finite = lambda c: F.abs(c) < float("inf")
    pair = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter((F.col("x") > 0) & finite("x") & finite("y")).select(F.ln("x").alias("l"), "y")
    pair = stored(pair, "curve")
    base = pair.agg(F.count("*").alias("n"), F.avg("l").alias("l"), F.avg("y").alias("y")).first()
    if not base.n:
        raise ValueError("no rows with a positive x and a finite y")
    rows = pair.select((F.col("l") - base.l).alias("l"), (F.col("y") - base.y).alias("y"))
    d = _Data(rows, base.n, base.l, base.y, rows.agg(F.sum(F.col("y") * F.col("y"))).first()[0], bound)
    grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
    tried = {p.b: p for p in _points(d, [b for b in grid if abs(b) > 1e-9], _SUMS)}
    bs = sorted(tried)
    if not bs:
        raise ValueError("no parameters within the bounds")
    at = [k for k in range(len(bs)) if all(tried[bs[k]].sse <= tried[bs[j]].sse for j in (k - 1, k + 1) if 0 <= j < len(bs))]
    at = sorted(at, key=lambda k: tried[bs[k]].sse)[:3]
    open_ = [(bs[max(0, k - 1)], tried[bs[k]], bs[min(len(bs) - 1, k + 1)]) for k in at]
    done: list[_Point] = []
    for _ in range(rounds):
        if not open_:
            break
        ask = sorted({v for left, p, right in open_ for v in (p.b, *_next(left, p, right)) if abs(v) > 1e-9})
        seen = {p.b: p for p in _points(d, ask, _SLOPES)}
        later = []
        for left, p, right in open_:
            inside = sorted((q for v, q in seen.items() if left <= v <= right), key=lambda q: q.b)
            best = min(inside, key=lambda q: (q.sse, abs(q.step)))
            lower, upper = max([q.b for q in inside if q.b < best.b], default=left), min([q.b for q in inside if q.b > best.b], default=right)
            still = upper - lower < tol or abs(best.step) < tol
            (done if still else later).append(best if still else (lower, best, upper))
        open_ = later
    best = min([*done, *[p for _, p, _ in open_]], key=lambda p: p.sse)
    return {"a": best.a * math.exp(-best.b * d.mean_l), "b": best.b, "c": best.c + d.mean_y}


def _next(left: float, p: _Point, right: float) -> list[float]:
    """The Gauss-Newton step, kept in the bracket, and the middles of both sides."""
    newton = min(right, max(left, p.b + p.step))
    return [newton, (left + p.b) / 2, (p.b + right) / 2]
