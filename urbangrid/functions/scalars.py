"""Per-value functions on columns: backscatter, indices, quantising, binning, output clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def backscatter(decibel) -> Column:
    """Coefficient of a decibel value, at most 1."""
    return F.least(F.lit(1.0), F.pow(F.lit(10.0), _c(decibel) / 10))


def backscatter_clipped(coefficient) -> Column:
    """Linear form: clipped to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(coefficient)))


def vvh(vv, vh, gamma: float = 5.0) -> Column:
    return _c(vv) * F.pow(F.lit(gamma), _c(vh))


def luminance(red, green, blue) -> Column:
    return 0.2126 * _c(red) + 0.7152 * _c(green) + 0.0722 * _c(blue)


def normalized_index(x, y) -> Column:
    """(x - y) / (x + y); 0 where it is not defined."""
    return F.coalesce(F.try_divide(_c(x) - _c(y), _c(x) + _c(y)), F.lit(0.0))


def quantise(x) -> Column:
    """0..1 to 0..255, truncated, and back."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), _c(x) * 255))) / 255.0


def digitize(x, edges: list[float]) -> Column:
    """Number of sorted edges that are not above x."""
    return sum((F.when(_c(x) >= e, 1).otherwise(0) for e in sorted(edges)), F.lit(0))


def replace_nonfinite(x, value: float) -> Column:
    return F.when(F.isnan(_c(x)) | (F.abs(_c(x)) == float("inf")), F.lit(value)).otherwise(_c(x))


def seeded_hash(*parts) -> Column:
    """60 bits of the MD5 of the parts joined by ':' as a long: the same on any engine, so draws by it can be checked elsewhere."""
    text = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def regex_key(x, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(_c(x), pattern, group)


def clamp_output(x, lo: float, hi: float, below: str = "zero") -> Column:
    """Above hi: hi.  Below lo: 0 ("zero") or lo ("min")."""
    return F.when(_c(x) > hi, F.lit(float(hi))).when(_c(x) < lo, F.lit(0.0 if below == "zero" else float(lo))).otherwise(_c(x))


def log_target(x) -> Column:
    return F.ln(_c(x))


def unlog_target(x) -> Column:
    return F.exp(_c(x))


def nan_ratio(values) -> Column:
    """Share of missing (null or NaN) entries of an array."""
    v = _c(values)
    return F.try_divide(F.size(F.filter(v, lambda e: e.isNull() | F.isnan(e))), F.size(v))


def web_mercator(lon, lat) -> tuple[Column, Column]:
    """Degrees to metres (4326 to 3857)."""
    r = 6378137.0
    return F.radians(_c(lon)) * r, F.ln(F.tan(F.radians(_c(lat)) / 2 + F.lit(0.7853981633974483))) * r


def from_web_mercator(x, y) -> tuple[Column, Column]:
    """Metres to degrees (3857 to 4326)."""
    r = 6378137.0
    return F.degrees(_c(x) / r), F.degrees(2 * F.atan(F.exp(_c(y) / r)) - F.lit(1.5707963267948966))
