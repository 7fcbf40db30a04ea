"""Column expressions shared by the operators. Everything here stays inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres-based position units and their factor to micrometres.
UNIT_TO_UM = {"m": 1e6, "um": 1.0, "µm": 1.0, "nm": 1e-3}


def rounded(value: Column, digits: int = 9) -> Column:
    """Round an output value so that the order of a distributed sum cannot show."""
    return F.round(value, digits) + F.lit(0.0)


def finite(value: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def or_null(value: Column) -> Column:
    """NaN and infinities become NULL: unavailable is never a number."""
    return F.when(finite(value), value)


def ratio(num: Column, den: Column) -> Column:
    """Quotient, NULL where the denominator is zero or NULL."""
    return F.when(den != 0, num / den)


def bin_index(value: Column, n_bins: int, upper: float, lower: float = 0.0) -> Column:
    """Bin on ``n_bins`` equal bins of [lower, upper]; left closed, last bin closed on both sides.

    A first guess by division is corrected against the true edges ``lower + i*width``,
    so values that sit on an edge land in the bin whose edges enclose them.
    """
    width = (upper - lower) / n_bins
    shifted = value - F.lit(lower) if lower else value
    guess = F.least(F.floor(shifted / F.lit(width)).cast("int"), F.lit(n_bins - 1))
    return (
        F.when(shifted < guess * F.lit(width), guess - 1)
        .when((guess < n_bins - 1) & (shifted >= (guess + 1) * F.lit(width)), guess + 1)
        .otherwise(guess)
    )


def to_um(value: Column, unit: Column) -> Column:
    """Convert to micrometres; an unknown unit gives NULL so the row fails its expectation."""
    pairs = [F.lit(v) for item in UNIT_TO_UM.items() for v in item]
    return value * F.element_at(F.create_map(*pairs), F.lower(F.trim(unit)))


def strict_bool(value: Column) -> Column:
    """true/false/1/0 in any case; anything else is NULL and fails its expectation."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def lenient_bool(value: Column, default: str = "true") -> Column:
    """true/1/yes/y count as true, all other text as false, blank takes the default."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.lower(F.when(text == "", default).otherwise(text)).isin("true", "1", "yes", "y")


def default_text(value: Column, fallback: str = "UNASSIGNED") -> Column:
    """Blank or NULL text takes the fallback."""
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit(fallback))


def safe_key(value: Column) -> Column:
    """A key usable as a folder name: any other character becomes an underscore."""
    return F.regexp_replace(value.cast("string"), "[^A-Za-z0-9_.-]", "_")


def label_number(label: Column) -> Column:
    """The first run of digits in a label, for natural ordering (BR2 before BR10)."""
    return F.nullif(F.regexp_extract(label.cast("string"), r"(\d+)", 1), F.lit("")).cast("int")


def preferred_rank(value: Column, preferred: Sequence[str]) -> Column:
    """Position in a preferred list; values outside it rank after all listed ones."""
    where = F.array_position(F.array(*[F.lit(p) for p in preferred]), value.cast("string"))
    return F.when(where > 0, where - 1).otherwise(F.lit(len(preferred))).cast("int")


def reasons(conditions: Iterable[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in conditions]))


def close(a: Column, b: Column, atol: float, rtol: float = 0.0) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def hash_int(*parts: Column) -> Column:
    """A non-negative 32-bit integer from md5, equal in any engine that has md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def remap_16bit(value: Column, low: Column, high: Column) -> Column:
    """Linear contrast remap of [low, high] to 0..65535 with clipping, half to even."""
    unit = (value - low) / (high - low)
    return F.rint(F.lit(65535.0) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit))).cast("int")


# Coefficients of the published rational approximation of the inverse
# normal distribution function (P. J. Acklam), relative error below 1.2e-9.
_ICDF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
           1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_ICDF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
           6.680131188771972e01, -1.328068155288572e01)
_ICDF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
           -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_ICDF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
           3.754408661907416e00)
_ICDF_SPLIT = 0.02425


def _horner(coefficients: Sequence[float], x: Column, tail: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out if tail is None else out * x + F.lit(tail)


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile as a pure Column expression."""
    q = p - F.lit(0.5)
    central = q * _horner(_ICDF_A, q * q) / _horner(_ICDF_B, q * q, 1.0)
    low = F.sqrt(F.lit(-2.0) * F.log(p))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    return (
        F.when(p < _ICDF_SPLIT, _horner(_ICDF_C, low) / _horner(_ICDF_D, low, 1.0))
        .when(p > 1 - _ICDF_SPLIT, -_horner(_ICDF_C, high) / _horner(_ICDF_D, high, 1.0))
        .otherwise(central)
    )
