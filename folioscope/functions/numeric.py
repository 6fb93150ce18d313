"""Exact integer arithmetic: rounding modes, units, measures, rectangles, histograms. No floating point where the result is a count."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MODES = ("floor", "ceiling", "toward_zero", "half_up", "half_even", "half_away")
WIDE = "decimal(38,0)"
#: Layout units in one unit of length.
UNITS = {"inch": 1_828_800, "pica": 304_800, "point": 25_400, "half_point": 12_700, "eighth_point": 3_175, "twip": 1_270, "emu": 2, "cm": 720_000, "mm": 72_000}
#: A dot at 1 dpi; a dot at another resolution divides it.
DOTS = 1_828_800
SUFFIXES = {"mm": "mm", "cm": "cm", "in": "inch", "pt": "point", "pc": "pica", "pi": "pica"}
LIMIT = 10**12


def dot(dpi: int) -> int:
    if DOTS % dpi:
        raise ValueError("a dot of this resolution is no whole number of units")
    return DOTS // dpi


def div_round(numerator: Column, denominator: Column, mode: str) -> Column:
    """The quotient rounded once. half_up goes to the greater neighbour, half_away away from zero; null for a zero denominator."""
    flip = denominator < 0
    n = F.when(flip, -numerator.cast(WIDE)).otherwise(numerator.cast(WIDE))
    d = F.when(flip, -denominator.cast(WIDE)).otherwise(denominator.cast(WIDE))
    rest = F.pmod(n, d)
    down = ((n - rest) / d).cast(WIDE)
    half = rest * 2
    up = {
        "floor": F.lit(False),
        "ceiling": rest > 0,
        "toward_zero": (rest > 0) & (n < 0),
        "half_up": half >= d,
        "half_even": (half > d) | ((half == d) & (F.pmod(down, F.lit(2).cast(WIDE)) == 1)),
        "half_away": (half > d) | ((half == d) & (n > 0)),
    }[mode]
    return F.when(denominator != 0, down + F.when(up, F.lit(1)).otherwise(F.lit(0)))


def to_long(value: Column) -> Column:
    """Null where it does not fit 64 bits."""
    return value.try_cast("long")


def scale(value: Column, numerator: Column | int, denominator: Column | int, mode: str) -> Column:
    """value * numerator / denominator with one rounding; null for a zero denominator or a result beyond 64 bits."""
    numerator = F.lit(numerator) if isinstance(numerator, int) else numerator
    denominator = F.lit(denominator) if isinstance(denominator, int) else denominator
    return to_long(div_round(value.cast("decimal(19,0)") * numerator.cast("decimal(19,0)"), denominator, mode))


def to_units(value: Column, unit: str) -> Column:
    """Layout units of a whole number of `unit`; null beyond 64 bits."""
    return F.try_multiply(value.cast("long"), F.lit(UNITS[unit]).cast("long"))


def from_units(value: Column, unit: str, mode: str) -> Column:
    return scale(value, 1, UNITS[unit], mode)


def parse_whole(text: Column, unit: str) -> Column:
    """Layout units of an attribute that is a whole number; null if it is none or is out of range."""
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text).try_cast("long")
    return to_units(number, unit)


def parse_measure(text: Column, mode: str) -> Column:
    """Layout units of a measure with its unit (`1.5in`), exact, rounded once; null if malformed or out of range."""
    number = F.regexp_extract(text, "^(-?[0-9]+(?:[.][0-9]+)?)(?:mm|cm|in|pt|pc|pi)$", 1)
    suffix = F.when(number != "", F.substring(text, -2, 2))
    size = None
    for ending, unit in SUFFIXES.items():
        size = F.when(suffix == ending, F.lit(UNITS[unit])) if size is None else size.when(suffix == ending, F.lit(UNITS[unit]))
    whole = F.regexp_replace(number, "[.].*", "").try_cast("decimal(19,0)")
    places = F.rpad(F.when(number.contains("."), F.regexp_replace(number, ".*[.]", "")).otherwise(F.lit("")), 12, "0").try_cast("decimal(12,0)")
    negative = number.startswith("-")
    million = F.lit(10**12).cast(WIDE)
    micro = F.abs(whole).cast(WIDE) * million + places
    return to_long(div_round(F.when(negative, -micro).otherwise(micro) * size, million, mode))


def checked_add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def saturating_add(a: Column, b: Column) -> Column:
    total = a.cast(WIDE) + b.cast(WIDE)
    return F.greatest(F.least(total, F.lit(2**63 - 1).cast(WIDE)), F.lit("-9223372036854775808").cast(WIDE)).cast("long")


def fiftieths(value: Column) -> Column:
    """Thousandths of a percent of fiftieths of a percent."""
    return F.try_multiply(value.cast("long"), F.lit(20).cast("long"))


def percentage_of(percent: Column, value: Column, mode: str) -> Column:
    """A percentage in thousandths of a percent of a length."""
    return scale(value, percent, 100_000, mode)


#: Fraction bits of fixed-point numbers.
FIXED = 32


def fixed_ratio(numerator: Column, denominator: Column, mode: str) -> Column:
    return scale(numerator, 2**FIXED, denominator, mode)


def fixed_mul(fixed: Column, value: Column, mode: str) -> Column:
    return scale(value, fixed, 2**FIXED, mode)


#: An angle's full turn, in sixty-thousandths of a degree.
TURN = 21_600_000


def normal_angle(angle: Column) -> Column:
    return F.pmod(angle, F.lit(TURN))


def _fixed_sine(angle: int) -> int:
    """Sine of an angle in sixty-thousandths of a degree, to 32 fraction bits, rounded half to even from 40 digits."""
    from decimal import ROUND_HALF_EVEN, Decimal, getcontext

    getcontext().prec = 50
    pi = Decimal("3.14159265358979323846264338327950288419716939937510")
    angle %= TURN
    sign = 1
    if angle >= TURN // 2:
        angle, sign = angle - TURN // 2, -1
    if angle > TURN // 4:
        angle = TURN // 2 - angle
    x = Decimal(angle) * pi * 2 / TURN
    term, total, n = x, x, 1
    while abs(term) > Decimal(10) ** -45:
        term = -term * x * x / ((n + 1) * (n + 2))
        total += term
        n += 2
    return sign * int((total * 2**FIXED).to_integral_value(ROUND_HALF_EVEN))


@F.pandas_udf(LongType())
def fixed_sin(angle: pd.Series) -> pd.Series:
    """Doubles are not promised to round right, so the series is summed in decimals, once for each distinct angle of a batch."""
    known = {a: _fixed_sine(int(a)) for a in angle.dropna().unique()}
    return angle.map(known).astype("Int64")


def fixed_cos(angle: Column) -> Column:
    return fixed_sin(angle + F.lit(TURN // 4))


def affine(matrix: list[Column], x: Column, y: Column, mode: str = "half_even") -> tuple[Column, Column]:
    """(x', y') of a point by the fixed-point matrix (a, b, c, d) and whole offsets (e, f): x' = a x + c y + e."""
    a, b, c, d, e, f = matrix
    one = F.lit(2**FIXED).cast(WIDE)

    def row(p: Column, q: Column, shift: Column) -> Column:
        return to_long(div_round(p.cast("decimal(19,0)") * x.cast("decimal(18,0)") + q.cast("decimal(19,0)") * y.cast("decimal(18,0)"), one, mode) + shift)

    return row(a, c, e), row(b, d, f)


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle; null if there is none."""
    x0, y0 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    x1, y1 = F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), rect(x0, y0, x1, y1))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def inset(a: Column, by: Column) -> Column:
    """Smaller by `by` on each side, larger if negative; null if nothing is left."""
    r = rect(a["x0"] + by, a["y0"] + by, a["x1"] - by, a["y1"] - by)
    return F.when((a["x0"] + by < a["x1"] - by) & (a["y0"] + by < a["y1"] - by), r)


def contains(a: Column, x: Column, y: Column) -> Column:
    return (x >= a["x0"]) & (x < a["x1"]) & (y >= a["y0"]) & (y < a["y1"])


def share_text(count: Column, total: Column) -> Column:
    """`12.5%`; a dash of nothing."""
    t = div_round(count * 1000 + div_round(total, F.lit(2), "floor"), total, "floor").cast("long")
    return F.when(total == 0, F.lit("–")).otherwise(F.concat(div_round(t, F.lit(10), "floor").cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string"), F.lit("%")))


def per_mille(part: Column, total: Column) -> Column:
    """Thousandths, rounded half up."""
    return to_long(div_round(part * 1000 + div_round(total, F.lit(2), "floor").cast("long"), total, "floor"))


def mebibytes(size: Column) -> Column:
    """`1.5 MiB`: tenths, rounded half up."""
    tenths = div_round(size * 10 + F.lit(524_288), F.lit(1_048_576), "floor").cast("long")
    return F.concat(div_round(tenths, F.lit(10), "floor").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(" MiB"))


#: Histogram bins: values below EXACT have their own, others share the power of two and the next ten bits.
EXACT, SUB = 2048, 1024


def histogram_bin(value: Column) -> Column:
    """Of a value that is not negative."""
    exponent = F.length(F.bin(value)) - 1
    mantissa = F.call_function("shiftright", value, exponent - 10) - SUB
    return F.when(value < EXACT, value).otherwise((exponent - 11) * SUB + mantissa + EXACT).cast("long")


def bin_start(number: Column) -> Column:
    """The least value of a bin."""
    exponent = F.floor((number - EXACT) / SUB).cast("int") + 11
    mantissa = F.pmod(number - EXACT, F.lit(SUB)) + SUB
    return F.when(number < EXACT, number).otherwise(F.call_function("shiftleft", mantissa.cast("long"), exponent - 10)).cast("long")


def days_of(text: Column) -> Column:
    """Days since 1970 of an RFC 3339 time; null if malformed."""
    stamp = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.]\d+)?(?:Z|[+-]\d\d:\d\d)$"), text).try_cast("timestamp")
    return F.unix_date(stamp.cast("date"))
