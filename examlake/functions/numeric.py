"""Numeric expressions: tolerant parsing, range checks, row means, rounding, bins and bands."""

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from examlake.fixed_values import SCORE_MAX

NUMBER_PATTERN = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"


def parse_number(c: Column) -> Column:
    """Text (or number) to double; comma is the decimal mark, anything else becomes null.

    The pattern keeps out literals only the JVM accepts, such as ``1d`` or ``NaN``. The input is
    used once in the expression, so it is evaluated once.
    """
    text = F.replace(F.trim(c.cast("string"), F.lit(" \t\n\x0b\f\r")), F.lit(","), F.lit("."))
    return F.regexp_extract(text, NUMBER_PATTERN, 1).try_cast("double")


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), 0)


def parse_integer(c: Column) -> Column:
    """Like ``parse_number``, then rounded half-even to a bigint."""
    return F.rint(parse_number(c)).try_cast("bigint")


def drop_nan(c: Column) -> Column:
    """NaN to null. Spark orders NaN above every number, so it would pass ``>=`` filters."""
    return F.nullif(c, F.lit(float("nan")))


def within(c: Column, low: float, high: float) -> Column:
    """The value when it lies in [low, high], else null."""
    return F.when(c.between(low, high), c)


def row_mean(cols: list[Column]) -> Column:
    """Mean of the non-null values in a row; null when there are none."""
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(add, [c.isNotNull().cast("int") for c in cols])
    return F.when(present > 0, total / present)


def round_half_even(c: Column, digits: int) -> Column:
    """Half-even rounding by scaling, the way numeric Python libraries round arrays."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def bin_index(c: Column, low: float, high: float, bins: int) -> Column:
    """Index of the equal-width bin holding the value; the last bin is closed on the right.

    The quotient can land one bin off next to an edge, so it is corrected against the edges.
    """
    width = (high - low) / bins
    guess = F.floor((c - low) / width)
    edge = lambda i: low + i * width
    exact = F.when(c < edge(guess), guess - 1).when(c >= edge(guess + 1), guess + 1).otherwise(guess)
    return F.least(exact, F.lit(bins - 1)).cast("int")


def band_case(value: Column, bands: list[tuple], pick: int) -> Column:
    """Id (``pick=0``) or description (``pick=3``) of the band holding the value.

    Bands are [low, high) except one ending at the top of the score range, which is closed.
    Values in no band fall to the first band.
    """
    chain = None
    for band in bands:
        _, low, high, _ = band
        inside = (value >= low) & ((value <= high) if high == SCORE_MAX else (value < high))
        branch = (chain if chain is not None else F).when(inside, F.lit(band[pick]))
        chain = branch
    return chain.otherwise(F.lit(bands[0][pick]))


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small literal map, or null. Only for the fixed tables of this package."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)
