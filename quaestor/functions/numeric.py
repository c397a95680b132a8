"""Numbers and vectors as columns: tolerances, derived values, costs, norms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def within_one_sided(claim: Column, real: Column, tolerance: float) -> Column:
    """|claim - real| / |real| <= tolerance; a real zero only by zero."""
    return F.when(real == 0, claim == 0).otherwise(F.try_divide(F.abs(claim - real), F.abs(real)) <= tolerance)


def close(a: Column, b: Column, relative: float, absolute: float = 0.0) -> Column:
    """Symmetric tolerance; false if either isn't finite."""
    return finite(a) & finite(b) & (F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)))


def rounded_of(claim: Column, value: Column) -> Column:
    """Whether a claim is a value that isn't whole, rounded half to even."""
    return (value != F.floor(value)) & (F.bround(value) == claim)


def percent_change(first: Column, last: Column) -> Column:
    """Change in percent of the absolute first value; null from zero."""
    return F.try_divide(last - first, F.abs(first)) * 100


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a million tokens; null if anything is."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def strict_sum(x: Column) -> Column:
    """An aggregate: the sum, or null if any value is null."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def reciprocal_rank(rank: Column, constant: int = 60) -> Column:
    return F.lit(1.0).cast("double") / (constant + rank)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def normalized(v: Column) -> Column:
    """The vector at length 1; null if it is zero or not finite."""
    length = norm(v)
    return F.when(finite(length) & (length > 0), F.transform(v, lambda x: x.cast("double") / length))


# A number in prose and the words for its size.
PROSE_NUMBER = r"(?iuU)([0-9][0-9.,]*)\s*(billion|billones|mil millones|million|millones|millón|thousand|miles)?"
SIZES = {"billion": 1e9, "billones": 1e9, "mil millones": 1e9, "million": 1e6, "millones": 1e6, "millón": 1e6, "thousand": 1e3, "miles": 1e3}


def prose_numbers(text: Column) -> Column:
    """The numbers that a text names, in order, times the words of size behind them; what is no number after all is left out.

    With both marks the last one is the decimal's. A comma alone parts decimals unless three digits follow the last one;
    a point alone parts thousands where three digits follow the last one.
    """
    raw, size = (F.regexp_extract_all(text, F.lit(PROSE_NUMBER), F.lit(i)) for i in (1, 2))

    def value(pair: Column) -> Column:
        n = F.regexp_replace(pair["raw"], r"[.,]+$", "")
        tail = lambda mark: F.length(F.substring_index(n, mark, -1))
        comma, point = F.contains(n, F.lit(",")), F.contains(n, F.lit("."))
        without = lambda mark: F.replace(n, F.lit(mark), F.lit(""))
        decimal_comma = F.concat(F.replace(F.substring(n, F.lit(1), F.length(n) - tail(",") - 1), F.lit(","), F.lit("")), F.lit("."), F.substring_index(n, ",", -1))
        plain = (
            F.when(comma & point & (tail(",") < tail(".")), F.replace(without("."), F.lit(","), F.lit("."))).when(comma & point, without(","))
            .when(comma & (tail(",") != 3), decimal_comma).when(comma, without(",")).when(point & (tail(".") == 3), without(".")).otherwise(n)
        )
        factor = F.lit(1.0)
        for word, times in SIZES.items():
            factor = F.when(F.lower(pair["size"]) == word, times).otherwise(factor)
        return plain.try_cast("double") * factor

    pairs = F.zip_with(raw, size, lambda r, z: F.struct(r.alias("raw"), z.alias("size")))
    return F.filter(F.transform(pairs, value), lambda x: x.isNotNull())
