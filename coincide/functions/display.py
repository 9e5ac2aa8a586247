"""FN18 / FN19 / FN27: text forms of numbers, durations and blank cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coincide.functions.let import let

# Spellings of a missing cell.
BLANKS = ("", "nan", "none", "<na>", "nat")


def text(value: Column) -> Column:
    """FN19: trimmed text, NULL for every spelling of a missing value."""
    trimmed = F.trim(value.cast("string"))
    return F.when(~F.lower(trimmed).isin(*BLANKS), trimmed)


def cell(value: Column) -> Column:
    return F.coalesce(text(value), F.lit("-"))


def _decimal(units: Column, digits: int) -> Column:
    """``units`` of 10**-digits as decimal text."""
    whole = F.call_function("div", units, F.lit(10**digits)).cast("string")
    if digits == 0:
        return whole
    part = F.lpad((units % F.lit(10**digits)).cast("string"), digits, "0")
    return F.concat(whole, F.lit("."), part)


def humanize_delta(delta_us: Column) -> Column:
    """FN18: a signed distance in words, from integer microseconds."""
    mag = F.abs(delta_us)

    def div(numerator: Column, by: int) -> Column:
        return F.call_function("div", numerator + F.lit(by // 2), F.lit(by))

    size = (
        F.when(mag < 1_000_000, F.concat(_decimal(div(mag, 1_000), 0), F.lit(" ms")))
        .when(mag < 90_000_000, F.concat(_decimal(div(mag, 100_000), 1), F.lit(" s")))
        .when(mag < 5_400_000_000, F.concat(_decimal(div(mag, 6_000_000), 1), F.lit(" min")))
        .otherwise(F.concat(_decimal(div(mag, 36_000_000), 2), F.lit(" h")))
    )
    return (
        F.when(delta_us.isNull(), "n/a")
        .when(delta_us < 0, F.concat(size, F.lit(" before")))
        .when(delta_us > 0, F.concat(size, F.lit(" after")))
        .otherwise("simultaneous")
    )


def fixed(value: Column, digits: int) -> Column:
    """``digits`` decimals, rounded from the exact value of the double, ties to even."""
    return F.translate(F.format_number(value, digits), ",", "")


def scientific(value: Column, digits: int) -> Column:
    """Mantissa with ``digits`` decimals and an exponent of at least two digits."""
    pattern = "0." + "0" * digits + "E00" if digits else "0E00"
    shown = F.lower(F.call_function("format_number", value, F.lit(pattern)))
    return F.regexp_replace(shown, r"e(?=\d)", "e+")


def general(value: Column, digits: int = 6) -> Column:
    """A number with ``digits`` significant digits and no trailing zeros ('%g' style)."""

    def trim_zeros(t: Column) -> Column:
        return F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)

    def text_of(sci: Column) -> Column:
        power = F.substring_index(sci, "e", -1).cast("int")
        shown = F.substring_index(sci, "e", 1)
        figures = F.regexp_replace(shown, r"\.", "")
        above = F.concat(
            F.rpad(figures, digits + 1, "0").substr(F.lit(1), power + 1),
            F.lit("."),
            figures.substr(power + 2, F.lit(digits)),
        )
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
        exponent = F.concat(F.lit("e"), F.substring_index(sci, "e", -1))
        return (
            F.when((power < -4) | (power >= digits), F.concat(trim_zeros(shown), exponent))
            .when(power >= 0, trim_zeros(above))
            .otherwise(trim_zeros(below))
        )

    sign = F.when(value < 0, "-").otherwise("")
    body = let(scientific(F.abs(value), digits - 1), text_of)
    return (
        F.when(value == 0, "0")
        .when(F.abs(value) == float("inf"), F.concat(sign, F.lit("inf")))
        .otherwise(F.concat(sign, body))
    )


def p_text(p: Column) -> Column:
    """FN27: a p-value for a report table."""
    return (
        F.when(p.isNull() | F.isnan(p), "n/a")
        .when(p < 1e-4, scientific(p, 2))
        .otherwise(fixed(p, 4))
    )


def number_text(value: Column) -> Column:
    """FN27: a ratio for a report table."""
    return (
        F.when(value.isNull() | F.isnan(value), "n/a")
        .when(value == float("inf"), "infinite (no counter-examples)")
        .otherwise(fixed(value, 3))
    )


def lift_text(lift: Column) -> Column:
    """FN27: how far the observed rate lies above the baseline."""
    return (
        F.when(lift.isNull() | F.isnan(lift), "not comparable to")
        .when(lift == float("inf"), "infinitely above")
        .otherwise(F.concat(fixed(lift, 1), F.lit(" times")))
    )
