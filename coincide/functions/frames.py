"""FN21-FN23: fields of 802.11 frames and of tables about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of frame subtypes, tested in this order.
DEAUTH_TOKENS = ("deauth", "0x000c", "0x0c", "12", "deauthentication")
DISASSOC_TOKENS = ("disassoc", "0x000a", "0x0a", "10", "disassociation")


def frame_kind(subtype: Column, reason: Column) -> Column:
    """FN21: deauth, disassoc or NULL. Without a subtype, a reason code means deauth."""
    token = F.lower(F.trim(F.coalesce(subtype, F.lit(""))))
    has_reason = F.trim(F.coalesce(reason, F.lit(""))) != ""
    return (
        F.when(token.rlike("|".join(DEAUTH_TOKENS)), "deauth")
        .when(token.rlike("|".join(DISASSOC_TOKENS)), "disassoc")
        .when((token == "") & has_reason, "deauth")
    )


def int_or_none(text: Column) -> Column:
    """FN22: decimal, float or ``0x`` text as an integer; NULL if it is none."""
    trimmed = F.lower(F.trim(text))
    hexed = F.conv(F.substring(trimmed, 3, 16), 16, 10).try_cast("int")
    return F.when(trimmed.rlike("^0x[0-9a-f]+$"), hexed).otherwise(
        trimmed.try_cast("double").try_cast("int")
    )


def channel_of(mhz: Column) -> Column:
    """FN23: channel number of a centre frequency."""

    def steps(base: int) -> Column:
        return F.call_function("div", mhz - base, F.lit(5)).cast("int")

    return (
        F.when(mhz == 2484, 14)
        .when(mhz.between(2412, 2484), steps(2407))
        .when(mhz.between(5000, 5900), steps(5000))
        .when(mhz.between(5955, 7115), steps(5955) + 1)
    )
