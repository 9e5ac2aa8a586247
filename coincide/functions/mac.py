"""FN01-FN04: hardware addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coincide.functions.let import let
from coincide.schema import BROADCAST

# Accepted spellings of an address.
_PAIRS = r"^([0-9a-f]{2})[:\-.]?([0-9a-f]{2})[:\-.]?([0-9a-f]{2})[:\-.]?([0-9a-f]{2})[:\-.]?([0-9a-f]{2})[:\-.]?([0-9a-f]{2})$"
_IN_TEXT = r"\b((?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2})\b"


def norm_mac(value: Column) -> Column:
    """FN01: any spelling to lower colon form; NULL if it is no address."""
    cleaned = F.lower(F.regexp_replace(value.cast("string"), r"\s", ""))
    return let(
        cleaned,
        lambda c: F.when(
            c.rlike(_PAIRS), F.regexp_replace(c, _PAIRS, "$1:$2:$3:$4:$5:$6")
        ),
    )


def mac_in_text(text: Column) -> Column:
    """FN02: the first colon-form address in a text."""
    return let(F.regexp_extract(text, _IN_TEXT, 1), lambda m: F.when(m != "", F.lower(m)))


def is_broadcast(mac: Column) -> Column:
    """FN03."""
    return F.coalesce(norm_mac(mac) == BROADCAST, F.lit(False))


def is_group_addressed(mac: Column) -> Column:
    """FN03: broadcast or multicast, by the I/G bit of the first octet."""
    octet = F.conv(F.substring(norm_mac(mac), 1, 2), 16, 10).cast("int")
    return F.coalesce(octet.bitwiseAND(1) == 1, F.lit(False))


def client_of_target(mac: Column) -> Column:
    """FN04: the affected client, unless the target is a group."""
    return F.when(~is_group_addressed(mac), norm_mac(mac))


def mac_of_bytes(raw: Column) -> Column:
    """Six bytes in colon form."""
    return F.regexp_replace(F.lower(F.hex(raw)), r"(..)(?=.)", "$1:")
