"""FN05 / FN25: 802.11 reason codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# IEEE 802.11 reason codes and their meanings.
REASON_CODES = {
    0: "Reserved",
    1: "Unspecified reason",
    2: "Previous authentication no longer valid",
    3: "Deauthenticated because sending STA is leaving BSS",
    4: "Disassociated due to inactivity",
    5: "Disassociated because AP is unable to handle all associated STAs",
    6: "Class 2 frame received from nonauthenticated STA",
    7: "Class 3 frame received from nonassociated STA",
    8: "Disassociated because sending STA is leaving BSS",
    9: "STA requesting association is not authenticated with responding STA",
    10: "Disassociated because of unacceptable power capability",
    11: "Disassociated because of unacceptable supported channels",
    12: "Disassociated due to BSS transition management",
    13: "Invalid element",
    14: "MIC failure",
    15: "4-Way Handshake timeout",
    16: "Group Key Handshake timeout",
    17: "Element in 4-Way Handshake different from (Re)Association Request",
    18: "Invalid group cipher",
    19: "Invalid pairwise cipher",
    20: "Invalid AKMP",
    21: "Unsupported RSNE version",
    22: "Invalid RSNE capabilities",
    23: "IEEE 802.1X authentication failed",
    24: "Cipher suite rejected because of security policy",
    25: "TDLS teardown - unreachable peer",
    26: "TDLS teardown - unspecified reason",
    32: "Disassociated for unspecified QoS-related reason",
    33: "Disassociated because AP lacks bandwidth for this QoS STA",
    34: "Disassociated because of excessive unacknowledged frames",
    35: "Disassociated because STA is transmitting outside the limits of its TXOPs",
    36: "Requested from peer STA as the STA is leaving the BSS",
    37: "Requested from peer STA as it does not want to use this mechanism",
    38: "Requested from peer STA as the STA received frames using the mechanism",
    39: "Requested from peer STA due to timeout",
    45: "Peer STA does not support the requested cipher suite",
    46: "Disassociated - authorized access limit reached",
    47: "Disassociated - external service requirements",
}

# Codes that deauthentication tools send by default.
SIGNATURE_REASONS = (1, 7)


def reason_text(code: Column) -> Column:
    """FN05: meaning of a reason code; NULL stays NULL."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(REASON_CODES.items())])
    unknown = F.concat(F.lit("Reserved/unknown reason code "), code.cast("string"))
    return F.coalesce(F.try_element_at(table, code.cast("int")), unknown)


def is_signature(code: Column) -> Column:
    """FN25: whether a code is a tool's default."""
    return F.coalesce(code.isin(*SIGNATURE_REASONS), F.lit(False))
