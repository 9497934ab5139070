"""Line normalisation as Catalyst expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points stripped from both ends of a line. Spark's own
# trim() removes U+0020 only, which would keep tabs, CR and Unicode spaces.
WHITESPACE_CODE_POINTS = (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760,
    8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
    8232, 8233, 8239, 8287, 12288,
)
WHITESPACE = "".join(chr(c) for c in WHITESPACE_CODE_POINTS)

LF = "\n"
UNIVERSAL_NEWLINE = "\r\n|\n|\r"
REPLACEMENT = "\ufffd"


def strip(value: Column) -> Column:
    """Remove every kind of white space from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def normalise_query(value: Column) -> Column:
    """Drop NULs at the ends of a request, then white space. NULs inside stay."""
    return strip(F.btrim(value, F.lit("\0")))


def decode_lossy(payload: Column) -> Column:
    """Decode a binary request, leaving out bytes that are not UTF-8.

    A U+FFFD that the sender really wrote survives: it is hidden behind a
    private marker before the invalid bytes are turned into U+FFFD and removed.
    """
    text = payload.cast("string")
    marker = "\ufffelineseek\ufffe"
    shielded = F.make_valid_utf8(F.replace(text, F.lit(REPLACEMENT), F.lit(marker)))
    cleaned = F.replace(F.replace(shielded, F.lit(REPLACEMENT), F.lit("")), F.lit(marker), F.lit(REPLACEMENT))
    return F.when(F.is_valid_utf8(text), text).otherwise(cleaned)


def number(value: Column, digits: int = 2, thousands: bool = False) -> Column:
    """Fixed-digit text of a double, for messages and reports only; ``thousands`` are set apart by commas."""
    return F.format_string(f"%{',' if thousands else ''}.{digits}f", value)
