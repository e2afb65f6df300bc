"""Key cleaning and string-to-value parsing.

All of these are built-in string functions, evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space set, which is what the reference's
# whitespace squish collapses (an ICU class).  Written out so the Spark
# (Java regex) and the oracle (RE2) use the very same character class.
WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
ASCII_SPACES = "\t\n\x0b\f\r"  # those of the class, but for the space


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squish(c: Column | str) -> Column:
    """Trim and collapse every run of whitespace to one space.

    ASCII text without tabs and line breaks, as most names are, has only runs of spaces to
    collapse, and halving them twice leaves one of each run of up to four; the class, which
    is slow, is searched for in other text and in text of longer runs only.  Lengths and
    plain searches tell the two apart: no pattern is run over a plain name.
    """
    text = _col(c)
    plain = F.octet_length(text) == F.char_length(text)
    for other in (*ASCII_SPACES, " " * 5):
        plain = plain & ~text.contains(other)
    halved = F.replace(F.replace(text, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" "))
    cut = F.when(~plain, F.regexp_replace(text, WHITESPACE_CLASS + "+", " "))
    return F.trim(cut.when(text.contains("  "), halved).otherwise(text))


def normalize_key(c: Column | str) -> Column:
    """Join-key form of a shop or item name: squished, lower case."""
    return F.lower(squish(c))


def truncate_at_newline(c: Column | str) -> Column:
    """Drop carriage returns and everything from the first line feed.

    Later line breaks go with the rest, so ``a\\nb\\rc`` gives ``a``.
    """
    return F.substring_index(F.replace(_col(c), F.lit("\r"), F.lit("")), "\n", 1)


def item_key(c: Column | str) -> Column:
    """Order-item key: first line only, then normalised."""
    return normalize_key(truncate_at_newline(c))


def date_part_of_update(c: Column | str) -> Column:
    """Text before the first comma of a 'last update' stamp."""
    return F.substring_index(_col(c), ",", 1)


def parse_amount(c: Column | str) -> Column:
    """Amount text with thousands separators to double; bad text is null (P10)."""
    return F.replace(_col(c), F.lit(","), F.lit("")).try_cast("double")


def parse_number(c: Column | str) -> Column:
    """Text to double; text that is not a number is null, not an error."""
    return _col(c).try_cast("double")
