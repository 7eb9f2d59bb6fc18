"""Words of letters and digits as Catalyst expressions, shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import ascii_lower

#: What stands between words: ASCII that is neither a digit nor a letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def gapped(text: Column) -> Column:
    """A-Z lower-cased, one space for whatever stands between words; null is empty."""
    return F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAP, " ")


def normalized(text: Column) -> Column:
    """As ``gapped``, without a space at either end."""
    return F.trim(gapped(text))


def word_count(norm: Column) -> Column:
    spaces = F.char_length(norm) - F.char_length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(norm == "", F.lit(0).cast("long")).otherwise((spaces + 1).cast("long"))


def word_array(text: Column) -> Column:
    """The words of a text; an empty array where it has none."""
    return F.array_remove(F.split(gapped(text), " ", -1), "")
