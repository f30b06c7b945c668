"""Column helpers shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of digits, letters and everything beyond ASCII (Java syntax).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, so code points stay where they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words as an array; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def joined(values: Column) -> Column:
    """Distinct strings, sorted and comma-joined; an empty string for none."""
    return F.concat_ws(",", F.array_sort(F.array_distinct(values)))
