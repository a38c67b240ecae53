"""Word rules that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def lower_ascii(text: str) -> str:
    """Lower-case A to Z and leave every other character."""
    return text.translate(_LOWER) if not text.isascii() else text.lower()


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text in order; an empty array for a null or blank text."""
    return F.array_remove(F.split(text_or_empty(text), GAP), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
