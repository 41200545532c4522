"""Words of texts: between ASCII white space by built-in functions, and runs of letters in Python."""

from __future__ import annotations

from functools import cache

import regex

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs that separate words.
SPACES = " \t\n\x0b\x0c\r"


@cache
def letter_runs() -> regex.Pattern:
    """Runs of letters (categories L*): numbers such as ½ and Ⅳ are none, which the standard library's classes cannot tell."""
    return regex.compile(r"\p{L}+")


def words_of(body: Column) -> Column:
    """The words of a text that is not null, in order."""
    inner = F.btrim(body, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
