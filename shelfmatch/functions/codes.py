"""Product codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmatch.functions.text import strip

NOT_FOUND = "NOT_FOUND"


def normalize_code(c) -> Column:
    """Without a dash and number at the end, stripped, and without the first digit of a number of
    several. Applied twice it takes two digits away."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(strip(F.regexp_replace(c, r"-\d+$", "")), r"^\d(\d+)$", "$1")
