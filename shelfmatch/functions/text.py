"""Cleaning and expanding product descriptions, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviation -> description.
ABBREVIATIONS = {
    "Bn-in": "Bone in",
    "Bnls": "Boneless",
    "Cntr Cut": "Center Cut",
    "Cov": "Cover",
    "Dkle": "Deckle",
    "Dfatd": "Defatted",
    "Dnd": "Denuded",
    "Dia": "Diamond",
    "Div": "Divided",
    "Ex": "Extra",
    "Fr": "Fresh",
    "Frz": "Frozen",
    "Grnd": "Ground",
    "Inter": "Intermediate",
    "IM": "Individual Muscle",
    "Nk-off": "Neck off",
    "NTE": "Not to Exceed",
    "Oven-Prep": "Oven-Prepared",
    "Part": "Partially",
    "Pld": "Peeled",
    "Prthse": "Porterhouse",
    "Portn": "Portion",
    "Reg": "Regular",
    "Rst-Rdy": "Roast-Ready",
    "Rst": "Roast",
    "Rnd": "Round",
    "Sh Cut": "Short Cut",
    "Shld": "Shoulder",
    "Sirln": "Sirloin",
    "Sknd": "Skinned",
    "Sp": "Special",
    "Sq-Cut": "Square Cut",
    "Stk": "Steak",
    "Tender": "Tenderloin",
    "Tri Tip": "Triangle Tip",
    "Trmd": "Trimmed",
    "Untrmd": "Untrimmed",
}


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space at either end, of any kind (SQL's trim knows blanks only)."""
    return F.regexp_replace(_column(c), r"(?U)^\s+|\s+$", "")


def normalize_description(c) -> Column:
    return F.lower(strip(c))


def clean_text(c) -> Column:
    """Lower case, stripped, runs of white space as one blank. Null stays null."""
    return F.regexp_replace(normalize_description(c), r"(?U)\s+", " ")


def expand_abbreviations(c, case_sensitive: bool = True) -> Column:
    """Whole-word replacement, the longest abbreviation first.

    Abbreviations hold capitals, so after ``clean_text`` nothing is replaced unless case is ignored.
    """
    flags = "(?U)" if case_sensitive else "(?Ui)"
    ordered = sorted(ABBREVIATIONS, key=len, reverse=True)
    return reduce(lambda out, key: F.regexp_replace(out, rf"{flags}\b{re.escape(key)}\b", ABBREVIATIONS[key]), ordered, _column(c))


def expand_columns(df: DataFrame, columns: list[str], case_sensitive: bool = True) -> DataFrame:
    """``df`` with the named columns expanded; names it doesn't have are passed over."""
    return df.withColumns({c: expand_abbreviations(c, case_sensitive) for c in columns if c in df.columns})


def clean_and_expand(c, case_sensitive: bool = True) -> Column:
    return expand_abbreviations(clean_text(c), case_sensitive)


def variants(c, lower: bool = False) -> Column:
    """``a; b ;c`` -> array of stripped parts."""
    return F.transform(F.split(_column(c), ";", -1), lambda x: F.lower(strip(x)) if lower else strip(x))


def enhanced_description(desc, price=None, quantity=None) -> Column:
    """Description with average price (two decimals) and quantity (one), where there are any; halves go away from zero."""
    fixed = lambda c, n: F.round(_column(c).cast("decimal(28,10)"), n).cast(f"decimal(28,{n})").cast("string")
    parts = [_column(desc)]
    if price is not None:
        parts.append(F.coalesce(F.concat(F.lit(", average price: $"), fixed(price, 2)), F.lit("")))
    if quantity is not None:
        parts.append(F.coalesce(F.concat(F.lit(", average quantity: "), fixed(quantity, 1)), F.lit("")))
    return F.concat(*parts)


def word_boundary_match(a, b) -> Column:
    """One text holds the other between word boundaries, either way round; letter case is ignored."""
    x, y = F.lower(_column(a)), F.lower(_column(b))
    quoted = lambda c: F.concat(F.lit(r"\b"), F.regexp_replace(c, r"([\\\[\](){}.*+?^$|#&~\-])", r"\\$1"), F.lit(r"\b"))
    return F.rlike(y, quoted(x)) | F.rlike(x, quoted(y))
