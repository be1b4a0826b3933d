"""Scalar expressions with the white space and number rules of the layout operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space that trimming and normalising know, wider than Java's \s
WHITE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def normalize(c: Column) -> Column:
    """Trimmed, lowered, white space collapsed to single blanks."""
    return F.lower(trim(F.regexp_replace(c, f"{WHITE}+", " ")))


def non_numeric(c: Column) -> Column:
    """Something is left without commas, dots and white space, and it isn't all ASCII digits."""
    bare = F.regexp_replace(c, f"[,.]|{WHITE}", "")
    return (bare != "") & ~bare.rlike("^[0-9]+$")


def numeric(c: Column) -> Column:
    bare = F.regexp_replace(c, f"[,.]|{WHITE}", "")
    return bare.rlike("^[0-9]+$")


def tokens(c: Column) -> Column:
    """Lowered runs of letters and numbers."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def integer_text(c: Column) -> Column:
    """Digits, with a sign and commas anywhere."""
    return F.replace(trim(c), F.lit(","), F.lit("")).rlike("^-?[0-9]+$")
