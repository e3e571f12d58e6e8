"""Decoding of text cells: names with accents, and numbers with a decimal comma."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks, and what they become.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"


def without_accents(text: Column) -> Column:
    return F.translate(text, MARKED, PLAIN)


def canonical_name(text: Column) -> Column:
    """Upper case, no accents, single spaces, none at the ends."""
    return F.upper(F.trim(F.regexp_replace(without_accents(text), r"\s+", " ")))


def local_number(text: Column) -> Column:
    """'95.178,58' -> 95178.58; null for empty or broken cells."""
    plain = F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("double")
