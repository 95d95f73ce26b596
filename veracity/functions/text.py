"""Scalar expressions of the analyzers, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_upper(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, (1 << 31) - 2))


def title_key(c: Column) -> Column:
    """Blanks as underscores, first letter upper."""
    return first_upper(F.replace(F.trim(c), F.lit(" "), F.lit("_")))


def is_cardinality(c: Column) -> Column:
    return F.trim(c).rlike(r"^\d+$")


def leading_int(c: Column) -> Column:
    """The number that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d{1,18})", 1).try_cast("long"), F.lit(0).cast("long"))


def units_of(spec: Column) -> Column:
    """Units of a conversion text like `1000 g, gram`: what follows the first blank, split at commas."""
    return F.transform(F.split(F.regexp_extract(F.trim(spec), r"^\S+\s+(.*)$", 1), ","), lambda u: F.trim(u))


def xml_id(c: Column) -> Column:
    """A name as an XML id, different for different names.

    Letters but Z and underscores stay, as do digits and hyphens after the first character; of any other character its
    UTF-8 bytes in hexadecimal digits stand there, between Z and a dot.
    """
    keep = lambda x, i: x.rlike(r"^[\p{L}_]$|^[\p{N}-]$") & ((i > 0) | x.rlike(r"^[\p{L}_]$")) & (x != "Z")
    coded = lambda x: F.concat(F.lit("Z"), F.hex(F.encode(x, "UTF-8")), F.lit("."))
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1)), lambda x, i: F.when(keep(x, i), x).otherwise(coded(x))), "")


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")  # characters that XML can't hold


def without_category(text: Column, category: str) -> Column:
    """Wikitext without the links to a category."""
    return F.regexp_replace(text, r"(?i)\[\[\s*category\s*:\s*\Q" + category + r"\E\s*(\|[^\]]*)?\]\]", "")


def iso_time(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(F.replace(c, F.lit("/"), F.lit("-"))), "yyyy-MM-dd'T'HH:mm:ss")


def payload(value: Column, value_int: Column) -> Column:
    return F.coalesce(F.when(value != "", value), value_int.cast("string"))


def number_and_unit(c: Column) -> Column:
    """struct(value double, unit string) of texts like `1,234.5 km`: commas between digits group thousands."""
    number = F.regexp_extract(c, r"^\s*([+-]?[\d,]*\.?\d+(?:[eE][+-]?\d+)?)", 1)
    return F.struct(F.regexp_replace(number, ",", "").try_cast("double").alias("value"), F.trim(F.regexp_replace(c, r"^\s*[+-]?[\d,]*\.?\d+(?:[eE][+-]?\d+)?", "")).alias("unit"))


def first_number(c: Column) -> Column:
    """The number that a text begins with, without grouping commas, as it is written; null without one."""
    found = F.regexp_replace(F.regexp_extract(c, r"^\s*([+-]?[\d,]*\.?\d+(?:[eE][+-]?\d+)?)", 1), ",", "")
    return F.when(found != "", found)


def converted(c: Column, factor: Column) -> Column:
    """The number of a text in the base unit: divided by how many of its unit make one base unit."""
    return number_and_unit(c)["value"] / F.when(factor != 0, factor)


def factor_of(spec: Column) -> Column:
    """The number before a conversion text's first blank."""
    return F.regexp_extract(F.trim(spec), r"^(\S+)\s", 1).try_cast("double")


def has_suffix(c: Column, suffix: str) -> Column:
    """Whether a type's id ends with the suffix."""
    return F.right(c, F.lit(len(suffix))) == suffix


def links_of(titles: Column) -> Column:
    """Titles between semicolons as links, in order."""
    kept = F.filter(F.transform(F.split(titles, ";"), lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(kept, lambda t: F.concat(F.lit("[["), t, F.lit("]]")))
