"""Text expressions: escaped search, line and branch names, natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_like(term: str) -> str:
    """A search term with LIKE's wildcards made literal."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ignoring_case(column: Column, term: str) -> Column:
    return column.ilike(f"%{escape_like(term)}%")


def line_of(short_name: Column) -> Column:
    """Leading digits, or else leading letters, in upper case; null if there are neither."""
    found = F.regexp_extract(short_name, r"^\s*(\d+|[A-Za-z]+)", 1)
    return F.upper(F.nullif(found, F.lit("")))


def branch_of(short_name: Column) -> Column:
    """What follows the line, or TRONCAL."""
    rest = F.trim(F.regexp_replace(short_name, r"^\s*(\d+|[A-Za-z]+)", ""))
    return F.coalesce(F.nullif(rest, F.lit("")), F.lit("TRONCAL"))


def natural_number(name: Column) -> Column:
    """The number a name starts with, for ordering; null without one."""
    return F.regexp_extract(name, r"^\s*(\d{1,9})", 1).try_cast("int")


def unescape_percent(text: str) -> str:
    """``%20%`` style escapes (hexadecimal code point between two signs) to characters."""
    import re

    return re.sub(r"%([0-9a-fA-F]{1,6})%", lambda m: chr(int(m.group(1), 16)), text)
