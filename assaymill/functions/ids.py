"""Identifier cleaning shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space that carries no meaning around an identifier.
BLANKS = " \t\n\r\x0b\x0c   ​　﻿"
#: Words that stand for a missing value.
PLACEHOLDERS = ("", "-", "--", "?", ".", "N/A", "NA", "NAN", "NIL", "NONE", "NULL", "TBD", "UNKNOWN", "MISSING")


def trimmed(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def strict_id(c: Column | str) -> Column:
    """Trimmed upper-case id if it is letters followed by digits, else NULL."""
    t = F.upper(trimmed(c))
    return F.when(t.rlike("^[A-Z]+[0-9]+$"), t)


def loose_id(c: Column | str) -> Column:
    """Trimmed upper-case label, NULL for blanks and placeholder words."""
    t = F.upper(trimmed(c))
    return F.when(~t.isin(*PLACEHOLDERS), t)


def sql_strict_id(c: str) -> str:
    """The DuckDB twin of strict_id."""
    t = f"upper(trim({c}, {_SQL_BLANKS}))"
    return f"CASE WHEN regexp_full_match({t}, '[A-Z]+[0-9]+') THEN {t} END"


def sql_loose_id(c: str) -> str:
    t = f"upper(trim({c}, {_SQL_BLANKS}))"
    return f"CASE WHEN {t} NOT IN ({', '.join(repr(p) for p in PLACEHOLDERS)}) THEN {t} END"


_SQL_BLANKS = "'" + BLANKS + "'"
