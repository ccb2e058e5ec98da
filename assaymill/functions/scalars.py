"""Scalar expressions with the semantics the engine needs on every platform (ANSI mode, NaN, half-even rounding, float text)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

INF = float("inf")


def finite(c: Column | str) -> Column:
    """The value if it is a finite number, else NULL: NaN and infinities are missing values here."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def is_finite(c: Column | str) -> Column:
    return finite(c).isNotNull()


def integral_text(c: Column | str) -> Column:
    """``"1234.0"`` as ``"1234"``."""
    return F.regexp_replace(c, r"\.0+$", "")


def name_key(c: Column | str) -> Column:
    """Lower case without blanks and punctuation that spellings differ in."""
    return F.regexp_replace(F.lower(c), r"[-_;\s/.]", "")


def canonical_number(c: Column | str) -> Column:
    """Decimal text of a double without exponent or trailing zeros, equal for equal numbers."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.format_string("%.10f", c)
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ".0"))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8, symmetric: bool = False) -> Column:
    """``|a - b| <= atol + rtol |b|``; symmetric: ``<= max(rtol max(|a|, |b|), atol)``."""
    bound = F.greatest(F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)), F.lit(atol)) if symmetric else F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.abs(a - b) <= bound


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def micromolar_pic50(ln_ic50: Column | str) -> Column:
    """pIC50 = 6 - ln(IC50 in micromolar) / ln 10."""
    c = F.col(ln_ic50) if isinstance(ln_ic50, str) else ln_ic50
    return F.lit(6.0) - c / F.lit(math.log(10.0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tanimoto(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of set positions; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def pick(values: Column | str, positions: Column | str) -> Column:
    """Elements at zero-based positions, NULL outside the array."""
    v = F.col(values) if isinstance(values, str) else values
    return F.transform(positions, lambda i: F.get(v, i))


def values_agree(a: object, b: object, rtol: float = 1e-12, atol: float = 1e-12) -> bool:
    """Nested documents equal in keys, lengths, types and values; only floats have a tolerance, NaN agrees with nothing."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(values_agree(a[k], b[k], rtol, atol) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(values_agree(x, y, rtol, atol) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return math.isfinite(a) and math.isfinite(b) and abs(a - b) <= atol + rtol * abs(b)
    return type(a) is type(b) and a == b
