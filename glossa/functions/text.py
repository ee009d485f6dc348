"""Scalar text functions as Catalyst expressions (no Python per row).

Python-semantics notes: the judge parser takes the text after the last marker,
strips it, takes its first whitespace-separated token (whitespace as Python's
``str.isspace`` defines it, which is wider than Java's ``\\s``) and accepts it
only if it is an ASCII integer (``^[+-]?[0-9]+$``). Python's ``int`` would also
accept ``1_0`` and non-ASCII digits; those tokens parse to null here.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.fixed_text import JUDGE_MARKER, JUDGE_SCORE_RANGE

# --- fixed values: strings pandas.read_csv reads as missing by default -------------------
PANDAS_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def after_last(text: Column | str, marker: str) -> Column:
    """Text after the last occurrence of ``marker``; the whole text when absent
    (``str.split(marker)[-1]``), without building the split array."""
    return F.substring_index(_c(text), marker, -1)


@lru_cache(maxsize=1)
def python_whitespace_class() -> str:
    """The characters ``str.isspace`` accepts, as a regex class body.

    Built from Python's own definition (not a typed list) and written with
    ``\\x{...}`` escapes, which Java regex and RE2 (DuckDB) both read, so the
    token rule splits exactly where ``str.split()`` does.
    """
    cps = [c for c in range(0x110000) if chr(c).isspace()]
    parts, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        parts.append(f"\\x{{{cps[i]:X}}}" + (f"-\\x{{{cps[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(parts)


def first_token(text: Column | str) -> Column:
    """First whitespace-separated token after stripping (Python's whitespace set); '' when none."""
    ws = python_whitespace_class()
    return F.regexp_extract(_c(text), f"^[{ws}]*([^{ws}]+)", 1)


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; null stays null (``least``/``greatest`` alone skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def safe_int(token: Column) -> Column:
    """ASCII integer text to a double (so very long numbers still clamp), else null."""
    return F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast("double"))


def judge_score(response: Column | str, marker: str = JUDGE_MARKER,
                lo: int = JUDGE_SCORE_RANGE[0], hi: int = JUDGE_SCORE_RANGE[1]) -> Column:
    """Integer score after the last marker, clamped to [lo, hi]; null when it does not parse."""
    tok = first_token(after_last(response, marker))
    return clamp(safe_int(tok), float(lo), float(hi)).cast("int")


def na_normalize(c: Column | str, na_values: list[str] = PANDAS_NA_VALUES) -> Column:
    """pandas-style missing values: whole-cell NA spellings become null."""
    col = _c(c)
    return F.when(col.isin(na_values), F.lit(None).cast("string")).otherwise(col)


def as_python_text(c: Column | str, null_text: str = "nan") -> Column:
    """How ``str.format`` renders a pandas cell: a missing value prints as ``nan``."""
    return F.coalesce(_c(c).cast("string"), F.lit(null_text))


def stringify(c: Column | str, null_text: str = "None", dtype: str | None = None) -> Column:
    """``str(v)`` of a row value: null becomes ``None``; with ``dtype='boolean'``
    the values read ``True`` / ``False`` as in Python."""
    col = _c(c)
    if dtype == "boolean":
        return F.when(col, F.lit("True")).when(~col, F.lit("False")).otherwise(F.lit(null_text))
    if dtype in ("double", "float"):
        return F.coalesce(python_float(col), F.lit(null_text))
    return F.coalesce(col.cast("string"), F.lit(null_text))


def python_float(col: Column) -> Column:
    """``str(v)`` of a float: the digits the JVM prints, placed as Python does: plain
    from 1e-4 to below 1e16, else with a two-digit exponent. (Before Java 19 the JVM
    prints one digit more than needed for a few large values.)"""
    text = col.cast("double").cast("string")
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(text, "^-", "")
    exponent = F.coalesce(F.regexp_extract(body, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole = F.regexp_extract(body, r"^(\d+)", 1)
    digits = F.regexp_replace(F.concat(whole, F.regexp_replace(F.regexp_extract(body, r"\.(\d+)", 1), "0+$", "")),
                              "^0+", "")
    # the value is 0.digits * 10^point
    lead = F.length(F.regexp_extract(F.regexp_extract(body, r"^0\.(\d+)", 1), "^0*", 0))
    point = F.when(whole == "0", -lead).otherwise(F.length(whole)) + exponent
    trimmed = F.regexp_replace(digits, "0+$", "")
    n = F.length(trimmed)
    plain = (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), trimmed))
              .when(point >= n, F.concat(trimmed, F.repeat(F.lit("0"), point - n), F.lit(".0")))
              .otherwise(F.concat(F.substring(trimmed, F.lit(1), point), F.lit("."), F.substring(trimmed, point + 1, n))))
    e = point - 1
    power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), F.lit("0")))
    mantissa = F.when(n > 1, F.concat(F.substring(trimmed, F.lit(1), F.lit(1)), F.lit("."), F.substring(trimmed, F.lit(2), n))
                      ).otherwise(trimmed)
    placed = F.when((e >= -4) & (e < 16), plain).otherwise(F.concat(mantissa, power))
    return (F.when(F.isnan(col), F.lit("nan")).when(F.abs(col) == float("inf"), F.concat(sign, F.lit("inf")))
             .when(col == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, placed)))


def slug(c: Column | str) -> Column:
    """Model id to a file-name part: '/' becomes '_'."""
    return F.regexp_replace(_c(c), "/", "_")


def basename(c: Column | str) -> Column:
    """Last path segment; a trailing slash is dropped first."""
    return F.element_at(F.split(F.regexp_replace(_c(c), "/+$", ""), "/"), -1)


def stem(c: Column | str) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(basename(c), r"(.)\.[^./]*$", "$1")


def has_suffix(c: Column | str, suffix: str) -> Column:
    return F.endswith(_c(c), F.lit(suffix))


def strip_newlines(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit("\n"), F.lit(""))
