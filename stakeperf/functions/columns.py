"""Scalar Column helpers that carry the reference's missing-value rules.

R turns failed numeric casts into NA, treats NaN as missing in ``replace_na``
and ``na.rm``, and yields Inf / NaN on division by zero.  On Spark we keep
NULL as the only missing value: casts use ``try_cast``, division uses
``try_divide`` (x / 0 -> NULL) and NaN read from files is turned into NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """A column by its exact name, even if the name contains dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with NULL for a zero or NULL denominator (R: Inf / NaN)."""
    return F.try_divide(_c(num), _c(den))


def as_number(c: Column | str) -> Column:
    """R ``as.numeric``: text or number to double, failures and NaN to NULL."""
    x = _c(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def blank_to_null(c: Column | str) -> Column:
    """Blank text is missing (``read.csv`` keeps it as ``""``; we do not)."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def date_of_text(c: Column | str) -> Column:
    """The calendar date of ISO text: first 10 characters, NULL if invalid."""
    return F.try_to_date(F.substring(_c(c), 1, 10))


def strip_suffix(c: Column | str, suffix: str = "-USD") -> Column:
    """R ``str_remove``: remove the first occurrence of a literal pattern."""
    return F.regexp_replace(_c(c), "^(.*?)" + _regex_escape(suffix), "$1")


def _regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()-" else ch for ch in s)


def plain_digits(c: Column | str) -> Column:
    """A number's text with every significant digit and no exponent, at any
    magnitude: Spark's own digits, with the point moved by the exponent.

    Most cells need no pattern.  The point is moved inside ``transform``, which keeps the
    code that Spark generates for several columns side by side small enough for the JVM to compile."""
    s = _c(c).cast("string")
    whole = F.substring_index(s, ".", 1)
    plain = F.when(F.rtrim(s, F.lit("0")).endswith("."), F.when(whole == "-0", F.lit("0")).otherwise(whole)).otherwise(s)
    return F.when(s.contains("E"), F.transform(F.array(s), _moved_point)[0]).otherwise(plain)


def _moved_point(s: Column) -> Column:
    """The plain text of a number's text with an exponent."""
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.translate(F.substring_index(s, "E", 1), "-.", "")
    e = F.substring_index(s, "E", -1).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), F.rtrim(digits, F.lit("0")))
    padded = F.rpad(digits, F.greatest(e + 1, F.lit(20)), F.lit("0"))
    parted = F.concat(F.left(padded, e + 1), F.lit("."), F.substr(padded, e + 2))
    parted = F.rtrim(F.rtrim(parted, F.lit("0")), F.lit("."))
    large = F.when(F.length(digits) <= e + 1, F.rpad(digits, e + 1, F.lit("0"))).otherwise(parted)
    return F.concat(sign, F.when(e < 0, small).otherwise(large))


def r_text(c: Column | str, dtype) -> Column:
    """R ``toString`` of a one-element cell: numbers with all their digits in
    plain (non-scientific) notation, text as is, NULL as ``""``."""
    txt = plain_digits(c) if isinstance(dtype, NumericType) else _c(c).cast("string")
    return F.coalesce(txt, F.lit(""))


def edge_round(c: Column | str, digits: int = 9) -> Column:
    """Round a double for output to ``digits`` significant digits.

    Nine decimals and then twelve significant digits first remove the last-bit
    noise that depends on summation order, so that a value on a rounding
    boundary rounds the same way in every engine.  The power of ten multiplies
    or divides, so it is exact; ``+ 0.0`` turns ``-0.0`` into ``0.0``."""
    x = F.round(_c(c), 9)
    x = F.when(x.isNotNull(), F.format_string("%.11e", x).cast("double"))
    k = F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x)))
    up, down = F.pow(F.lit(10.0), F.greatest(k, F.lit(0.0))), F.pow(F.lit(10.0), F.greatest(-k, F.lit(0.0)))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * up / down, 0) / up * down + F.lit(0.0))


def coalesce_numeric(df: DataFrame, value: float = 0.0, exclude: Iterable[str] = ()) -> DataFrame:
    """R ``mutate(across(where(is.numeric), ~ coalesce(.x, 0)))``."""
    skip = set(exclude)
    out = []
    for f in df.schema.fields:
        if f.name not in skip and isinstance(f.dataType, NumericType):
            lit = F.lit(value).cast(f.dataType)
            out.append(F.coalesce(quoted(f.name), lit).alias(f.name))
        else:
            out.append(quoted(f.name))
    return df.select(out)


def col_or(df: DataFrame, name: str, default) -> Column:
    """The column if the frame has it, else a literal (R ``if (x %in% names(.))``)."""
    return F.col(name) if name in df.columns else F.lit(default)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """tidyselect ``contains(pattern)``: case-insensitive substring match."""
    p = pattern.lower()
    return [c for c in df.columns if p in c.lower()]
