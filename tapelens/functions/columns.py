"""Column expressions: text to number, text to bool, text to date, rounding."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings of a flag.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
# Magnitude suffixes of provider numbers.
MAGNITUDES = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
TICKER_PATTERN = r"^[A-Z0-9][A-Z0-9.\-]*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    """Trimmed text, blank as null."""
    t = F.trim(_col(c).cast("string"))
    return F.when(t != "", t)


def nullable_bool(c) -> Column:
    t = F.lower(text(c))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def nullable_double(c) -> Column:
    v = _col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def nullable_int(c) -> Column:
    """Integer part of a number, null when it is not one."""
    return nullable_double(c).cast("int")


def magnitude_number(c) -> Column:
    """``$1,000``, ``1.2B`` or ``45 units`` as a double."""
    t = text(c)
    suffix = F.upper(F.right(t, F.lit(1)))
    factor = F.lit(1.0)
    for letter, value in MAGNITUDES.items():
        factor = F.when(suffix == letter, F.lit(value)).otherwise(factor)
    stem = F.when(suffix.isin(*MAGNITUDES), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    plain = F.regexp_replace(stem, "[,$]", "").try_cast("double")
    digits = F.regexp_replace(stem, r"[^0-9.\-]", "").try_cast("double")
    return F.coalesce(plain, digits) * factor


def plain_number(c) -> Column:
    """``$2,500`` or ``12%`` as the number written, null when it is not one."""
    t = F.translate(text(c), ",$", "")
    return F.when(t.contains("%"), F.regexp_replace(t, "%$", "")).otherwise(t).try_cast("double")


def weight_number(c) -> Column:
    """A portfolio weight: ``25%`` and ``25`` are both 0.25."""
    return as_share(plain_number(c), text(c).endswith("%"))


def as_share(n: Column, percent: Column) -> Column:
    """A weight's number as a share: in percent if it is marked so or above 1."""
    return F.when(percent | (n > 1.0), n / 100.0).otherwise(n)


def mixed_date(c) -> Column:
    """ISO, ``M/d/yyyy``, ``M/d/yy`` or any timestamp text as a date."""
    t = text(c)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    us = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "M/d/yyyy"))
    short = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(t, "M/d/yy"))
    return F.coalesce(iso, us, short, F.try_to_timestamp(t).cast("date"))


def ticker_symbol(c) -> Column:
    """Upper-case symbol, null when blank or malformed."""
    t = F.upper(text(c))
    return F.when(t.rlike(TICKER_PATTERN), t)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def rate(a: Column, b: Column) -> Column:
    """Share with 0 for an empty denominator."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def signed(c, digits: int = 2) -> Column:
    """``%+.2f`` text."""
    return F.format_string(f"%+.{digits}f", _col(c))


def half_up(c: Column, digits: int) -> Column:
    """Round half away from zero in double arithmetic; huge values have no such digits."""
    scale = float(10**digits)
    near = F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale
    return F.when(F.abs(c) * scale < 9e18, near).otherwise(c) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column at the output edge; ``special`` names other digits."""
    out = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            col = half_up(col, special.get(field.name, digits))
        out.append(col.alias(field.name))
    return df.select(*out)


def shown(df: DataFrame) -> DataFrame:
    """Doubles as text: six decimals below 1000, eight significant digits above.

    For report tables whose compounded values span many orders of magnitude.
    """
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            small = F.format_string("%.6f", half_up(c, 6))
            c = F.when(F.abs(c) < 1000, small).when(c.isNotNull(), F.format_string("%.7e", c))
        out.append(c.alias(field.name))
    return df.select(*out)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Linear quantile of an ascending array without nulls; null when empty."""
    at = F.lit(p) * (F.size(ordered) - 1)
    low = F.floor(at).cast("int")
    left = F.get(ordered, low)
    return left + (at - low) * (F.coalesce(F.get(ordered, low + 1), left) - left)
