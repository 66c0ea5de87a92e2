"""Column functions: period keys, rounding modes, text cleaning, guards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCALE8 = "decimal(38,8)"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- guards -----------------------------------------------------------------

def safe_div(a, b) -> Column:
    """a / b, NULL when the divisor is NULL or zero (ANSI mode would raise)."""
    a, b = as_col(a), as_col(b)
    return F.when(b != 0, a / b)


def change(current, base) -> Column:
    """current / base - 1 with the zero/NULL guard."""
    return safe_div(current, base) - 1


def clip(c, lo, hi) -> Column:
    """Clamp that keeps NULL as NULL (greatest/least alone would skip it)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


# ---- periods ----------------------------------------------------------------

def week_start(d) -> Column:
    return F.date_trunc("week", as_col(d)).cast("date")


def month_start(d) -> Column:
    return F.trunc(as_col(d), "month")


def period_start(d, unit: str) -> Column:
    if unit == "week":
        return week_start(d)
    if unit == "month":
        return month_start(d)
    raise ValueError(f"unit must be week or month, not {unit!r}")


def iso_week_key(d) -> Column:
    """``YYYY-Www``; the ISO year, so 2021-01-01 is 2020-W53."""
    d = as_col(d)
    iso_year = F.year(F.date_add(week_start(d), 3))
    return F.concat(iso_year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def month_key(d) -> Column:
    return F.date_format(as_col(d), "yyyy-MM")


def month_end(d) -> Column:
    return F.last_day(as_col(d))


def years_before(d, years: int) -> Column:
    """Same day some years back; 29 Feb falls to 28 Feb."""
    return F.add_months(as_col(d), -12 * years)


def add_weekdays(d, n: int) -> Column:
    """n weekdays later, skipping Saturdays and Sundays (closed form, no loop)."""
    d = as_col(d)
    dow = (F.dayofweek(d) + 5) % 7  # Monday 0 .. Sunday 6
    from_weekend = F.when(dow >= 5, F.date_sub(d, dow - 4)).otherwise(d)  # weekend counts from Friday
    base_dow = F.when(dow >= 5, F.lit(4)).otherwise(dow)
    extra = 2 * F.floor((base_dow + n) / 5)
    return F.date_add(from_weekend, (F.lit(n) + extra).cast("int"))


def local_close_utc(d, hhmm: str, zone: str) -> Column:
    """UTC timestamp of an exchange-local closing time on a trade date."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(as_col(d).cast("string"), F.lit(f" {hhmm}:00"))), zone)


# ---- rounding ---------------------------------------------------------------

def half_even(c, scale: int = 8) -> Column:
    return F.bround(as_col(c), scale)


def half_up(c, scale: int = 8) -> Column:
    return F.round(as_col(c), scale)


def truncate(c, scale: int = 8) -> Column:
    """Toward zero."""
    c = as_col(c)
    factor = F.lit(10**scale)
    return F.signum(c) * F.floor(F.abs(c) * factor) / factor


def snap(c, step: int = 5, mode: str = "half_even") -> Column:
    """Nearest multiple of step."""
    rounder = {"half_even": F.bround, "half_up": F.round}[mode]
    return rounder(as_col(c) / step, 0) * step


def cut(c, digits: int) -> Column:
    """Nearest value on a decimal grid, for comparing results of different engines.

    The boundary lies off the decimal half, where prices like cents / quantity
    often fall exactly, so a last-bit difference cannot move a value across it.
    """
    c = as_col(c)
    scaled = c * F.lit(10.0**digits)
    return F.when(F.isnan(c) | (F.abs(scaled) > 9e18), c).otherwise(F.floor(scaled + 0.4987) / F.lit(10.0**digits))


def normal_cdf(z) -> Column:
    """Phi(z) by the Abramowitz-Stegun 7.1.26 erf polynomial (|error| < 1.5e-7)."""
    z = as_col(z)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)


# ---- text -------------------------------------------------------------------

def clean_decimal(c) -> Column:
    """Number in display text: separators, percent sign, (x) as negative, dashes as NULL."""
    text = F.trim(as_col(c))
    negative = text.rlike(r"^\(.*\)$")
    digits = F.regexp_replace(text, r"[,%()\s]", "")
    number = F.when(F.lower(digits).isin("", "-", "--", "nan", "none", "null"), None).otherwise(
        digits.try_cast(SCALE8)
    )
    return F.when(negative, -number).otherwise(number)


def clean_date(c) -> Column:
    """Date in ISO, compact, slashed or CJK year-month-day form."""
    text = F.trim(as_col(c))
    parts = [F.regexp_extract(text, r"^(\d{4})\D?(\d{1,2})\D?(\d{1,2})", i) for i in (1, 2, 3)]
    compact = F.regexp_extract(text, r"^(\d{4})(\d{2})(\d{2})$", 0)
    iso = F.when(
        compact != "",
        F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
    ).when(
        parts[0] != "",
        F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")),
    )
    return iso.try_cast("date")


def header_key(text: str) -> str:
    """Header spelling with BOM, blanks and underscores removed, lower case."""
    return text.replace("﻿", "").replace(" ", "").replace("_", "").strip().lower()


def canonical_number(c) -> Column:
    """Decimal text without trailing zeros: 1.500 -> 1.5, 2.000 -> 2."""
    text = as_col(c).cast(SCALE8).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def exchange_of(code) -> Column:
    """Exchange from the leading digit of a six-digit code, NULL when unknown."""
    first = F.substring(as_col(code), 1, 1)
    return F.when(first.isin("5", "6"), "SH").when(first.isin("0", "1", "3"), "SZ")


def is_fund_code(code) -> Column:
    code = as_col(code)
    return code.rlike("^[0-9]{6}$") & F.substring(code, 1, 1).isin("1", "5")


def indicator_value(payload, name: str) -> Column:
    """One number out of a JSON indicator record; NULL when the key is absent."""
    return F.try_element_at(F.from_json(as_col(payload), "map<string,double>"), F.lit(name))
