"""Column expressions for listing text: prices, measures, counts, formats.

All of these are built-in Catalyst expressions (no Python UDF), so they run
inside whole-stage codegen in the same projection as the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from abode.schema import (
    INTEGER_TEXT, LOOSE_NUMBER, NEGOTIABLE, NUMERIC_TEXT, UNIT_BILLION,
    UNIT_M2, UNIT_MILLION_PER_M2, UNIT_PER_MONTH,
)


#: Numbers in listing text: 18 places before the point and 10 after it.
TEXT_NUMBER = "decimal(28,10)"
#: VND per square metre: a text number with the point moved by six.
PER_M2 = "decimal(28,4)"
MONEY = "decimal(20,2)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace(c: Column, search: str, repl: str = "") -> Column:
    return F.replace(c, F.lit(search), F.lit(repl))


def to_number(text: Column, pattern: str = LOOSE_NUMBER, dtype: str = "double") -> Column:
    """Guarded cast: null unless ``text`` matches ``pattern``; never raises."""
    return F.when(text.rlike(pattern), text.try_cast(dtype))


def is_monthly_rent(price: Column | str) -> Column:
    """True for rent prices ('... /tháng'); null text is not rent."""
    return F.coalesce(_c(price).contains(UNIT_PER_MONTH), F.lit(False))


def measure_text(c: Column | str, unit: str) -> Column:
    """Drop a unit, turn the decimal comma into a dot, trim."""
    return F.trim(_replace(_replace(_c(c), unit), ",", "."))


def area_value(area: Column | str) -> Column:
    """'52,5 m²' -> 52.5; anything else (e.g. 'KXĐ') -> null."""
    return to_number(measure_text(area, UNIT_M2), dtype="double")


def area_decimal(area: Column | str) -> Column:
    return to_number(measure_text(area, UNIT_M2), dtype=TEXT_NUMBER)


def _money(v: Column) -> Column:
    """VND to two places; null beyond the money type's range, never an error."""
    return F.round(v, 2).try_cast(MONEY)


def price_vnd(price: Column | str, area_dec: Column) -> Column:
    """Listing price text -> VND (null when not a number, or out of range).

    * 'X tỷ' (quotes allowed, decimal comma): X * 1e9, exact.
    * 'X triệu/m²' and bare digits: X * 1e6 * area (null area -> null), exact
      to six places before the result is rounded to two.
    * negotiable / other text: null (the text itself stays in ``price_raw``).

    The factor moves the point of X before the product with the area, so no
    digit of X is lost; products beyond the type give null instead of an error.
    """
    p = _c(price)
    ty_val = F.try_multiply(to_number(billions_text(p), dtype=TEXT_NUMBER), F.lit(1000000000).cast("decimal(10,0)"))
    per_m2 = F.try_multiply(to_number(per_m2_text(p), dtype=TEXT_NUMBER), F.lit(1000000).cast("decimal(7,0)"))
    ppm_val = F.try_multiply(per_m2.try_cast(PER_M2), area_dec)
    return F.when(p.contains(UNIT_BILLION), _money(ty_val)).otherwise(_money(ppm_val))


def billions_text(p: Column) -> Column:
    """The number in 'X tỷ': quotes and unit dropped, decimal comma as a dot."""
    return F.trim(_replace(_replace(_replace(p, '"'), UNIT_BILLION), ",", "."))


def per_m2_text(p: Column) -> Column:
    """The number in 'X triệu/m²' or in bare digits."""
    return F.trim(_replace(_replace(p, ",", "."), UNIT_MILLION_PER_M2))


def plain_number(price: Column | str) -> Column:
    """Value of a price that is digits with at most one dot or comma, else null."""
    return to_number(F.trim(_replace(_c(price), ",", ".")), dtype=TEXT_NUMBER)


def price_unparsable(price: Column | str) -> Column:
    """Price text that is neither a number form nor negotiable (DQ reason)."""
    p = _c(price)
    ok = F.when(p.contains(UNIT_BILLION), billions_text(p).rlike(LOOSE_NUMBER)).otherwise(
        per_m2_text(p).rlike(LOOSE_NUMBER) | F.trim(p).isin(*NEGOTIABLE))
    return p.isNotNull() & ~ok


def price_out_of_range(price: Column | str, area: Column | str) -> Column:
    """A price in number form whose value does not fit the money type (DQ reason)."""
    p, area_dec = _c(price), area_decimal(area)
    number = F.when(p.contains(UNIT_BILLION), billions_text(p).rlike(LOOSE_NUMBER)).otherwise(
        per_m2_text(p).rlike(LOOSE_NUMBER) & measure_text(area, UNIT_M2).rlike(LOOSE_NUMBER))
    return F.coalesce(number, F.lit(False)) & price_vnd(p, area_dec).isNull()


def count_value(c: Column | str, unit: str) -> Column:
    """'3 phòng' -> 3, '0 phòng' -> 1 (zero means one), non-integer -> null."""
    t = F.trim(_replace(_c(c), unit))
    v = F.when(t.rlike(INTEGER_TEXT), t.try_cast("int"))
    return F.when(v == 0, F.lit(1)).otherwise(v)


def width_value(c: Column | str, zero_is_null: bool = False) -> Column:
    """'4,5 m' -> 4.5 (every 'm' removed); entrance width '0' -> null."""
    t = F.trim(_replace(_replace(_c(c), "m"), ",", "."))
    v = to_number(t, dtype="double")
    if zero_is_null:
        return F.when(t == "0", F.lit(None).cast("double")).otherwise(v)
    return v


def numeric_guard(text: Column | str) -> Column:
    """Rows whose price text is a plain number, as number (else null)."""
    t = _c(text)
    return F.when(t.rlike(NUMERIC_TEXT), t.try_cast("decimal(20,2)"))


def price_text(price_vnd_col: Column | str, price_raw: Column | str) -> Column:
    """Stored price text: the number as plain digits when parsed, else the text."""
    v = _c(price_vnd_col)
    return F.when(v.isNotNull(), v.cast("string")).otherwise(_c(price_raw))


def round_billions(v: Column) -> Column:
    """VND -> billions rounded half-up to 2 places, done in DECIMAL (not printf)."""
    return F.round(v.cast("decimal(24,4)") / F.lit(1000000000), 2).cast("decimal(20,2)")


def fmt_price_ty(price_vnd_col: Column | str, price_raw: Column | str) -> Column:
    """'x.xx tỷ' for numbers; negotiable and unparsable text passes through."""
    v = _c(price_vnd_col)
    return F.when(v.isNotNull(), F.concat(round_billions(v).cast("string"), F.lit(" tỷ"))) \
        .otherwise(_c(price_raw))


def fmt_price_plain(price_vnd_col: Column | str, price_raw: Column | str) -> Column:
    """'x.xx' (billions) for numbers; other text passes through with 'tỷ' removed."""
    v = _c(price_vnd_col)
    raw = F.trim(_replace(_replace(_c(price_raw), UNIT_BILLION), ",", "."))
    return F.when(v.isNotNull(), round_billions(v).cast("string")).otherwise(raw)


def fmt_price_long(v: Column) -> Column:
    """'1,234.57 tỷ VND' (thousands separators, 2 places)."""
    return F.concat(F.format_number(round_billions(v), 2), F.lit(" tỷ VND"))


def fmt_thousands(v: Column) -> Column:
    """'{:,}' of an integer."""
    return F.format_number(v.cast("bigint"), 0)


def compare_raw_price(price_vnd_col: Column | str) -> Column:
    """Price in billions as a number, 0 when it is not a number."""
    return F.coalesce((_c(price_vnd_col).cast("double") / F.lit(1e9)), F.lit(0.0))


def price_input_normalise(price: Column | str, vi_grouping: bool = False) -> Column:
    """Form price: drop ',' unless negotiable; optionally also dot groups."""
    p = _c(price)
    cleaned = _replace(p, ",")
    if vi_grouping:
        cleaned = F.when(cleaned.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), _replace(cleaned, ".")) \
            .otherwise(cleaned)
    return F.when(p.isin(*NEGOTIABLE), p).otherwise(cleaned)
