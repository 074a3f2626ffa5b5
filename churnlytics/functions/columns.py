"""Column -> Column expressions.

All are built-in Spark expressions, so they stay inside whole-stage codegen;
lenient parsing goes through ``try_*`` functions because ANSI mode is on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def call_center_from_contract_no(contract_no) -> Column:
    """Characters 7-8 of the contract number."""
    return F.substring(_c(contract_no), 7, 2)


def campaign_from_parts(call_center, campaign_no) -> Column:
    """``cc-no``; NULL when either part is NULL (``concat`` propagates NULL)."""
    return F.concat(_c(call_center), F.lit("-"), _c(campaign_no))


def report_date(start) -> Column:
    """Report date = start - 1 day."""
    return F.date_sub(_c(start), 1)


def month_key(d) -> Column:
    """P5: ``YYYYMM`` integer month key of a date."""
    d = _c(d)
    return (F.year(d) * 100 + F.month(d)).cast("int")


def deletion_month(d, legacy_month13: bool = False) -> Column:
    """Month after the deletion date as ``YYYYMM``.

    ``legacy_month13=True`` keeps the raw ``100*y + m + 1`` formula, which
    yields month 13 in December.
    """
    d = _c(d)
    if legacy_month13:
        return (F.year(d) * 100 + F.month(d) + 1).cast("int")
    return month_key(F.add_months(d, 1))


def lenient_double(c) -> Column:
    """Decimal comma accepted, blanks stripped, anything bad -> NULL."""
    s = F.regexp_replace(F.trim(_c(c).cast("string")), ",", ".")
    return s.try_cast("double")


def lenient_date(c) -> Column:
    """Parse a date or timestamp string; bad input -> NULL."""
    s = _c(c).cast("string")
    return F.to_date(F.try_to_timestamp(s))


def deletion_type(c) -> Column:
    """bad/NULL -> 0, ``'3.0'`` -> 3."""
    return F.coalesce(_c(c).cast("string").try_cast("double").try_cast("int"), F.lit(0))


def month_label(c) -> Column:
    """P10: ``YYYY-MM`` from a ``YYYYMM`` value, else ``unknown``."""
    s = _c(c).cast("string")
    return F.when(F.length(s) == 6, F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2))) \
        .otherwise(F.lit("unknown"))


def month_diff(a, b) -> Column:
    """Months from ``YYYYMM`` a to ``YYYYMM`` b; -1 when either is bad."""
    ai = _c(a).cast("string").try_cast("int")
    bi = _c(b).cast("string").try_cast("int")
    diff = (F.floor(bi / 100) - F.floor(ai / 100)) * 12 + (bi % 100 - ai % 100)
    return F.coalesce(diff.cast("int"), F.lit(-1))


def month_span(first, last) -> Column:
    """Spreadsheet DATEDIF(first, last, "M") + 1.

    0 when a date is missing or first > last; one month less when the day of
    ``last`` is before the day of ``first``.
    """
    f, l = _c(first), _c(last)
    months = (F.year(l) - F.year(f)) * 12 + (F.month(l) - F.month(f)) \
        - F.when(F.dayofmonth(l) < F.dayofmonth(f), 1).otherwise(0)
    return F.when(f.isNull() | l.isNull() | (f > l), F.lit(0)).otherwise(months + 1).cast("int")


def day_diff_clipped(end, start, null_value: int = -1, lower: int = 0) -> Column:
    """``datediff(end, start)``, NULL -> ``null_value``, clipped below at ``lower``."""
    return F.greatest(F.coalesce(F.datediff(_c(end), _c(start)), F.lit(null_value)), F.lit(lower))


def days_until(end, start) -> Column:
    """``datediff``, NULL -> -1, not clipped."""
    return F.coalesce(F.datediff(_c(end), _c(start)), F.lit(-1))


def age_years(birthday, as_of) -> Column:
    """Age in years = days / 365.25; NULL -> 0."""
    return F.coalesce(F.datediff(_c(as_of), _c(birthday)) / F.lit(365.25), F.lit(0.0))


def birth_month(birthday) -> Column:
    """Birth month, NULL -> -1."""
    return F.coalesce(F.month(_c(birthday)), F.lit(-1))


def campaign_call_center(campaign) -> Column:
    """First part of ``CC-channel``."""
    return F.split_part(_c(campaign), F.lit("-"), F.lit(1))


def campaign_channel(campaign) -> Column:
    """Second part of ``CC-channel``."""
    return F.split_part(_c(campaign), F.lit("-"), F.lit(2))


def call_center_prefix(campaign) -> Column:
    """First two characters when the campaign has at least two."""
    c = _c(campaign).cast("string")
    return F.when(F.length(c) >= 2, F.substring(c, 1, 2))


def event_flag(deletion_type_col, strict_positive: bool = False) -> Column:
    """P20: 1 when the contract was cancelled (``!= 0``, or ``> 0``)."""
    c = _c(deletion_type_col)
    return (c > 0 if strict_positive else c != 0).cast("int")


def status_class(deletion_type_col) -> Column:
    """Active / withdrawal {1,2,5} / other."""
    c = _c(deletion_type_col)
    return F.when(c == 0, "active").when(c.isin(1, 2, 5), "withdrawal").otherwise("other")


def safe_pct(num, den) -> Column:
    """``100 * num / den``, 0 when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(_c(num), F.nullif(_c(den), F.lit(0))) * 100, F.lit(0.0))


def round_half_even(c, digits: int = 2) -> Column:
    """banker's rounding, as pandas ``round``."""
    return F.bround(_c(c), digits)


def split_key(campaign, amount, split_campaign: str) -> Column:
    """A2: column key; the split campaign gets one key per amount (``FO-SCL_9_9``)."""
    label = F.concat(_c(campaign), F.lit("_"), F.regexp_replace(_c(amount).cast("string"), r"\.", "_"))
    return F.when(_c(campaign) == F.lit(split_campaign), label).otherwise(_c(campaign))
