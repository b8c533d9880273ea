"""Date functions. Accepted text formats differ by function, as documented there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.expr import values as V
from ledgerloom.expr.values import DATE, LONG, STRING, TIMESTAMP, Val, carry, number
from ledgerloom.functions.registry import register

#: Strftime directives and the patterns of date_format().
_DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%y": "yy", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%I": "hh"}


def as_date(v: Val, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd")) -> Column:
    """v as a date; null if it can't be read."""
    if V.is_date(v.dtype):
        return v.col.cast("date")
    if not V.is_str(v.dtype):
        return F.lit(None).cast("date")
    s = F.trim(v.col)
    shapes = {"yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}", "dd/MM/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy/MM/dd": r"^\d{4}/\d{1,2}/\d{1,2}$", "dd-MM-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$"}
    loose = {"yyyy-MM-dd": "yyyy-M-d", "dd/MM/yyyy": "d/M/yyyy", "yyyy/MM/dd": "yyyy/M/d", "dd-MM-yyyy": "d-M-yyyy"}
    tries = [F.when(s.rlike(shapes[f]), F.try_to_timestamp(F.regexp_extract(s, shapes[f], 0), F.lit(loose[f])).cast("date")) for f in formats]
    return F.coalesce(*tries)


@register("now", most=0, family="date")
def now() -> Val:
    return Val(F.current_timestamp(), TIMESTAMP)


@register("today", most=0, family="date")
def today() -> Val:
    return Val(F.current_date(), DATE)


def _part(name: str, of) -> None:
    @register(name, least=1, most=1, family="date")
    def _(d: Val) -> Val:
        return carry([d], of(d.col).cast("long") if V.is_date(d.dtype) else F.lit(None).cast("long"), LONG)


_part("year", F.year)
_part("month", F.month)
_part("day", F.dayofmonth)


@register("quarter", least=1, most=1, family="date")
def quarter(d: Val) -> Val:
    return carry([d], F.quarter(as_date(d)).cast("long"), LONG)


@register("date_diff", least=2, most=3, family="date")
def date_diff(a: Val, b: Val, unit: Val | None = None) -> Val:
    """a - b in complete units; hours and seconds count whole days."""
    x, y = as_date(a), as_date(b)
    kind = str(unit.const).lower() if unit is not None and unit.is_const else "days"
    days = F.datediff(x, y).cast("long")
    late = F.when(F.dayofmonth(x) < F.dayofmonth(y), 1).otherwise(0)
    months = (F.year(x) - F.year(y)) * 12 + (F.month(x) - F.month(y)) - late
    before = (F.month(x) < F.month(y)) | ((F.month(x) == F.month(y)) & (F.dayofmonth(x) < F.dayofmonth(y)))
    years = F.year(x) - F.year(y) - F.when(before, 1).otherwise(0)
    out = {"months": months.cast("long"), "years": years.cast("long"), "hours": days * 24, "seconds": days * 86400}.get(kind, days)
    return carry([a, b], out, LONG)


@register("date_add", least=1, most=4, family="date", keywords=("days", "months", "years"))
def date_add(d: Val, days: Val | None = None, months: Val | None = None, years: Val | None = None) -> Val:
    n = [number(v) if v is not None else V.lit(0) for v in (days, months, years)]
    moved = F.date_add(as_date(d), n[0].col.cast("int"))
    moved = F.add_months(F.add_months(moved, n[1].col.cast("int")), (n[2].col * 12).cast("int"))
    return carry([d, *n], moved, DATE)


@register("date_format", least=1, most=2, family="date")
def date_format(d: Val, fmt: Val | None = None) -> Val:
    """strftime; what can't be read is shown as it is."""
    pattern = str(fmt.const) if fmt is not None and fmt.is_const else "%d/%m/%Y"
    java, k = "", 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in _DIRECTIVES:
            java, k = java + _DIRECTIVES[two], k + 2
        else:
            c = pattern[k]
            java, k = java + (f"'{c}'" if c.isalpha() else "''" if c == "'" else c), k + 1
    at = d.col.cast("timestamp") if V.is_date(d.dtype) else as_date(d).cast("timestamp")
    return carry([d], F.coalesce(F.date_format(at, java), V.text(d)), STRING)


def _weekdays_upto(d: Column) -> Column:
    """Monday-to-Friday days from a fixed Monday up to and including d."""
    n = F.datediff(d, F.lit("1900-01-01").cast("date")) + 1
    weeks = F.floor(n / 7)
    return weeks * 5 + F.least(n - weeks * 7, F.lit(5))


@register("workdays", least=2, most=2, family="date")
def workdays(a: Val, b: Val) -> Val:
    """Mondays to Fridays after the earlier day up to the later; negative if b is the earlier."""
    x, y = as_date(a), as_date(b)
    return carry([a, b], F.coalesce((_weekdays_upto(y) - _weekdays_upto(x)).cast("long"), F.lit(0).cast("long")), LONG)
