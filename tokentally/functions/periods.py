"""Date ranges: argument handling on the driver, and the day directories they cover."""

from calendar import monthrange
from dataclasses import dataclass
from datetime import date, datetime, timedelta


@dataclass(frozen=True)
class Period:
    """Days from `start` to `end`, both included."""

    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def resolve_period(
    now: datetime, days: int = 7, start: date | None = None, end: date | None = None
) -> Period:
    """Explicit dates count only as a pair; otherwise `now - days` to `now`, so `days + 1` days."""
    if start is not None and end is not None:
        return Period(start, end)
    today = now.date()
    return Period(today - timedelta(days=days), today)


def day_directories(period: Period) -> list[str]:
    """`yyyy/MM/dd` patterns covering the period: whole months and years become one pattern each."""
    patterns = []
    day = period.start
    while day <= period.end:
        year_end = date(day.year, 12, 31)
        month_end = date(day.year, day.month, monthrange(day.year, day.month)[1])
        if day.day == 1 and day.month == 1 and year_end <= period.end:
            patterns.append(f"{day:%Y}/*/*")
            day = year_end
        elif day.day == 1 and month_end <= period.end:
            patterns.append(f"{day:%Y/%m}/*")
            day = month_end
        else:
            patterns.append(f"{day:%Y/%m/%d}")
        day += timedelta(days=1)
    return patterns


def day_glob(period: Period) -> str:
    """One path pattern for all days. Days without a directory are simply not matched."""
    return "{" + ",".join(day_directories(period)) + "}"
