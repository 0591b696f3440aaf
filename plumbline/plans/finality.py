"""Watermarks: up to when figures are final."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

_EXPR = re.compile(r"\s*business_day\s*(?:([+-])\s*(\d+)\s*days?)?\s*")


def weekday(at: datetime) -> datetime:
    """at, or the Friday before if it is on a weekend."""
    return at - timedelta(days=max(0, at.weekday() - 4))


def watermark(expr: str, tz: str, as_of: datetime | str | None = None) -> datetime:
    """The end of the business day that the expression names."""
    if not (found := _EXPR.fullmatch(expr)):
        raise ValueError(f"{expr!r} is no watermark: business_day, or business_day +/- N days")
    try:
        zone = ZoneInfo(tz)
    except Exception:
        raise ValueError(f"{tz!r} is no time zone") from None
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    now = datetime.now(zone) if as_of is None else as_of.replace(tzinfo=zone) if as_of.tzinfo is None else as_of.astimezone(zone)
    days = int(f"{found[1] or ''}{found[2] or 0}")
    return weekday(weekday(now) + timedelta(days=days)).replace(hour=23, minute=59, second=59, microsecond=0)
