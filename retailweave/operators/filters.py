"""Report filters: a sanitised value object and the conjunctive predicate built from it."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import labels as L

SEARCH_COLUMNS = (
    "invoice_number",
    "product_code",
    "product_name",
    "brand_name",
    "channel_name",
    "supplier_reference",
)
OCCASION_MODES = ("occasion", "hors_occasion")


def _parse_day(value: object) -> dt.date | None:
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.strptime(str(value), "%Y-%m-%d").date()
    except ValueError:
        return None


@dataclass(frozen=True)
class Filters:
    start: dt.date
    end: dt.date
    channel: str | None = None
    brand_id: int | None = None
    category: str | None = None
    occasion: str | None = None
    q: str | None = None

    @classmethod
    def from_raw(cls, raw: dict[str, object], as_of: dt.date) -> Filters:
        """Defaults to month-to-date, drops unusable values and swaps reversed bounds."""
        start = _parse_day(raw.get("start")) or as_of.replace(day=1)
        end = _parse_day(raw.get("end")) or as_of
        if start > end:
            start, end = end, start
        brand = str(raw.get("brand_id") if raw.get("brand_id") is not None else "").strip()
        occasion = str(raw.get("occasion") or "")
        return cls(
            start=start,
            end=end,
            channel=str(raw.get("channel") or "") or None,
            brand_id=int(brand) if re.fullmatch("-?[0-9]{1,18}", brand) else None,
            category=str(raw.get("category") or "") or None,
            occasion=occasion if occasion in OCCASION_MODES else None,
            q=str(raw.get("q") or "").strip() or None,
        )

    @property
    def period(self) -> cal.Period:
        return self.start, self.end

    def comparison_periods(self) -> dict[str, cal.Period]:
        return cal.comparison_periods(self.start, self.end)

    def rolling_periods(self) -> dict[str, cal.Period]:
        return cal.rolling_periods(self.end)

    def with_channel(self, channel: str) -> Filters:
        return replace(self, channel=channel)


def like_pattern(needle: str) -> str:
    """LIKE pattern for containment: % and _ keep their meaning, a backslash counts as one unless it escapes them."""
    return "%" + re.sub(r"\\([%_\\])|\\", lambda m: m[0] if m[1] else r"\\", needle.lower()) + "%"


def search_predicate(needle: str, columns: tuple[str, ...] = SEARCH_COLUMNS) -> Column:
    """Case-insensitive containment in any column; % and _ in the needle keep their LIKE meaning."""
    pattern = like_pattern(needle)
    out = F.lit(False)
    for name in columns:
        out = out | F.lower(F.coalesce(F.col(name), F.lit(""))).like(pattern)
    return out


def static_predicate(filters: Filters) -> Column:
    """Everything but the period: the standing exclusion and the optional filters."""
    out = L.not_excluded()
    if filters.channel:
        out = out & (L.channel() == filters.channel)
    if filters.brand_id is not None:
        out = out & (L.brand_key() == filters.brand_id)
    if filters.category:
        out = out & (L.category_path() == filters.category)
    if filters.occasion == "occasion":
        out = out & L.is_occasion()
    elif filters.occasion == "hors_occasion":
        out = out & ~L.is_occasion()
    if filters.q:
        out = out & search_predicate(filters.q)
    return out


def apply_filters(fact: DataFrame, filters: Filters, periods: dict[str, cal.Period] | None = None) -> DataFrame:
    """Rows of any of `periods` (default: the filter's own) that pass every filter."""
    wanted = periods if periods is not None else {"current": filters.period}
    if "invoice_month" in fact.columns:  # partition column of the stored fact: prune folders as well
        low, high = cal.span(wanted)
        fact = fact.where(F.col("invoice_month").between(F.lit(low.strftime("%Y-%m")), F.lit(high.strftime("%Y-%m"))))
    return fact.where(cal.in_any("invoice_date", wanted)).where(static_predicate(filters))
