"""Report parameters: one dataclass of rule settings and month arithmetic."""

from __future__ import annotations

import calendar
from dataclasses import dataclass, field
from datetime import date, timedelta


@dataclass(frozen=True)
class Month:
    """A report month; its last day is the anchor date of clocks and buckets."""

    label: str

    @property
    def start(self) -> date:
        return date(int(self.label[:4]), int(self.label[5:7]), 1)

    @property
    def end(self) -> date:
        return date(self.start.year, self.start.month, calendar.monthrange(self.start.year, self.start.month)[1])

    def back(self, months: int) -> "Month":
        first = self.start
        for _ in range(months):
            first = (first - timedelta(days=1)).replace(day=1)
        return Month(first.strftime("%Y-%m"))


@dataclass(frozen=True)
class Rules:
    """Business settings (fixed values unless a caller overrides them)."""

    grace_minutes: int = 15
    weekend_days: tuple[str, ...] = ("Friday",)
    has_gosi_source: bool = True
    has_wps_source: bool = True
    case_sla_days: dict[str, int] = field(
        default_factory=lambda: {"Disciplinary": 14, "Grievance": 10, "Labor Case": 30}
    )
    default_sla_days: int = 14
    hire_sla_days: int = 45
    min_rating: float = 1.0
    max_rating: float = 5.0
    critical_titles: tuple[str, ...] = (
        "Chief Executive Officer",
        "Engineering Director",
        "Finance Director",
        "HR Manager",
    )
    source_channels: tuple[str, ...] = ("LinkedIn", "Indeed", "Referral", "Direct", "Agency")
    null_channel_is_unknown: bool = False
    quality_checks: int = 8
    variance_amount: float = 2000.0
    variance_share: float = 0.10
    trend_months: int | None = None  # all months the source has, unless a caller asks for the last few
    default_month: str = "2026-06"
    report_month: str | None = None
    talent_month: str | None = None


# Open statuses of cases and requisitions (fixed values).
OPEN_CASE = ("Open", "In Progress", "Pending")
OPEN_REQUISITION = ("Open", "Approved", "In Progress", "On Hold")
VOID_REQUISITION = ("Cancelled", "Rejected", "Draft")
HIGH_RATINGS = ("Outstanding", "Exceeds Expectations")
LOW_RATINGS = ("Needs Improvement", "Unsatisfactory")
