"""Parameters of a forecast run.

Nothing here reads the clock: ``as_of`` is always given, so a run can be
repeated on the same data with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta


@dataclass(frozen=True)
class SiteCodes:
    """Codes and names a site uses in its source tables.

    The defaults are fixed values of the source data; override them for a site
    whose tables carry other codes.
    """

    service_area: int = 10
    confirmed_admission: tuple[int, ...] = (1,)
    admitted_or_discharged: tuple[int, ...] = (2, 3)

    kept_appointment: tuple[int, ...] = (2, 6)
    working_due_date: str = "Y"
    high_risk_marker: str = "HROB"
    labour_department: str = "LDR"
    newborn_departments: tuple[str, ...] = ("NNSY", "SFCH06 NIC2", "NIC1", "NNY2")

    operating_locations: tuple[str, ...] = ("ASC", "SFCH05 PERIOP", "MAIN OR", "Urology OR")
    performed_status: tuple[str, ...] = ("Complete", "Posted", "Completed", "Unposted")
    open_schedule_status: tuple[int, ...] = (1, 3, 4, 8)
    outpatient_class: int = 9

    transfer_origin: int = 16
    transfer_region: int = 1391
    direct_admit_topic: str = "100002"
    request_completed: int = 4
    request_cancelled: int = 6
    destination_accepted: tuple[int, ...] = (2, 4)
    target_attachment: int = 21
    intake_attachment: int = 22

    emergency_department: str = "10410001"
    emergency_admit_event: str = "65"
    emergency_event_voided: int = 2

    census_event: int = 6
    census_event_cancelled: int = 2


@dataclass(frozen=True)
class ForecastConfig:
    """Dates, horizons and switches of one forecast run."""

    as_of: date
    hist_start: date = date(2018, 1, 1)
    horizon: int = 30
    horizon_long: int = 119
    lookback_days: int = 28
    curve_days: int = 365
    gestation_days: int = 300
    holidays: tuple[date, ...] = ()
    time_zone: str = "America/Chicago"
    site: str = "Local"
    codes: SiteCodes = field(default_factory=SiteCodes)

    # Departures from the default behaviour, all off unless asked for.
    include_non_admitted: bool = False  # surgical curve also counts cases never admitted
    rank_future_only: bool = False  # first case per patient among future cases only
    truncate_due: bool = False  # group expected deliveries by day, not by timestamp
    dedupe: bool = False  # count an encounter once per patient type

    @property
    def ob_start(self) -> date:
        """First admission day for which a whole pregnancy of contacts can exist."""
        return self.hist_start + timedelta(days=self.gestation_days)

    @property
    def usable_start(self) -> date:
        """One calendar year after the start; 29 February maps to the 28th."""
        start = self.hist_start
        if (start.month, start.day) == (2, 29):
            return date(start.year + 1, 2, 28)
        return start.replace(year=start.year + 1)

    @property
    def lookback_start(self) -> date:
        return self.as_of - timedelta(days=self.lookback_days)

    @property
    def last_census_day(self) -> date:
        """Exclusive end of history: yesterday is already in the current inpatients."""
        return self.as_of - timedelta(days=1)

    @property
    def short_end(self) -> date:
        return self.as_of + timedelta(days=self.horizon)

    @property
    def long_end(self) -> date:
        return self.as_of + timedelta(days=self.horizon_long)

    @property
    def no_prenatal_status(self) -> str:
        return f"No {self.site} Prenatal Care"
