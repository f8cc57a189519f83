"""Labels and service-code text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of the service catalogue.
CODED_SERVICE = r" A[0-9]{3}"
GROUP_BEFORE_CODE = r"(?s)^(.*?) .[0-9]{3}"


def has_service_code(abbr) -> Column:
    return F.rlike(abbr, F.lit(CODED_SERVICE))


def service_group(abbr) -> Column:
    """Text in front of the first four-character code; empty if there is none."""
    return F.rtrim(F.regexp_extract(abbr, GROUP_BEFORE_CODE, 1))


def label(*parts) -> Column:
    """Joined text; NULL as soon as one part is NULL."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(*columns)
