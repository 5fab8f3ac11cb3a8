"""Times as people and logs write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of the units of a relative time.
UNITS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def epoch(text: Column, now: int) -> Column:
    """Seconds since 1970 of digits, of an ISO date or time (UTC unless it says), of ``now`` or of ``-1 day`` and the like; else null."""
    trimmed = F.lower(F.trim(text))
    relative = r"^([+-]?\d+)\s*(second|sec|minute|min|hour|day|week)s?(\s+ago)?$"
    unit = F.regexp_extract(trimmed, relative, 2)
    size = F.lit(None).cast("long")
    for name, seconds in UNITS.items():
        size = F.when(unit == name, seconds).otherwise(size)
    count = F.try_to_number(F.regexp_replace(F.regexp_extract(trimmed, relative, 1), r"^\+", ""), F.lit("S999999999")).cast("long")
    count = F.when(F.regexp_extract(trimmed, relative, 3) != "", -count).otherwise(count)
    digits = F.when(trimmed.rlike(r"^\d+$"), trimmed.try_cast("long"))
    stamp = F.when(trimmed.rlike(r"^\d{4}-\d\d-\d\d"), F.unix_seconds(F.upper(trimmed).try_cast("timestamp")))
    return F.coalesce(digits, F.when(trimmed == "now", F.lit(now)), F.lit(now) + count * size, stamp).cast("long")
