"""Column roles of a message series."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SeriesSpec:
    """Names the columns that play each role in a message table.

    ``ttr`` is the time left to the unit's reference instant, so *larger means
    earlier*.  ``tie`` orders messages of a unit that share one ``ttr``; Spark has
    no file order, so it is required.  ``group`` is the reporting group.
    """

    unit: str = "unit"
    ttr: str = "ttr"
    tie: str = "tie"
    value: str = "value"
    group: str | None = "grp"


CDM_SERIES = SeriesSpec(
    unit="event_uid", ttr="time_to_tca", tie="file_row", value="risk", group="mission_id"
)
