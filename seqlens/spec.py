"""Column roles of an ordered-event ("sequence") table."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SequenceSpec:
    """Names of the columns that play each role.

    A sequence is one (entity, group, season) key; rows inside it are ordered
    by ``step`` then ``tiebreak`` (the order must be total for determinism).
    """

    entity: str = "driver"
    group: str = "race"
    season: str = "yr"
    step: str = "lap"
    tiebreak: tuple[str, ...] = ()
    part: tuple[str, ...] = ()  # further key columns, as of a long sequence's parts
    target: str = "will_pit"
    supplied_label: str = "pit_next_lap"
    stint: str = "stint"
    category: str = "compound"
    value: str = "lap_time"
    delta: str = "lap_time_delta"
    degradation: str = "cumulative_degradation"
    position: str = "position"
    position_change: str = "position_change"
    leakage: tuple[str, ...] = ("pit_next_lap", "next_stint", "pit_stop")
    base_numeric: tuple[str, ...] = field(default=(
        "lap", "stint", "tyre_life", "position", "lap_time", "yr",
        "lap_time_delta", "cumulative_degradation", "race_progress",
        "normalized_tyre_life", "position_change"))
    low_card: tuple[str, ...] = ("compound",)
    high_card: tuple[str, ...] = ("driver", "race")

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.group, self.season, *self.part]

    @property
    def order(self) -> list[str]:
        return [self.step, *self.tiebreak]


LAPS = SequenceSpec()
