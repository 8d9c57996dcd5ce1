"""The limits of the detectors: one table of named numbers, with their units in their names (h, s, km, knots)."""

from __future__ import annotations

#: What the limits are unless others are given.
LIMITS: dict[str, float] = {
    "silence_h": 4.0, "silence_km": 1.0,  # A: both are exceeded
    "draught_h": 2.0, "draught_share": 0.05, "draught_port_km": 0.0,  # C: the first two are exceeded, away from ports of at least this radius
    "jump_knots": 60.0, "jump_km": 1.0, "jump_least_s": 30, "clone_h": 0.5, "jump_h": 24.0,  # D: up to clone_h a cloned identity (D1), up to jump_h a jump (D2)
    "jump_port_km": 15.0, "clone_episode_h": 2.0,  # a D2 end this close to a port is near it; D1 within this belong together
    "meeting_km": 0.5, "meeting_knots": 1.0, "meeting_h": 2.0, "meeting_bucket_s": 300, "meeting_gap_s": 600, "meeting_port_km": 0.0,  # B
    "track_sample_s": 300, "meeting_sample_s": 1200,  # a vessel's first record of each such bucket is a sample; 0: every record is
}


class Detection:
    """The limits in force, as attributes: those of ``LIMITS`` but for the ones given by name."""

    def __init__(self, **given: float):
        for name, value in given.items():
            if name not in LIMITS:
                raise TypeError(f"no limit is called {name}")
            if not 0 <= value < float("inf"):
                raise ValueError(f"{name} must be a number from 0 on, not {value}")
        self.__dict__.update(LIMITS | given)

    @property
    def continuation_s(self) -> int:
        """A meeting goes on over occupied buckets no further apart than this."""
        return int(max(self.meeting_gap_s, self.meeting_sample_s + max(self.meeting_bucket_s, 1)))
