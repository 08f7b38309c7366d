"""Parameters of an analysis: typed defaults, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    """What a run needs to know beside the frames."""

    colours: dict[str, list[float]] = field(default_factory=lambda: {"bgr": [1.0, 1.0, 1.0]})
    second_colours: dict[str, list[float]] = field(default_factory=dict)
    logical: str = "None"  # how the two combinations are joined: And, Or, Xor
    filter_name: str = ""
    filter_p: float = 1.0
    filter_q: float | None = None
    clusters: int = 2
    detection: tuple[str, ...] = ("frame",)  # frame, luminance, slope, or the last two joined
    detection_join: str = "And"  # And or Or
    first_frames: int = 3  # frames that show the origin alone
    most_growth: float = 0.05  # share of the arena that may change in half a frame
    mode: str = "grow"
    fading: float = 0.0  # how far a left pixel's intensity has come back
    specimens: int = 1
    arenas_in_rows: int | None = None
    lighter_background: bool | None = None
    image_width_mm: float | None = None
    unit_mode: str = "corrected"
    time_step: float = 1.0
    first_move_threshold: float = 1.0
    least_size: int = 1
    most_distance: int = 0
    descriptors: tuple[str, ...] = ("area", "perimeter", "circularity", "solidity", "eccentricity")
    fractal: bool = False
    networks: bool = False
    oscillation_period: float = 2.0
    excluded: tuple[int, ...] = ()

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> Settings:
        """Settings from JSON; what is missing takes its default, what is unknown is dropped."""
        raw = json.loads(text)
        known = {f.name for f in fields(cls)}
        kept = {k: tuple(v) if isinstance(v, list) and k in ("descriptors", "excluded", "detection") else v for k, v in raw.items() if k in known}
        return cls(**kept)
