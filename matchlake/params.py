"""Parameters of the operators: defaults, ranges, validation and profiles.

Values become literals of the plan, so Catalyst folds them.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class ParamError(ValueError):
    """A stage, parameter or value that does not exist or is out of range."""


@dataclass(frozen=True)
class Param:
    kind: str
    default: object
    least: float | None = None
    most: float | None = None
    options: tuple[str, ...] = ()

    def checked(self, name: str, value):
        if self.kind == "enum":
            if value not in self.options:
                raise ParamError(f"{name} must be one of {list(self.options)}")
            return value
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ParamError(f"{name} must be a number")
        if not self.least <= value <= self.most:
            raise ParamError(f"{name} must lie between {self.least:g} and {self.most:g}")
        return int(value) if self.kind == "int" else float(value)


# The parameters of each stage, with their kinds, defaults and ranges.
REGISTRY: dict[str, dict[str, Param]] = {
    "player_tracking": {
        "APPEARANCE_WEIGHT": Param("float", 0.45, 0, 1),
        "APPEARANCE_WEIGHT_WITHOUT_ZONES": Param("float", 0.85, 0, 1),
        "ZONE_WEIGHT": Param("float", 0.4, 0, 1),
        "CANDIDATE_MAX_APPEARANCE_DISTANCE": Param("float", 0.34, 0, 1),
        "APPEARANCE_MAX_DISTANCE": Param("float", 0.22, 0, 1),
        "SIDE_MISMATCH_PENALTY": Param("float", 0.35, 0, 1),
        "SIDE_MIN_CONFIDENCE": Param("float", 0.7, 0, 1),
        "MERGE_MAX_COST": Param("float", 0.45, 0, 2),
        "MAX_PLAYERS_PER_SIDE": Param("int", 6, 4, 8),
        "MIN_TRACKLET_FRAMES": Param("int", 2, 1, 30),
        "MIN_IN_PLAY_FRACTION": Param("float", 0.5, 0, 1),
    },
    "ball_detection": {
        "COLLECTION_CONF_THRESHOLD": Param("float", 0.05, 0, 1),
        "MIN_SELECT_CONFIDENCE": Param("float", 0.6, 0, 1),
        "MIN_BALL_DIAGONAL_PX": Param("float", 6.0, 1, 30),
        "MAX_PLAUSIBLE_REPORTED_SPEED_MS": Param("float", 45.0, 10, 80),
        "MIN_FLIGHT_SEGMENT_FRAMES": Param("int", 8, 2, 30),
        "MAX_INTERPOLATE_GAP_FRAMES": Param("int", 20, 1, 60),
    },
    "game_status": {
        "MAX_GAP_SECONDS_WITHIN_RALLY": Param("float", 1.0, 0.2, 5),
        "MIN_RALLY_DURATION_SECONDS": Param("float", 1.5, 0.2, 5),
        "SMOOTHING_WINDOW_CHUNKS": Param("int", 5, 1, 15),
    },
    "action_detection": {
        "HIT_ANGLE_THRESHOLD_DEG": Param("float", 40.0, 10, 80),
        "HIT_SPEED_RATIO_THRESHOLD": Param("float", 1.6, 1, 3),
        "MIN_HIT_SEPARATION_SECONDS": Param("float", 0.3, 0.05, 1),
        "MAX_PLAYER_ATTRIBUTION_DISTANCE_M": Param("float", 2.5, 0.5, 6),
        "NET_PROXIMITY_M": Param("float", 2.5, 0.5, 6),
        "FAST_INCOMING_SPEED_MS": Param("float", 8.0, 2, 20),
        "ACTION_DETECTOR_CONFIDENCE_THRESHOLD": Param("float", 0.6, 0, 1),
    },
    "consolidating": {
        "SERVE_WEIGHTS.speed": Param("float", 0.35, 0, 1),
        "SERVE_WEIGHTS.placement": Param("float", 0.4, 0, 1),
        "SERVE_WEIGHTS.trajectory_height": Param("float", 0.25, 0, 1),
        "RECEIVE_WEIGHTS.placement": Param("float", 0.35, 0, 1),
        "RECEIVE_WEIGHTS.reaction": Param("float", 0.3, 0, 1),
        "RECEIVE_WEIGHTS.handling_speed": Param("float", 0.35, 0, 1),
        "SET_WEIGHTS.placement": Param("float", 0.4, 0, 1),
        "SET_WEIGHTS.height": Param("float", 0.25, 0, 1),
        "SET_WEIGHTS.time_given": Param("float", 0.35, 0, 1),
        "SPIKE_WEIGHTS.positioning": Param("float", 0.25, 0, 1),
        "SPIKE_WEIGHTS.speed": Param("float", 0.3, 0, 1),
        "SPIKE_WEIGHTS.placement": Param("float", 0.25, 0, 1),
        "SPIKE_WEIGHTS.blockers": Param("float", 0.2, 0, 1),
        "BLOCK_WEIGHTS.positioning": Param("float", 0.35, 0, 1),
        "BLOCK_WEIGHTS.reach": Param("float", 0.35, 0, 1),
        "BLOCK_WEIGHTS.timing": Param("float", 0.3, 0, 1),
    },
    "rendering": {
        "TRAIL_LENGTH": Param("int", 15, 1, 60),
        "BALL_MARKER_RADIUS": Param("int", 6, 2, 20),
        "ACTION_DISPLAY_SECONDS": Param("float", 1.5, 0.2, 5),
    },
    "transcoding": {
        "CRF": Param("int", 23, 15, 35),
        "PRESET": Param("enum", "veryfast", options=("ultrafast", "superfast", "veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow")),
    },
    "dashboard": {},
}


def validated(values: dict[str, dict]) -> dict[str, dict]:
    """The values by stage and parameter, converted; unknown names and bad values raise ParamError."""
    out: dict[str, dict] = {}
    for stage, given in values.items():
        if stage not in REGISTRY:
            raise ParamError(f"no stage {stage}")
        out[stage] = {}
        for name, value in given.items():
            if name not in REGISTRY[stage]:
                raise ParamError(f"no parameter {stage}.{name}")
            out[stage][name] = REGISTRY[stage][name].checked(name, value)
    return out


@dataclass(frozen=True)
class Params:
    """A set of values laid over the defaults."""

    values: dict[str, dict] = field(default_factory=dict)

    def get(self, stage: str, name: str):
        return self.values.get(stage, {}).get(name, REGISTRY[stage][name].default)

    def weights(self, name: str) -> dict[str, float]:
        """The factor weights of a score, like SERVE_WEIGHTS."""
        return {k.split(".")[1]: self.get("consolidating", k) for k in REGISTRY["consolidating"] if k.split(".")[0] == name}

    def patched(self, changes: dict[str, dict]) -> Params:
        """These values with validated changes laid over them, parameter by parameter."""
        checked = validated(changes)
        return Params({s: self.values.get(s, {}) | checked.get(s, {}) for s in {*self.values, *checked}})


class Profiles:
    """Named parameter sets; Default can neither be edited nor deleted, and is active when nothing else is."""

    DEFAULT = "default"

    def __init__(self):
        self.sets = {self.DEFAULT: ("Default", Params())}
        self.active = self.DEFAULT

    def create(self, key: str, name: str, base: str | None = None) -> None:
        self.sets[key] = (name, self.sets.get(base, self.sets[self.DEFAULT])[1])

    def _own(self, key: str) -> tuple[str, Params]:
        if key == self.DEFAULT:
            raise ParamError("Default can't be changed")
        if key not in self.sets:
            raise ParamError(f"no profile {key}")
        return self.sets[key]

    def update(self, key: str, name: str | None = None, changes: dict | None = None) -> None:
        old, params = self._own(key)
        self.sets[key] = (old if name is None else name, params.patched(changes or {}))

    def delete(self, key: str) -> None:
        self._own(key)
        del self.sets[key]
        if self.active == key:
            self.active = self.DEFAULT

    def activate(self, key: str) -> None:
        if key not in self.sets:
            raise ParamError(f"no profile {key}")
        self.active = key
