"""Parameters of the engine. Every span, threshold and table here is a default; operators take their own."""

from __future__ import annotations

from dataclasses import dataclass, field

US = 1_000_000


@dataclass(frozen=True)
class Timing:
    """Spans in seconds. Times are kept as microseconds, so that half-open frames are exact."""

    window_s: float = 30
    stride_s: float = 5
    rate_s: float = 5
    baseline_s: float = 300
    history_s: float = 30
    gap_s: float = 300
    frozen_cap_s: float = 300
    presence_s: float = 60

    def us(self, name: str) -> int:
        return round(getattr(self, f"{name}_s") * US)

    @property
    def strides(self) -> int:
        return round(self.window_s / self.stride_s)


# What results depend on.
MOVING_MPS = 1.0
COURSE_MIN_MPS = 3.0
COURSE_MIN_DISP_M = 20.0
MIN_JITTER_POINTS = 5
MIN_POINTS = 4
TURN_MIN_DPS = 1.0
DEGRADED_NACP_BELOW = 8.0
ALT_MAX_M = 20_000.0
LABEL_POS_FRAC = 1 / 3
UNTRUSTED = (40.0, 55.0)
CAUTION = (70.0, 75.0)
ABNORMAL = (40.0, 55.0)
EMA_DOWN, EMA_UP = 0.7, 0.3
CAUSE_MARGIN = 0.2
CONFIDENCE_LEVELS = ((0.75, "high"), (0.45, "medium"))
SEVERITY_LEVELS = ((0.60, "critical"), (0.40, "high"), (0.20, "medium"), (0.05, "low"))
CRITICALITY = {"high": 1.0, "medium": 0.5, "low": 0.2}
MAX_EVIDENCE = 3
ZONE_BUFFER_M = 50.0
OCCUPANCY_M = 10.0
DWELL_MOVE_M = 10.0
FINAL_KM = 10.0
GLIDESLOPE_DEG = 3.0
ALIGN_DEG = 30.0
CONE_DEG, CONE_FLOOR_M = 6.0, 150.0
PHASE_LOW_M, PHASE_AXIS_M = 150.0, 500.0
GROUND_ALT_CONFLICT_M = 300.0
AIRBORNE_MIN_MPS = 10.0
THRESHOLD_QUANTILE, THRESHOLD_MIN_N = 0.999, 100
BASE_AIR_MPS, BASE_GROUND_MPS, BASE_JUMP_M = 350.0, 30.0, 500.0
AIRPORT_BOX = (41.77, 12.20, 41.86, 12.30)
APPROACH_BOX = (41.53, 11.89, 42.07, 12.61)
AIRPORT_ELEVATION_M = 4.0
HALO_M = 150.0
HALO_ELEVATION_DEG = (45.0, 30.0, 15.0)
HORIZON_S = 60.0
SPLITS = (("train", 0.6), ("calib", 0.2), ("test", 0.2))
ECE_BINS = 15
MEDIAN_ERROR_PER_SIGMA = 1.1774
OPEN_SIGMA_M, OBSTRUCTED_RATIO, FULL_OBSTRUCTION_DEG = 1.26, 4.0, 45.0

CAUSES = ("plausible", "degraded", "technical_error", "gnss_anomaly", "possible_interference", "possible_spoofing", "behavioral_anomaly")
SOUND = ("plausible", "behavioral_anomaly")
UNSOUND = tuple(c for c in CAUSES if c not in SOUND)

# Class, domain, ground m/s, air m/s, acceleration m/s2, turn deg/s, turn radius m, vertical m/s, checked
ENVELOPES = [
    ("widebody", "aircraft", 15.0, 320.0, 4.0, 6.0, 35.0, 25.0, True),
    ("narrowbody", "aircraft", 15.0, 320.0, 4.0, 6.0, 20.0, 25.0, True),
    ("regional", "aircraft", 15.0, 300.0, 4.0, 6.0, 15.0, 25.0, True),
    ("turboprop", "aircraft", 12.0, 180.0, 4.0, 8.0, 15.0, 20.0, True),
    ("bizjet", "aircraft", 15.0, 320.0, 5.0, 8.0, 12.0, 30.0, True),
    ("light", "aircraft", 10.0, 100.0, 4.0, 20.0, 6.0, 15.0, True),
    ("helicopter", "aircraft", 15.0, 90.0, 5.0, 360.0, 0.0, 15.0, False),
    ("other", "aircraft", 15.0, 320.0, 5.0, 20.0, 6.0, 30.0, True),
    ("baggage_tractor", "vehicle", 7.0, None, 2.0, 90.0, 4.0, None, True),
    ("bus", "vehicle", 8.5, None, 1.5, 45.0, 12.0, None, True),
    ("fuel_truck", "vehicle", 7.0, None, 1.5, 45.0, 11.0, None, True),
    ("catering_truck", "vehicle", 7.0, None, 1.5, 45.0, 10.0, None, True),
    ("sar_vehicle", "vehicle", 25.0, None, 3.0, 60.0, 12.0, None, True),
    ("follow_me", "vehicle", 14.0, None, 3.0, 90.0, 6.0, None, True),
]
ENVELOPE_SCHEMA = "asset_class string, class_domain string, ground_max double, air_max double, accel_max double, turn_max double, radius_min double, vrate_max double, kin_checks boolean"

# Codes; the wording is ours.
ACTION_TEXT = {
    "none": "No action needed.",
    "monitor": "Keep watching {asset}. No action needed yet.",
    "verify_radio": "Confirm the position of {asset} by radio before any clearance near {zone}.",
    "verify_visual": "Confirm the position of {asset} visually or with a second source.",
    "cross_check": "Cross-check the position of {asset} with a second source: its reported track is inconsistent.",
    "act_now": "Contact {asset} now: a {asset_class} is moving unexpectedly in {zone}.",
    "area_gnss_unreliable": "Treat GNSS positions near {zone} as unreliable. Confirm positions by radio or visually.",
}


@dataclass(frozen=True)
class Fleet:
    """A profile of the fleet layer. cell_m: side of a hexagon in metres."""

    name: str = "apron"
    cell_m: float = 175.0
    bin_s: float = 60
    min_tracks: int = 3
    share_min: float = 0.5
    baseline_test: bool = True
    alpha: float = 0.01
    baseline_floor: float = 0.02
    ring: int = 1
    warn_share: float = 0.02
    timing: Timing = field(default_factory=Timing)


APRON = Fleet()
REGIONAL = Fleet("regional", cell_m=22_600.0, bin_s=86_400, min_tracks=10, share_min=0.10, baseline_test=False)

# Limits of the per-sample detectors.
DETECT_GAP_S = 3.0
STOPPED_MPS = 0.5
FROZEN_MIN_S = 5.0
JUMP_M, JUMP_MAX_S, JUMP_RETURN_FRAC = 10.0, 300.0, 0.5
MULTIPATH_WINDOW, MULTIPATH_M, MULTIPATH_MIN_RUN = 11, 3.0, 5
SPEED_FACTOR, SPEED_ABS_MPS, SPEED_RESID_MPS, SPEED_RESID_REL = 1.5, 27.8, 5.0, 0.5
IMPLAUSIBLE_MIN_RUN = 3
HEADING_MIN_DISP_M, HEADING_MAX_DEG, HEADING_MIN_RUN = 15.0, 60.0, 3
ALT_SPIKE_M = 10.0
OVERSPEED_TOL, OVERSPEED_MIN_RUN, OVERSPEED_BULK_Q = 0.2, 3, 0.99
ZONE_MIN_RUN = 3
PROXIMITY_M = 20.0
PROXIMITY_EXEMPT = ("pushback_tug", "follow_me")
ROLE_ZONES = {"pushback_tug": ("taxi_corridor",)}
STOP_LIMIT_S = {"runway_critical": 120.0, "runway_strip": 120.0, "taxi_corridor": 300.0, "holding_position": 900.0, "service_road_corridor": 900.0}
STOP_FREE = ("aircraft_stand", "apron")
STOP_AIRCRAFT_FREE = ("holding_position", "taxi_corridor")
# Labels in order of precedence.
SIGNAL_LABELS = ("frozen_position", "position_jump", "fix_loss", "multipath_noise", "gnss_drift", "implausible_speed", "heading_incoherent", "altitude_spike")
BEHAVIOUR_LABELS = ("runway_incursion", "unauthorized_zone", "aircraft_proximity", "overspeed", "unexpected_stop", "wrong_way")
POSITION_WRONG = ("frozen_position", "position_jump", "fix_loss", "multipath_noise", "gnss_drift")
SIGNAL_CAUSE = {
    "frozen_position": "technical_error",
    "position_jump": "technical_error",
    "fix_loss": "technical_error",
    "multipath_noise": "degraded",
    "gnss_drift": "gnss_anomaly",
    "implausible_speed": "technical_error",
    "heading_incoherent": "technical_error",
    "altitude_spike": "gnss_anomaly",
}
