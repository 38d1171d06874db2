"""Synthetic traffic and anomalies put into it: scenes by seed, one mechanism for each cause.

A scene is a function of its seed, so a task that is run again makes the same
rows. Scenes are small; many of them run side by side. Labels say where the
cause acts, and keep the true position.

Assets drive over a net of lanes. A drive is a table of phases of constant
acceleration, solved leg by leg in closed form, so a position at any time is a
look-up. An anomaly is an Effect, what it adds to or takes from the reports of
one track; parameters are drawn from RANGES by name.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waywarden import params
from waywarden.functions import geo
from waywarden.operators.halos import error_ratio
from waywarden.operators.places import to_metric

T0, SLOT_S = 1_600_000_000.0, 1200.0
CENTRE = (41.81, 12.25)
# Upper bounds of accuracy and containment in metres, with their category.
NACP = ((3.0, 11), (10.0, 10), (30.0, 9), (92.6, 8), (185.2, 7), (555.6, 6), (926.0, 5), (1852.0, 4))
NIC = ((7.5, 11), (25.0, 10), (75.0, 9), (185.2, 8), (370.4, 7), (926.0, 6), (1852.0, 5), (3704.0, 4))
EPU_PER_SIGMA = 2.45

POINTS = (
    "track_id string, asset_id string, source string, domain string, seq long, t_us long, t double, lat double, lon double, asset_class string, on_ground boolean, alt_baro_m double, alt_geom_m double, gs_mps double, "
    "track_deg double, heading_deg double, vrate_mps double, nacp double, nic double, sil double, callsign string, typecode_raw string, label_cause string, label_onset_t double, label_event_id string, "
    "label_true_lat double, label_true_lon double, scene_id string, base_track_id string"
)
COLUMNS = [c.split()[0] for c in POINTS.split(", ")]
EVENTS = "event_id string, scene_id string, cause string, t_onset double, t_end double, track_ids array<string>, params_json string"
CLASSES = {e[0]: dict(zip(("domain", "ground", "air", "accel", "turn"), e[1:6], strict=True)) for e in params.ENVELOPES}
GROUND = [c for c, e in CLASSES.items() if e["domain"] == "vehicle"]


def category(value, bounds, worst: int = 3) -> np.ndarray:
    """The category of the first bound above a value; the worst beyond them all."""
    at = np.searchsorted([b for b, _ in bounds], np.asarray(value, float), side="right")
    return np.array([*[float(c) for _, c in bounds], float(worst)])[at]


def reported_quality(sigma) -> tuple[np.ndarray, np.ndarray]:
    """(NACp, NIC) that a receiver gives for an error per axis."""
    epu = EPU_PER_SIGMA * np.asarray(sigma, float)
    return category(epu, NACP), category(100.0 + 5.0 * epu, NIC)


def wander(t, tau: float, rng: np.random.Generator, waves: int = 96) -> np.ndarray:
    """Unit noise at times t whose correlation falls as exp(-lag / tau).

    A sum of waves with frequencies from that correlation's spectrum (a Cauchy
    law), so it needs no order of times and gives one value for one time.
    """
    omega = np.tan(np.pi * (rng.random(waves) - 0.5)) / tau
    phase = rng.uniform(0, 2 * np.pi, waves)
    return np.sqrt(2 / waves) * np.cos(np.outer(np.asarray(t, float), omega) + phase).sum(axis=1)


def moved(lat, lon, north, east) -> tuple[np.ndarray, np.ndarray]:
    """Positions some metres away on the ellipsoid's tangent plane."""
    lat, lon = np.asarray(lat, float), np.asarray(lon, float)
    new = lat + np.degrees(np.asarray(north) * (1 - geo.E2 * np.sin(np.radians(lat)) ** 2) ** 1.5 / (geo.A * (1 - geo.E2)))
    mid = np.radians((lat + new) / 2)
    return new, lon + np.degrees(np.asarray(east) * np.sqrt(1 - geo.E2 * np.sin(mid) ** 2) / (geo.A * np.cos(mid)))


# ---------------------------------------------------------------- motion


class Net:
    """Lanes between places: (x1, y1, x2, y2, top speed), driven both ways."""

    def __init__(self, lanes: list[tuple[float, float, float, float, float]]):
        self.places: list[tuple[float, float]] = sorted({p for a in lanes for p in ((a[0], a[1]), (a[2], a[3]))})
        at = {p: i for i, p in enumerate(self.places)}
        self.lanes: dict[int, dict[int, tuple[float, float]]] = {i: {} for i in at.values()}
        for x1, y1, x2, y2, top in lanes:
            a, b, length = at[x1, y1], at[x2, y2], math.hypot(x2 - x1, y2 - y1)
            if length > 0:
                self.lanes[a][b] = self.lanes[b][a] = (length, top)

    def route(self, a: int, b: int, most: float) -> list[int] | None:
        """The places of the quickest way for an asset of that speed; null where none leads there."""
        cost, came, todo = {a: 0.0}, {}, [(0.0, a)]
        while todo:
            c, here = heapq.heappop(todo)
            if here == b:
                way = [b]
                while way[-1] != a:
                    way.append(came[way[-1]])
                return way[::-1]
            if c > cost[here]:
                continue
            for there, (length, top) in self.lanes[here].items():
                new = c + length / min(top, most)
                if new < cost.get(there, math.inf):
                    cost[there], came[there] = new, here
                    heapq.heappush(todo, (new, there))
        return None


def lattice(rng: np.random.Generator, size: int = 6, gap: float = 420.0, tops: tuple[float, ...] = (8.0, 14.0, 25.0)) -> Net:
    """A net of size x size places about the centre, each off its place by up to a fifth of the gap."""
    cx, cy = to_metric(*CENTRE)
    off = rng.uniform(-gap / 5, gap / 5, (size, size, 2))
    at = lambda i, j: (cx + gap * (i - (size - 1) / 2) + off[i, j, 0], cy + gap * (j - (size - 1) / 2) + off[i, j, 1])
    pairs = [((i, j), (i + di, j + dj)) for i in range(size) for j in range(size) for di, dj in ((1, 0), (0, 1)) if i + di < size and j + dj < size]
    return Net([(*at(*a), *at(*b), float(rng.choice(tops))) for a, b in pairs])


def phases(places: np.ndarray, tops: np.ndarray, accel: float) -> np.ndarray:
    """(t, s, v, a) at the start of each phase of a drive along a broken line, at rest at both ends.

    A place is passed at no more than a speed that falls with the bend; what is
    reachable from every other place with the given acceleration is the lower
    envelope of all places' square speeds. Inside a leg the peak follows in
    closed form: speed up, keep, slow down.
    """
    legs = np.diff(places, axis=0)
    length = np.hypot(*legs.T)
    way = np.concatenate([[0.0], np.cumsum(length)])
    square = np.zeros(len(places))
    if len(legs) > 1:
        bend = np.einsum("ij,ij->i", legs[:-1], legs[1:]) / (length[:-1] * length[1:])
        square[1:-1] = np.maximum(np.minimum(tops[:-1], tops[1:]) * ((1 + bend) / 2) ** 2, 1.2) ** 2
    square = (square[None, :] + 2 * accel * np.abs(way[:, None] - way[None, :])).min(axis=1)
    rows, t = [], 0.0
    for i, (u, w, top) in enumerate(zip(square[:-1], square[1:], tops, strict=True)):
        peak = min(top * top, (u + w) / 2 + accel * length[i])
        v0, v1, v2 = math.sqrt(u), math.sqrt(peak), math.sqrt(w)
        up, down = (peak - u) / (2 * accel), (peak - w) / (2 * accel)
        for lasts, s, v, a in (((v1 - v0) / accel, 0.0, v0, accel), ((length[i] - up - down) / v1, up, v1, 0.0), ((v1 - v2) / accel, length[i] - down, v1, -accel)):
            if lasts > 0:
                rows.append((t, way[i] + s, v, a))
                t += lasts
    rows.append((t, way[-1], 0.0, 0.0))
    return np.array(rows)


@dataclass
class Drive:
    """One way after the other, with pauses at the places between."""

    table: np.ndarray  # phases: t, s, v, a
    way: np.ndarray  # s at each place
    places: np.ndarray

    def at(self, t) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, speed, course) at times t."""
        t = np.asarray(t, float)
        t0, s0, v0, a = self.table[np.clip(np.searchsorted(self.table[:, 0], t, side="right") - 1, 0, None)].T
        e = np.maximum(t - t0, 0.0)
        s, v = s0 + v0 * e + a * e * e / 2, np.maximum(v0 + a * e, 0.0)
        leg = np.clip(np.searchsorted(self.way, s, side="right") - 1, 0, len(self.way) - 2)
        d = self.places[leg + 1] - self.places[leg]
        share = np.clip((s - self.way[leg]) / np.maximum(self.way[leg + 1] - self.way[leg], 1e-9), 0, 1)
        x, y = (self.places[leg] + d * share[:, None]).T
        return x, y, v, np.degrees(np.arctan2(d[:, 0], d[:, 1])) % 360


def drive(rng: np.random.Generator, net: Net, cls: str, seconds: float) -> Drive:
    """Ways between places drawn from the net, with stops, until the time is over."""
    e = CLASSES[cls]
    most, accel = e["ground"] * rng.uniform(0.55, 0.9), 0.4 * e["accel"]
    here, now, s = int(rng.integers(len(net.places))), 0.0, 0.0
    tables, ways, places = [], [], []
    while now < seconds:
        goal = int(rng.integers(len(net.places)))
        way = net.route(here, goal, most) if goal != here else None
        if not way:
            continue
        line = np.array([net.places[i] for i in way])
        table = phases(line, np.array([min(net.lanes[a][b][1], most) for a, b in zip(way, way[1:], strict=False)]), accel)
        length = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])
        tables.append(table + [now, s, 0, 0])
        ways.append(length[:-1] + s)
        places.append(line[:-1])
        now, s, here = now + table[-1, 0] + rng.uniform(8, 45), s + length[-1], goal
    return Drive(np.concatenate(tables), np.concatenate([*ways, [s]]), np.concatenate([*places, [net.places[here]]]))


def obstruction(x: np.ndarray, y: np.ndarray, buildings) -> np.ndarray:
    """Growth of the error where buildings (x, y, height) stand in the way."""
    if not len(buildings):
        return np.ones(len(x))
    b = np.asarray(buildings, float)
    d = np.hypot(x[:, None] - b[:, 0], y[:, None] - b[:, 1])
    steepest = np.degrees(np.arctan2(b[:, 2], np.maximum(d, 1.0))).max(axis=1)
    return np.array([error_ratio(a) for a in steepest])


def report(rng: np.random.Generator, d: Drive, seconds: float, every: float = 1.0, buildings=()) -> dict[str, np.ndarray]:
    """What an asset on a drive reports, and where it truly is: about one fix each `every` seconds."""
    n = int(seconds / every)
    t = every * np.arange(n) + rng.uniform(-0.05, 0.05, n)
    x, y, v, course = d.at(np.maximum(t, 0.0))
    lat, lon = np.array([geo.from_utm(a, b) for a, b in zip(x, y, strict=True)]).T
    sigma = params.OPEN_SIGMA_M * obstruction(x, y, buildings)
    tau = rng.uniform(25, 70)
    shown = moved(lat, lon, sigma * wander(t, tau, rng), sigma * wander(t, tau, rng))
    nacp, nic = reported_quality(sigma)
    speed = np.abs(v + rng.normal(0, 0.08, n))
    return {
        "t": t, "lat": shown[0], "lon": shown[1], "gs_mps": speed, "track_deg": np.where(v > 0.3, (course + rng.normal(0, 0.8, n)) % 360, np.nan), "heading_deg": course,
        "nacp": nacp, "nic": nic, "label_true_lat": lat, "label_true_lon": lon,
    }


def scene(seed: int, assets: int = 6, seconds: float = 600.0, event: bool = True, n_events: int = 1, net: Net | None = None, buildings=()) -> tuple[pd.DataFrame, list[dict]]:
    """Points and events of a scene; its first event has the seed's turn among the causes."""
    rng = np.random.default_rng([seed, assets])
    start, frames = T0 + seed * SLOT_S, []
    net = net or lattice(rng)
    for i in range(assets):
        cls = str(rng.choice(GROUND))
        made = report(rng, drive(rng, net, cls, seconds), seconds, buildings=buildings)
        name, asset = f"synthetic:s{seed}a{i}:0", f"s{seed}a{i}"
        rest = {
            "track_id": name, "asset_id": asset, "source": "synthetic", "domain": "vehicle", "seq": np.arange(len(made["t"])), "asset_class": cls, "on_ground": True, "alt_baro_m": np.nan, "alt_geom_m": 50.0,
            "vrate_mps": np.nan, "sil": 3.0, "callsign": None, "typecode_raw": None, "label_cause": "plausible", "label_onset_t": np.nan, "label_event_id": None, "scene_id": f"scene_{seed}", "base_track_id": name,
        }
        frames.append(pd.DataFrame(made | {"t": start + made["t"]} | rest))
    points, events = pd.concat(frames, ignore_index=True), []
    for cause, onset, lasts, hit in plan_events(points, [params.CAUSES[1:][(seed + i) % 6] for i in range(n_events if event else 0)], rng):
        points, told = inject(points, cause, onset, lasts, hit, seed)
        events.append(told)
    points["t_us"] = np.rint(points.t * 1e6).astype("int64")
    return points[COLUMNS], events


# ---------------------------------------------------------------- planning


def stretches(t: np.ndarray, ok: np.ndarray, pause: float = 3.0) -> list[tuple[float, float]]:
    """(first, last) time of each run of ok fixes without a longer pause."""
    t = t[ok]
    cuts = np.flatnonzero(np.diff(t) > pause)
    return list(zip(t[np.r_[0, cuts + 1]], t[np.r_[cuts, len(t) - 1]], strict=True)) if len(t) else []


def densest(points: pd.DataFrame, radius_m: float) -> tuple[float, float]:
    """The position around which most tracks come within the radius, the first on ties."""
    at = points.groupby("track_id").agg(lat=("label_true_lat", "median"), lon=("label_true_lon", "median"))
    each = points.iloc[:: max(1, len(points) // 200)]
    d = np.hypot((each.label_true_lat.to_numpy()[:, None] - at.lat.to_numpy()) * 111_000, (each.label_true_lon.to_numpy()[:, None] - at.lon.to_numpy()) * 83_000)
    best = int(np.argmax((d <= radius_m).sum(axis=1)))
    return float(each.label_true_lat.iloc[best]), float(each.label_true_lon.iloc[best])


AREA_M = 1500.0


def plan_events(points: pd.DataFrame, causes: list[str], rng: np.random.Generator) -> list[tuple[str, float, float, list[str]]]:
    """(cause, onset, seconds, tracks) of events that do not overlap: each in a slot of its own.

    An area's event takes the tracks that come near the densest place; what an
    asset does itself needs one that moves throughout, where there is one.
    """
    out, first, span = [], points.t.min(), points.t.max() - points.t.min()
    for i, cause in enumerate(causes):
        slot = (first + span * (0.25 + 0.7 * i / len(causes)), 0.7 * span / len(causes))
        lasts = float(min(rng.uniform(60, 120), 0.8 * slot[1]))
        onset = float(slot[0] + rng.uniform(0, 0.9) * (slot[1] - lasts))
        during = points[(points.t >= onset) & (points.t < onset + lasts)]
        names = sorted(during.track_id.unique())
        if cause == "possible_interference":
            lat, lon = densest(during, AREA_M)
            near = during[np.hypot((during.label_true_lat - lat) * 111_000, (during.label_true_lon - lon) * 83_000) <= AREA_M]
            hit = sorted(near.track_id.unique()) or names
        else:
            busy = [n for n in names if any(b - a >= 0.8 * lasts for a, b in stretches(*during.loc[during.track_id == n, ["t", "gs_mps"]].pipe(lambda g: (g.t.to_numpy(), g.gs_mps.to_numpy() > params.MOVING_MPS))))]
            hit = [str(rng.choice(busy or names))]
        out.append((cause, onset, lasts, hit))
    return out


# ---------------------------------------------------------------- anomalies

#: Parameters of each cause: a range to draw from, or the names to choose among.
RANGES: dict[str, dict[str, tuple]] = {
    "degraded": {"sigma_m": (6.0, 14.0), "tau_s": (4.0, 12.0), "silent_share": (0.03, 0.12)},
    "technical_error": {"mode": ("freeze", "jump", "duplicate_t", "out_of_order", "loss"), "jump_m": (80.0, 1500.0), "bearing_deg": (0.0, 360.0), "silent_s": (12.0, 45.0), "every": (2.0, 4.0)},
    "gnss_anomaly": {"reach_m": (80.0, 300.0), "bearing_deg": (0.0, 360.0), "tau_s": (30.0, 60.0), "climb_mps": (-0.8, 0.8)},
    "possible_interference": {"sigma_m": (10.0, 30.0), "radius_m": (1200.0, 2500.0), "kept": (0.0, 0.35), "silent_share": (0.1, 0.3)},
    "possible_spoofing": {"pull_mps2": (0.05, 0.2), "ramp_s": (8.0, 14.0), "bearing_deg": (0.0, 360.0), "climb_mps": (-1.2, 1.2)},
    "behavioral_anomaly": {"mode": ("deviate", "speeding"), "aside_m": (35.0, 110.0), "side_deg": (0.0, 360.0), "faster": (1.25, 1.7)},
}


def drawn(cause: str, rng: np.random.Generator, given: dict | None = None) -> dict:
    """The parameters of an event: what is given, and the rest drawn in the order of their names."""
    out = {}
    for name, span in sorted(RANGES[cause].items()):
        out[name] = str(rng.choice(span)) if isinstance(span[0], str) else float(rng.uniform(*span))
    return out | (given or {})


@dataclass
class Effect:
    """What an anomaly does to the n reports of a track."""

    n: int

    def __post_init__(self):
        self.north, self.east, self.up = (np.zeros(self.n) for _ in range(3))
        self.quality = np.full((2, self.n), np.inf)  # upper bounds of NACp and NIC
        self.lost = np.zeros(self.n, bool)
        self.source = np.arange(self.n)  # the report whose position is shown
        self.time, self.place = np.arange(self.n), np.arange(self.n)  # the report whose time and number are shown
        self.truth: tuple[np.ndarray, np.ndarray] | None = None  # where the asset itself goes

    def shift(self, metres, bearing_deg: float) -> None:
        a = math.radians(bearing_deg)
        self.north, self.east = self.north + metres * math.cos(a), self.east + metres * math.sin(a)

    def scatter(self, t, sigma, tau: float, rng: np.random.Generator) -> None:
        self.north, self.east = (v + sigma * wander(t, tau, rng) for v in (self.north, self.east))


@dataclass
class Case:
    """The reports of one track during an event: time since its onset as a number and as a share, and its middle."""

    g: pd.DataFrame
    e: np.ndarray
    u: np.ndarray
    seconds: float
    centre: tuple[float, float]
    rng: np.random.Generator


def _degraded(c: Case, p: dict, x: Effect) -> None:
    x.scatter(c.e, p["sigma_m"], p["tau_s"], c.rng)
    x.quality[:] = np.array(reported_quality(8 * p["sigma_m"]))[:, None]
    x.lost = c.rng.random(x.n) < p["silent_share"]


def _technical(c: Case, p: dict, x: Effect) -> None:
    step = max(2, round(p["every"]))
    hit = np.flatnonzero(np.arange(x.n) % step == 1)
    if p["mode"] == "freeze":
        x.source[:] = 0
    elif p["mode"] == "jump":
        x.shift(np.full(x.n, p["jump_m"]), p["bearing_deg"])
    elif p["mode"] == "loss":
        x.lost = np.abs(c.e - c.seconds / 2) < min(p["silent_s"], max(c.seconds - 8, 1.0)) / 2
    elif p["mode"] == "duplicate_t":
        x.time[hit] = hit - 1
    elif p["mode"] == "out_of_order":
        x.place[hit], x.place[hit - 1] = hit - 1, hit
    else:
        raise ValueError(f"no fault {p['mode']}")


def _drift(c: Case, p: dict, x: Effect) -> None:
    away = p["reach_m"] * -np.expm1(-c.e / p["tau_s"])
    x.shift(away, p["bearing_deg"])
    x.scatter(c.e, 0.04 * away, 8.0, c.rng)
    x.up = p["climb_mps"] * c.e
    x.quality[:] = reported_quality(params.OPEN_SIGMA_M + away / 2)


def _interference(c: Case, p: dict, x: Effect) -> None:
    d = np.hypot((c.g.label_true_lat - c.centre[0]) * 111_000, (c.g.label_true_lon - c.centre[1]) * 83_000).to_numpy()
    near = np.maximum(np.exp(-((d / p["radius_m"]) ** 2)), 0.3)  # it fades with the distance
    x.scatter(c.e, p["sigma_m"] * near, 6.0, c.rng)
    x.quality[:] = np.floor(c.g[["nacp", "nic"]].to_numpy().T * (1 - (1 - p["kept"]) * near))
    x.lost = (c.rng.random(x.n) < p["silent_share"] * near) & (np.arange(x.n) > 0)


def _spoofing(c: Case, p: dict, x: Effect) -> None:
    pulled = np.minimum(c.e, p["ramp_s"])
    x.shift(p["pull_mps2"] * pulled * (c.e - pulled / 2), p["bearing_deg"])
    x.up = p["climb_mps"] * c.e


def _behaviour(c: Case, p: dict, x: Effect) -> None:
    """The asset itself goes elsewhere, so its true position, speed and course change with it."""
    lat, lon = c.g.label_true_lat.to_numpy(), c.g.label_true_lon.to_numpy()
    out_and_back = np.sin(np.pi * np.clip(c.u, 0, 1)) ** 2
    if "target_lat" in p or p["mode"] == "incursion":
        x.truth = lat + (p["target_lat"] - lat) * out_and_back, lon + (p["target_lon"] - lon) * out_and_back
    elif p["mode"] == "deviate":
        a = math.radians(p["side_deg"])
        x.truth = moved(lat, lon, p["aside_m"] * out_and_back * math.cos(a), p["aside_m"] * out_and_back * math.sin(a))
    elif p["mode"] == "speeding":
        x.truth = tuple(np.interp(np.minimum(1.0, c.u * p["faster"]), c.u, v) for v in (lat, lon))
    else:
        raise ValueError(f"no behaviour {p['mode']}")


MECHANISMS = {"degraded": _degraded, "technical_error": _technical, "gnss_anomaly": _drift, "possible_interference": _interference, "possible_spoofing": _spoofing, "behavioral_anomaly": _behaviour}


def shown(g: pd.DataFrame, x: Effect) -> pd.DataFrame:
    """The reports of a track under an effect, the lost ones still among them."""
    out = g.copy()
    lat, lon = g.lat.to_numpy(), g.lon.to_numpy()
    if x.truth is not None:
        true = g.label_true_lat.to_numpy(), g.label_true_lon.to_numpy()
        lat, lon = lat + x.truth[0] - true[0], lon + x.truth[1] - true[1]
        out["label_true_lat"], out["label_true_lon"] = x.truth
        t = g.t.to_numpy() + 1e-6 * np.arange(len(g))
        north, east = np.gradient(x.truth[0], t) * 111_132, np.gradient(x.truth[1], t) * 111_320 * np.cos(np.radians(x.truth[0]))
        out["gs_mps"], out["track_deg"] = np.hypot(north, east), np.degrees(np.arctan2(east, north)) % 360
    out["lat"], out["lon"] = moved(lat[x.source], lon[x.source], x.north, x.east)
    out["alt_geom_m"] = g.alt_geom_m.to_numpy() + x.up
    for column, bound in zip(("nacp", "nic"), x.quality, strict=True):
        out[column] = np.fmax(np.fmin(g[column].to_numpy(), bound), 0.0)
    out["t"], out["seq"] = g.t.to_numpy()[x.time], g.seq.to_numpy()[x.place]
    return out


def inject(points: pd.DataFrame, cause: str, onset: float, seconds: float, tracks: list[str], seed: int = 0, settings: dict | None = None) -> tuple[pd.DataFrame, dict]:
    """(a new frame with the anomaly and its labels, the event); the input is not touched, and a seed gives one result."""
    if cause not in MECHANISMS:
        raise ValueError(f"no mechanism for {cause}")
    rng, out = np.random.default_rng([seed, *cause.encode()]), points.copy()
    p, name, gone = drawn(cause, rng, settings), f"ev_{cause}_{seed}_{int(onset)}", []
    during = (out.t >= onset) & (out.t < onset + seconds)
    middle = out.loc[during & out.track_id.isin(tracks), ["label_true_lat", "label_true_lon"]].mean()
    for track in tracks:
        g = out[during & (out.track_id == track)].sort_values(["t", "seq"], kind="stable")
        if not len(g):
            continue
        e, x = g.t.to_numpy() - onset, Effect(len(g))
        MECHANISMS[cause](Case(g, e, e / seconds, seconds, tuple(middle), rng), p, x)
        changed = shown(g, x).assign(label_cause=cause, label_event_id=name)
        out.loc[g.index, changed.columns] = changed
        out.loc[(out.track_id == track) & (out.t >= onset), "label_onset_t"] = onset
        gone += list(g.index[x.lost])
    out = out.drop(index=gone).reset_index(drop=True)
    hit = sorted(out.loc[out.label_event_id == name, "track_id"].unique())
    scene_id = str(points.scene_id.iloc[0]) if "scene_id" in points else ""
    return out, {"event_id": name, "scene_id": scene_id, "cause": cause, "t_onset": onset, "t_end": onset + seconds, "track_ids": hit, "params_json": json.dumps(p, sort_keys=True, default=float)}


# ---------------------------------------------------------------- tables


def _rows(points: pd.DataFrame) -> pd.DataFrame:
    return points.astype(object).where(points.notna(), None)


def _by_seed(spark: SparkSession, seeds: int, made, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seed in b["id"]:
                yield made(int(seed))

    return spark.range(seeds).repartition(max(1, seeds // 4), "id").mapInPandas(run, schema)


def scenes(spark: SparkSession, seeds: int, **settings) -> DataFrame:
    """Labelled points of many scenes, made on the executors."""
    return _by_seed(spark, seeds, lambda seed: _rows(scene(seed, **settings)[0]), POINTS)


def events(spark: SparkSession, seeds: int, **settings) -> DataFrame:
    """The events of the same scenes."""
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return _by_seed(spark, seeds, lambda seed: pd.DataFrame(scene(seed, **settings)[1], columns=names), EVENTS)


def busy_hours(points: DataFrame, least: int = 15) -> DataFrame:
    """points of hours with at least so many tracks, with the hour."""
    by = points.withColumn("hour", F.expr("CAST(t_us div 3600000000 AS BIGINT)"))
    return by.join(by.groupBy("hour").agg(F.count_distinct("track_id").alias("_n")).filter(F.col("_n") >= least).select("hour"), "hour")


def approach_scenes(points: DataFrame, cause: str, seconds: float = 90.0, least: int = 15) -> DataFrame:
    """Real traffic by hour as scenes of its own with an event in each; hours with too few tracks are left out.

    An hour of an airport is small; hours run side by side.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hour = int(pdf["hour"].iloc[0])
        pdf = pdf.sort_values(["track_id", "seq"]).reset_index(drop=True)
        pdf = pdf.assign(label_cause="plausible", label_onset_t=np.nan, label_event_id=None, label_true_lat=pdf.lat, label_true_lon=pdf.lon, scene_id=f"approach_{hour}_{cause}", base_track_id=pdf.track_id)
        rng = np.random.default_rng([hour])
        tracks = sorted(pdf.track_id.unique())
        hit = tracks if cause == "possible_interference" else [str(rng.choice(tracks))]
        own = pdf[pdf.track_id.isin(hit)]
        out, _ = inject(pdf, cause, float(own.t.quantile(0.4)), seconds, hit, hour)
        out["t_us"] = np.rint(out.t * 1e6).astype("int64")
        return _rows(out[COLUMNS])

    return busy_hours(points, least).groupBy("hour").applyInPandas(run, POINTS)


# ---------------------------------------------------------------- demonstration

#: A place on the runway, and the acts of the demonstration: cause, onset, seconds, assets.
DEMO_TARGET = (41.8105, 12.2525)
DEMO_ACTS = (("behavioral_anomaly", 90.0, 80.0, (0,)), ("possible_interference", 220.0, 100.0, (1, 2, 3, 4, 5)), ("possible_spoofing", 380.0, 90.0, (6,)))


def demo(seed: int = 20) -> tuple[pd.DataFrame, list[dict]]:
    """A scene that tells a story: an incursion, interference over an area, one asset led astray."""
    points, told = scene(seed, assets=8, seconds=520.0, event=False)
    start = T0 + seed * SLOT_S
    for cause, onset, lasts, assets in DEMO_ACTS:
        settings = {"mode": "incursion", "target_lat": DEMO_TARGET[0], "target_lon": DEMO_TARGET[1]} if cause == "behavioral_anomaly" else None
        points, event = inject(points, cause, start + onset, lasts, [f"synthetic:s{seed}a{i}:0" for i in assets], seed, settings)
        told.append(event)
    points["t_us"] = np.rint(points.t * 1e6).astype("int64")
    return points[COLUMNS], told


def demo_faults(points: pd.DataFrame, told: list[dict]) -> list[str]:
    """What keeps a demonstration from telling its story; nothing for a good one."""
    out = []
    spans = sorted((e["t_onset"], e["t_end"]) for e in told)
    out += ["events overlap"] * any(b > a for (_, b), (a, _) in zip(spans, spans[1:], strict=False))
    for e in told:
        g = points[points.label_event_id == e["event_id"]]
        out += [f"{e['cause']}: few reports"] * (len(g) < 30)
        if e["cause"] == "possible_interference":
            out += ["interference: few assets"] * (len(e["track_ids"]) < params.APRON.min_tracks + 1)
        if e["cause"] == "possible_spoofing":
            out += ["spoofing: accuracy tells"] * bool((g.nacp < params.DEGRADED_NACP_BELOW).any())
        if e["cause"] == "behavioral_anomaly":
            near = np.hypot((g.label_true_lat - DEMO_TARGET[0]) * 111_000, (g.label_true_lon - DEMO_TARGET[1]) * 83_000).min()
            out += ["incursion: never on the runway"] * (not near < 15)
    return out
