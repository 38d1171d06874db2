"""Tracks for tests: constant speed along one course, then bent."""

import math

import pandas as pd

from waywarden.functions import geo

T0 = 1_791_900_000
POINT = (
    "track_id string, asset_id string, source string, domain string, seq long, t_us long, t double, lat double, lon double, asset_class string, on_ground boolean, alt_baro_m double, alt_geom_m double, "
    "gs_mps double, track_deg double, heading_deg double, vrate_mps double, nacp double, nic double, sil double, callsign string, typecode_raw string"
)


def move(lat, lon, bearing, metres):
    """(lat, lon) some metres along a bearing, on the sphere's radii at the start: good to centimetres here."""
    s = math.sin(math.radians(lat)) ** 2
    dn, de = metres * math.cos(math.radians(bearing)), metres * math.sin(math.radians(bearing))
    new = lat + math.degrees(dn * (1 - geo.E2 * s) ** 1.5 / (geo.A * (1 - geo.E2)))
    return new, lon + math.degrees(de * math.sqrt(1 - geo.E2 * s) / (geo.A * math.cos(math.radians((lat + new) / 2))))


def track(n=120, dt=1.0, speed=5.0, course=90.0, cls="bus", domain="vehicle", name="test:a:0", t0=T0, lat=41.80, lon=12.25, **columns):
    rows = []
    for i in range(n + 1 if n == 120 else n):
        la, lo = move(lat, lon, course, speed * dt * i)
        t = t0 + dt * i
        rows.append({
            "track_id": name, "asset_id": name.split(":")[1], "source": "test", "domain": domain, "seq": i, "t_us": round(t * 1e6), "t": t, "lat": la, "lon": lo, "asset_class": cls,
            "on_ground": domain == "vehicle", "alt_baro_m": None, "alt_geom_m": None, "gs_mps": speed, "track_deg": course, "heading_deg": course, "vrate_mps": None, "nacp": 10.0, "nic": 8.0,
            "sil": 3.0, "callsign": None, "typecode_raw": None,
        } | columns)
    return pd.DataFrame(rows)


def shift(p, rows, north_m=0.0, east_m=0.0):
    p = p.copy()
    for i in rows:
        la, lo = move(p.at[i, "lat"], p.at[i, "lon"], 0.0, north_m)
        la, lo = move(la, lo, 90.0, east_m)
        p.at[i, "lat"], p.at[i, "lon"] = la, lo
    return p


def frame(spark, p):
    cols = [c.split()[0] for c in POINT.split(", ")]
    rows = [tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in p[cols].itertuples(index=False)]
    return spark.createDataFrame(rows, POINT)


def windows_of(spark, p, timing=None):
    from waywarden.operators.windows import window_features
    from waywarden.params import Timing

    return window_features(frame(spark, p), timing or Timing()).toPandas().sort_values(["track_id", "t_end"]).set_index("t_end")
