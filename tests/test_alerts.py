"""Area alerts against a plain simulation, one grid time after the other."""

import random

import pytest

from waywarden.functions.geo import hex_disk
from waywarden.operators import fleet
from waywarden.params import APRON


def simulated(flagged, held, stride):
    """{(k, id): cells}: components take the first id of the alerts they touch; an alert without one lasts a while."""
    alive, out = {}, {}
    for k in range(min(flagged), max(flagged) + held + 1):
        left, found = set(flagged.get(k, ())), []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                q, r = todo.pop()
                part.add((q, r))
                for dq, dr in hex_disk(1):
                    if (q + dq, r + dr) in left:
                        left.discard((q + dq, r + dr))
                        todo.append((q + dq, r + dr))
            found.append({f"{q}:{r}" for q, r in part})
        now, merged = {}, set()
        for part in sorted(found, key=lambda c: (-len(c), min(c))):
            touched = sorted(a for a, (cells, _) in alive.items() if a not in merged and cells & part)
            name = touched[0] if touched and touched[0] not in now else f"area_{round(k * stride)}_{min(part)}"
            merged.update(touched[1:])
            now[name] = (part, k)
        alive = now | {a: v for a, v in alive.items() if a not in now and a not in merged and k - v[1] < held}
        out |= {(k, a): (tuple(sorted(cells)), last == k) for a, (cells, last) in alive.items()}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_alerts_equal_the_simulation(spark, seed):
    rng, flagged = random.Random(seed), {}
    spots = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(6)]
    for k in range(1000, 1060):
        cells = set()
        for i, (q, r) in enumerate(spots):
            if (k // (3 + i)) % (2 + i % 3):
                cells |= {(q + dq, r + dr) for dq, dr in hex_disk(2) if rng.random() < 0.45}
            spots[i] = (q + rng.choice([0, 0, 1, -1]), r + rng.choice([0, 0, 1]))
        if cells:
            flagged[k] = cells
    rows = [("x", k, q, r, f"{q}:{r}", 4, 4, True) for k, cs in flagged.items() for q, r in cs]
    counts = spark.createDataFrame(rows, "area string, k long, q long, r long, cell string, n_tracks long, n_degraded long, flagged boolean")
    want = simulated(flagged, fleet.held_steps(APRON), APRON.timing.stride_s)
    for by_history in (True, False):
        got = {(r["k"], r["area_alert_id"]): (tuple(r["cells"]), r["flagged"]) for r in fleet.area_alerts(counts, APRON, by_history=by_history).collect()}
        assert got == want and len({a for _, a in got}) > 3


def test_a_stream_of_short_spans_gives_the_same(spark):
    """Parts carried from span to span name the same alerts as the whole."""
    from pyspark.sql import functions as F

    rng, flagged = random.Random(9), {}
    for k in range(200, 240):
        flagged[k] = {(q, r) for q in range(6) for r in range(6) if rng.random() < 0.25 and k % 17 < 12}
    rows = [("x", k, q, r, f"{q}:{r}", 4, 4, True) for k, cs in flagged.items() for q, r in cs]
    counts = spark.createDataFrame(rows, "area string, k long, q long, r long, cell string, n_tracks long, n_degraded long, flagged boolean").cache()
    whole = {(r["k"], r["area_alert_id"]): tuple(r["cells"]) for r in fleet.area_alerts(counts).collect() if r["k"] < 240}
    held, before, got = fleet.held_steps(APRON), None, {}
    for a, b in ((200, 209), (210, 214), (215, 232), (233, 239)):
        parts = fleet.alert_parts(counts.filter(F.col("k").between(a, b)), APRON, before, by_history=False)
        parts = spark.createDataFrame(parts.collect(), parts.schema)
        got |= {(r["k"], r["area_alert_id"]): tuple(r["cells"]) for r in fleet.shown_alerts(parts, counts).collect() if a <= r["k"] <= b}
        before = parts.filter(F.col("last") & (F.col("k") + held > b)).select("area", "area_alert_id", "k", "cells")
    assert got == whole
