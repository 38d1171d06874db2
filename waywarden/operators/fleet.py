"""Many tracks at once: cells, leave-one-out neighbours, area alerts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params
from waywarden.functions import geo
from waywarden.operators.graph import components
from waywarden.operators.windows import TRACK
from waywarden.params import APRON, REGIONAL, Fleet
from waywarden.tables import written


def cells(df: DataFrame, side: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with q, r and cell ('q:r') of the hexagon that holds each position in the metric grid; null without a position."""
    out = geo.with_hex(geo.with_utm(df, lat, lon, "_x", "_y"), "_x", "_y", side)
    name = F.concat_ws(":", F.col("q").cast("string"), F.col("r").cast("string"))
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return out.withColumns({"cell": F.when(placed, name), "q": F.when(placed, F.col("q")), "r": F.when(placed, F.col("r"))}).drop("_x", "_y")


def placed_cells(df: DataFrame, side: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """cells() of rows that have a position, and only those.

    Columns that cannot be null keep the optimizer from pushing a null check,
    and with it the whole projection, below every join on them.
    """
    out = geo.with_hex(geo.with_utm(df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()), lat, lon, "_x", "_y"), "_x", "_y", side).drop("_x", "_y")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in "qr"})
    return out.withColumn("cell", F.concat_ws(":", F.col("q").cast("string"), F.col("r").cast("string")))


def regional(points: DataFrame, profile: Fleet = REGIONAL) -> DataFrame:
    """Cells of a day: an aircraft is degraded in one if most of its readings there are; cells with enough aircraft only.

    Accuracy is carried forward over an aircraft's whole frame and only
    aircraft that ever reported a good one count; readings on the ground do not.
    """
    p = points.filter(~F.coalesce("on_ground", F.lit(False)))
    w = Window.partitionBy("asset_id")
    p = p.withColumn("nacp", F.last("nacp", ignorenulls=True).over(w.orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("_best", F.max("nacp").over(w)).filter((F.col("_best") >= params.DEGRADED_NACP_BELOW) & F.col("nacp").isNotNull())
    bin_us = round(profile.bin_s * params.US)
    p = placed_cells(p, profile.cell_m).withColumn("bin_start", F.expr(f"CAST(floor(t_us / {bin_us}.0D) AS BIGINT) * {profile.bin_s}"))
    per = p.groupBy("cell", "bin_start", "asset_id").agg((F.avg((F.col("nacp") < params.DEGRADED_NACP_BELOW).cast("double")) > 0.5).cast("long").alias("bad"))
    out = per.groupBy("cell", "bin_start").agg(F.count("*").alias("n_tracks"), F.sum("bad").alias("n_degraded")).filter(F.col("n_tracks") >= profile.min_tracks)
    share = F.col("n_degraded") / F.col("n_tracks")
    level = F.when(share > profile.share_min, "red").when(share > profile.warn_share, "yellow").otherwise("green")
    return out.withColumns({"share": share, "level": level}).withColumn("flagged", F.col("level") == "red")


def presence(windows: DataFrame, profile: Fleet = APRON) -> DataFrame:
    """(area, track_id, k, cell, q, r, degraded, own): the latest window of each track at each grid time, for at most bin_s.

    A window (track_id, k, aux_lat, aux_lon, degraded) is carried to the grid
    times before the track's next window; own marks the window itself. Tracks
    see each other inside an area (a scene or an airport); without the column
    all windows are one.
    """
    stride = profile.timing.stride_s
    n = max(1, round(profile.bin_s / stride))
    if "area" not in windows.columns:
        windows = windows.withColumn("area", F.lit("all"))
    w = Window.partitionBy(TRACK).orderBy("k")
    s = windows.dropDuplicates([TRACK, "k"]).withColumn("_next", F.lead("k").over(w))
    s = s.withColumn("_until", F.least(F.coalesce("_next", F.col("k") + n), F.col("k") + n))
    s = placed_cells(s.withColumn("degraded", F.coalesce("degraded", F.lit(False))), profile.cell_m, "aux_lat", "aux_lon")
    at = F.explode(F.sequence("k", F.col("_until") - 1))
    return s.select("area", TRACK, at.alias("at"), "k", "cell", "q", "r", "degraded").select("area", TRACK, F.col("at").alias("k"), "cell", "q", "r", "degraded", (F.col("at") == F.col("k")).alias("own"))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(X >= k) of n trials: one run over the terms, added up below k and from k on. 1 for k <= 0.

    Terms are carried as logarithms: the first of very many trials is less than any double.
    """
    odds = F.log(p) - F.log1p(-p)
    zero = F.struct((n * F.log1p(-p)).alias("ln"), F.lit(0.0).alias("below"), F.lit(0.0).alias("above"))

    def step(acc: Column, i: Column) -> Column:
        # acc.ln is the logarithm of P(X = i)
        term, low = F.exp(acc["ln"]), i < k
        return F.struct((acc["ln"] + F.log((n - i) / (i + 1)) + odds).alias("ln"), (acc["below"] + F.when(low, term).otherwise(0.0)).alias("below"), (acc["above"] + F.when(low, 0.0).otherwise(term)).alias("above"))

    # the tail's own terms, when it is small, keep the digits that 1 - below would lose
    inner = F.aggregate(F.sequence(F.lit(0), n.cast("int")), zero, step, lambda acc: F.when(acc["below"] < 0.5, 1 - acc["below"]).otherwise(acc["above"]))
    return F.when(k > n, 0.0).when((k <= 0) | (p >= 1), 1.0).otherwise(inner)


def crowded(n: Column, bad: Column, profile: Fleet = APRON) -> Column:
    """Enough tracks, and most of them degraded."""
    return (n >= profile.min_tracks) & (F.coalesce(F.try_divide(bad, n), F.lit(0.0)) > profile.share_min)


def flag(n: Column, bad: Column, base: Column, profile: Fleet = APRON) -> Column:
    """The area rule: crowded, and more than the cell's baseline explains, which is computed for crowded cells only."""
    few = crowded(n, bad, profile)
    return F.when(few, binomial_tail(n, bad, base) < profile.alpha).otherwise(False) if profile.baseline_test else few


def cell_counts(state: DataFrame, profile: Fleet = APRON, baseline: DataFrame | None = None) -> DataFrame:
    """(area, cell, q, r, k, n_tracks, n_degraded, share, baseline, p_value, flagged); baseline (cell, baseline) is floored."""
    c = state.groupBy("area", "cell", "q", "r", "k").agg(F.count("*").alias("n_tracks"), F.sum(F.col("degraded").cast("long")).alias("n_degraded"))
    if baseline is not None:
        c = c.join(baseline.select("cell", F.col("baseline").alias("_b")), "cell", "left")
    else:
        c = c.withColumn("_b", F.lit(None).cast("double"))
    floor = F.lit(profile.baseline_floor)
    c = c.withColumn("baseline", F.greatest(F.coalesce("_b", floor), floor)).drop("_b")
    n, bad = F.col("n_tracks"), F.col("n_degraded")
    # a name of its own between two uses: the optimizer does not copy the tail into both
    c = c.withColumns({"share": bad / n, "p_value": binomial_tail(n, bad, F.col("baseline"))})
    return c.withColumn("flagged", crowded(n, bad, profile) & ((F.col("p_value") < profile.alpha) if profile.baseline_test else F.lit(True)))


def baseline_rates(windows: DataFrame, profile: Fleet = APRON) -> DataFrame:
    """(cell, baseline): the share of degraded windows of clean traffic."""
    return presence(windows, profile).filter("own").groupBy("cell").agg(F.avg(F.col("degraded").cast("double")).alias("baseline"))


def ring(df: DataFrame, k: int, centre: bool) -> DataFrame:
    """df once for each cell within k steps, as nq and nr."""
    steps = [(q, r) for q, r in geo.hex_disk(k) if centre or (q, r) != (0, 0)]
    offsets = F.explode(F.array(*[F.struct(F.lit(q).alias("dq"), F.lit(r).alias("dr")) for q, r in steps]))
    return df.withColumn("_o", offsets).withColumns({"nq": F.col("q") + F.col("_o.dq"), "nr": F.col("r") + F.col("_o.dr")}).drop("_o")


def fleet_features(windows: DataFrame, profile: Fleet = APRON, baseline: DataFrame | None = None) -> DataFrame:
    """(track_id, k) with the fleet columns for windows that have a position; a track never counts in its own.

    Neighbour sums come from the counts of populated cells, each sent to its
    ring, so the join is by equality; leaving a track out is a subtraction.
    """
    state = presence(windows, profile)
    counts = cell_counts(state, profile, baseline)
    # without a track a cell is one of two, by whether that one was degraded: the tail is taken for cells, not for tracks
    n, bad, base = (F.col(c) for c in ("n_tracks", "n_degraded", "baseline"))
    counts = counts.withColumns({"_good": flag(n - 1, bad, base, profile), "_bad": flag(n - 1, bad - 1, base, profile)})
    dq, dr = F.col("nq") - F.col("q"), F.col("nr") - F.col("r")
    sent = ring(counts, max(profile.ring, 1), True).withColumn("_far", F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr)))
    near = sent.groupBy("area", "k", F.col("nq").alias("q"), F.col("nr").alias("r")).agg(
        F.sum(F.when(F.col("_far") <= profile.ring, n)).alias("n_disk"),
        F.sum(F.when(F.col("_far") <= profile.ring, bad)).alias("bad_disk"),
        F.count_if((F.col("_far") == 1) & F.col("flagged")).alias("n_flagged"),
        *[F.max(F.when(F.col("_far") == 0, F.col(c))).alias(c) for c in ("_good", "_bad")],
    )
    own = state.filter("own").join(near, ["area", "q", "r", "k"])
    others, bad_others = F.col("n_disk") - 1, F.col("bad_disk") - F.col("degraded").cast("long")
    return own.select(
        TRACK,
        "k",
        others.cast("double").alias("flt_n_others"),
        F.coalesce(F.try_divide(bad_others, others), F.lit(0.0)).alias("flt_deg_rate_loo"),
        bad_others.cast("double").alias("flt_deg_count_loo"),
        F.when(F.col("degraded"), F.col("_bad")).otherwise(F.col("_good")).cast("double").alias("flt_cell_flagged_loo"),
        (F.col("n_flagged") / 6.0).alias("flt_nbr_flagged_frac"),
    )


# ---------------------------------------------------------------- area alerts

#: Flagged cells of a patch of so many by so many are connected in one place.
PATCH = 32


def _patch_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The connected parts of a patch's cells, each named by its first cell."""
    cells = list(zip(pdf["q"], pdf["r"], strict=True))
    name = {c: c for c in cells}

    def root(c):
        while name[c] != c:
            name[c] = name[name[c]]
            c = name[c]
        return c

    for q, r in cells:
        for dq, dr in ((1, 0), (0, 1), (1, -1)):
            if (q + dq, r + dr) in name:
                one, two = sorted((root((q, r)), root((q + dq, r + dr))))
                name[two] = one
    return pdf.assign(local=["{}:{}".format(*root(c)) for c in cells])


def parts(flagged: DataFrame) -> DataFrame:
    """(area, k, q, r, cell, part): the connected part that each flagged cell (area, k, q, r, cell) belongs to at its time.

    Patches of PATCH x PATCH cells are connected each by itself; only links
    over their borders go through components(), so no task holds a whole area.
    """
    keys = ["area", "k", "q", "r", "cell"]
    f = flagged.select(*keys, F.floor(F.col("q") / PATCH).alias("pq"), F.floor(F.col("r") / PATCH).alias("pr"))
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in f.schema)
    local = written(f.groupBy("area", "k", "pq", "pr").applyInPandas(_patch_parts, f"{kinds}, local string"), "patches")
    node = F.concat_ws("|", "area", *[F.col(c).cast("string") for c in ("k", "pq", "pr")], "local")
    at = local.withColumn("node", node)
    edge = F.pmod(F.col("q"), F.lit(PATCH)).isin(0, PATCH - 1) | F.pmod(F.col("r"), F.lit(PATCH)).isin(0, PATCH - 1)
    side = at.filter(edge)
    other = side.select("area", "k", F.col("q").alias("nq"), F.col("r").alias("nr"), F.col("node").alias("b"))
    links = ring(side, 1, False).join(other, ["area", "k", "nq", "nr"]).filter("node < b").select(F.col("node").alias("a"), "b")
    joined = components(links)
    whole = at.join(joined, at["node"] == joined["id"], "left").withColumn("part", F.coalesce("component", "node"))
    return whole.select(*keys, "part")


def held_steps(profile: Fleet) -> int:
    """For how many grid times an alert lasts without a flagged cell."""
    return max(1, -(-round(profile.bin_s) // max(1, round(profile.timing.stride_s))))


def _named(held: int, stride: float):
    """Parts of a history in order of time to alerts: (area, area_alert_id, k, until, cells).

    A part goes on with the first id among the alerts whose last part shares a
    cell with it; the others it meets end there. Where several parts meet one
    alert, the largest goes on with it. A part is shown until its alert's next
    part, the end of the alert in another one, or `held` steps.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(first=[min(c) for c in pdf["cells"]]).sort_values(["k", "n", "first"], ascending=[True, False, True])
        shown: list[list] = []  # area, id, k, until, cells
        live: dict[str, int] = {}  # alert to the place of its last part
        for k, now in rows.groupby("k", sort=True):
            live = {a: i for a, i in live.items() if k - shown[i][2] <= held}
            holder: dict[str, set[str]] = {}
            for a, i in live.items():
                for c in shown[i][4]:
                    holder.setdefault(c, set()).add(a)
            ended, taken = set(), set()
            for area, known, first, cells in zip(now["area"], now["area_alert_id"], now["first"], now["cells"], strict=True):
                meets = [] if known else sorted(set().union(*(holder.get(c, ()) for c in cells)) - ended)
                alert = known or (meets[0] if meets and meets[0] not in taken else f"area_{round(k * stride)}_{first}")
                ended.update(meets[1:])
                for a in ({alert, *meets[1:]} & live.keys()) - taken:
                    shown[live[a]][3] = min(shown[live[a]][3], k)
                taken.add(alert)
                live[alert] = len(shown)
                shown.append([area, alert, k, k + held, list(cells)])
            for a in ended - taken:
                live.pop(a, None)
        last = set(live.values())
        return pd.DataFrame([(*x, i in last) for i, x in enumerate(shown)], columns=["area", "area_alert_id", "k", "until", "cells", "last"])

    return run


def alert_parts(counts: DataFrame, profile: Fleet = APRON, before: DataFrame | None = None, by_history: bool = True) -> DataFrame:
    """(area, area_alert_id, k, until, cells, last): each connected part of flagged cells, the alert it belongs to, the time it is shown to, and whether its alert may go on from it.

    Only flagged cells, few beside all, come here. Parts of different times that
    share a cell and are not too far apart make up a history; naming folds in
    time inside each history by itself. before has parts (area, area_alert_id,
    k, cells) of alerts that may go on, for a stream; by_history=False folds
    whole areas, for short spans of time.
    """
    held = held_steps(profile)
    made = parts(counts.filter("flagged")).groupBy("area", "k", "part").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    p = made.withColumn("area_alert_id", F.lit(None).cast("string"))
    if before is not None:
        p = p.unionByName(before.select("area", "k", F.concat(F.lit("before|"), "area_alert_id", F.lit("|"), F.col("k").cast("string")).alias("part"), "cells", "area_alert_id"))
    p = p.withColumn("n", F.size("cells").cast("long"))
    group = ["area"]
    if by_history:
        p = written(p, "parts")
        w = Window.partitionBy("area", "cell").orderBy("k")
        # a cell's next flagged time leads to the next part; a part's own cells lead to each other through its name
        each = p.select("area", "k", "part", F.explode("cells").alias("cell")).withColumn("_n", F.lead(F.struct("k", "part")).over(w))
        links = each.filter(F.col("_n.k") - F.col("k") <= held).select(F.col("part").alias("a"), F.col("_n.part").alias("b")).distinct()
        joined = components(links)
        p = p.join(joined, p["part"] == joined["id"], "left").withColumn("history", F.coalesce("component", "part"))
        group = ["area", "history"]
    out = p.select(*group, "k", "area_alert_id", "n", "cells").groupBy(*group)
    return out.applyInPandas(_named(held, profile.timing.stride_s), "area string, area_alert_id string, k long, until long, cells array<string>, last boolean")


def shown_alerts(alert_parts_: DataFrame, counts: DataFrame) -> DataFrame:
    """(area, area_alert_id, k, cells, share, n_tracks, n_degraded, flagged): one row for each alert at each grid time it lasts."""
    at = F.explode(F.sequence("k", F.col("until") - 1))
    alerts = alert_parts_.filter("until > k").select("area", "area_alert_id", "cells", F.col("k").alias("_k"), at.alias("k")).withColumn("flagged", F.col("k") == F.col("_k")).drop("_k")
    each = alerts.withColumn("cell", F.explode("cells")).select("area", "area_alert_id", "k", "cell")
    sums = each.join(counts.select("area", "cell", "k", "n_tracks", "n_degraded"), ["area", "cell", "k"], "left").groupBy("area", "area_alert_id", "k").agg(F.coalesce(F.sum("n_tracks"), F.lit(0)).alias("n_tracks"), F.coalesce(F.sum("n_degraded"), F.lit(0)).alias("n_degraded"))
    out = alerts.join(sums, ["area", "area_alert_id", "k"])
    return out.withColumn("share", F.coalesce(F.try_divide("n_degraded", "n_tracks"), F.lit(0.0)))


def area_alerts(counts: DataFrame, profile: Fleet = APRON, before: DataFrame | None = None, by_history: bool = True) -> DataFrame:
    """The alerts of flagged cells at each grid time, see shown_alerts()."""
    return shown_alerts(alert_parts(counts, profile, before, by_history), counts)


def alert_members(windows: DataFrame, alerts: DataFrame, profile: Fleet = APRON) -> DataFrame:
    """(track_id, k, area_alert_id): windows that sit in an alert's cells at their time, the smallest id where several."""
    own = presence(windows, profile).filter("own").select("area", TRACK, "k", "cell")
    each = alerts.select("area", "area_alert_id", "k", F.explode("cells").alias("cell"))
    return own.join(each, ["area", "cell", "k"]).groupBy(TRACK, "k").agg(F.min("area_alert_id").alias("area_alert_id"))


def outline(cell_ids: list[str], side: float) -> str:
    """The cells as a WGS84 multipolygon, for display."""
    import math

    polygons = []
    for c in cell_ids:
        x, y = geo.hex_centre(*map(int, c.split(":")), side)
        corners = [geo.from_utm(x + side * math.sin(math.pi / 3 * i), y + side * math.cos(math.pi / 3 * i)) for i in range(6)]
        polygons.append("((" + ", ".join(f"{lon:.6f} {lat:.6f}" for lat, lon in [*corners, corners[0]]) + "))")
    return f"MULTIPOLYGON ({', '.join(polygons)})"
