import gzip
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0
from waywarden.operators import segments
from waywarden.sources import live, readers, sinks

FLAT = readers.FLAT_SCHEMA + ", n long"


def flat(n=40, dt=1.0, icao="ABC123", **columns):
    base = {"on_ground": False, "alt_m": 1000.0, "speed_mps": 80.0, "track_deg": 90.0, "vrate_mps": 0.0, "nic": 8.0, "nac_p": 9.0, "sil": 3.0, "callsign": " AZA1 ", "type": "B738"}
    return [{"icao24": icao, "ts": T0 + dt * i, "lat": 41.8, "lon": 12.25, "n": i} | base | columns for i in range(n)]


def run(spark, rows, **more):
    names = [c.split()[0] for c in FLAT.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], FLAT)
    out = segments.from_flat(df, "fco", "n", **more)
    return out.orderBy("track_id", "seq").toPandas()


def test_gap_splits_above_300_s_only(spark):
    a, b = flat(), flat()
    for r in a[20:]:
        r["ts"] += 300
    for r in b[20:]:
        r["ts"] += 299
    p = run(spark, a)
    assert p.track_id.nunique() == 2 and (p.groupby("track_id").seq.min() == 0).all()
    assert run(spark, b).track_id.nunique() == 1


def test_arrival_order_and_duplicates_stay(spark):
    rows = flat()
    rows[5]["ts"], rows[6]["ts"] = rows[6]["ts"], rows[5]["ts"]
    rows.append({**rows[-1], "n": 40})
    p = run(spark, rows)
    assert len(p) == 41 and p.seq.tolist() == list(range(41)) and p.track_id.nunique() == 1 and p.t[5] > p.t[6]


def test_box_comes_before_the_split(spark):
    rows = flat(n=100, dt=10.0)
    for r in rows[30:60]:
        r["lat"] = 50.0
    p = run(spark, rows, box=(41.53, 11.89, 42.07, 12.61))
    assert len(p) == 70 and p.track_id.nunique() == 2


def test_missing_values_drop_the_row_or_the_value(spark):
    rows = flat()
    rows[3]["lat"], rows[4]["ts"] = None, None
    rows[5]["alt_m"], rows[6]["track_deg"], rows[7]["track_deg"] = 31_821.0, 360.0, 365.0
    p = run(spark, rows)
    assert len(p) == 38
    assert p.alt_baro_m.isna().sum() == 1 and set(p.track_deg) == {90.0, 0.0, 5.0} and p.callsign[0] == "AZA1" and p.asset_id[0] == "abc123"


def test_values_are_carried_forward_only(spark):
    rows = flat(nac_p=None)
    rows[2]["nac_p"] = 9.0
    for r in rows[20:]:
        r["ts"] += 400
    p = run(spark, rows)
    assert p.nacp[:2].isna().all() and (p.nacp[2:20] == 9).all() and p.nacp[20:].isna().all()


def test_tri_state_ground(spark):
    rows = flat(n=3, alt_m=None)
    rows[0]["on_ground"], rows[2]["alt_m"] = True, 10.0
    assert run(spark, rows).on_ground.tolist() == [True, None, False]


def test_types_and_overrides(spark):
    types = spark.createDataFrame([("A320", "narrowbody"), ("DA42", "light")], "typecode string, size_class string")
    over = spark.createDataFrame([("abc123", "A320")], "icao24 string, typecode string")
    p = run(spark, flat(n=1, type="DA42") + flat(n=1, type=None, icao="ffffff"), types=types, overrides=over)
    assert p.asset_class.tolist() == ["narrowbody", "other"] and p.type_overridden.tolist() == [True, False] and p.typecode_raw[0] == "DA42"


def test_validate(spark):
    good = segments.from_flat(spark.createDataFrame([tuple(flat(1)[0][c.split()[0]] for c in FLAT.split(", "))], FLAT), "fco", "n")
    assert segments.validate(good).count() == 1
    for bad in (good.withColumn("t", F.col("t") * 1000), good.unionByName(good), good.withColumn("alt_baro_m", F.lit(30_000.0))):
        with pytest.raises(segments.SchemaError):
            segments.validate(bad)
    with pytest.raises(segments.SchemaError):
        segments.validate(good.drop("lat"))


def test_trace_files(spark, tmp_path):
    doc = {"icao": "abc", "t": "B738", "timestamp": T0, "trace": [[0, 41.8, 12.2, "ground", 10, 90, 0, 0, {"nic": 8, "nac_p": 9, "sil": 3, "flight": "AZA1 "}], [5.5, 41.9, 12.3, 1000, 100, 91, 0, 600, None], [6, 55.0, 12.3, 1000, 100, 91, 0, 600, None]]}
    (tmp_path / "a" / "b").mkdir(parents=True)
    with gzip.open(tmp_path / "a" / "b" / "x.json.gz", "wt") as f:
        json.dump(doc, f)
    t = readers.traces(spark, str(tmp_path), (41.5, 11.9, 42.1, 12.6)).orderBy("place").toPandas()
    assert len(t) == 2 and t.on_ground.tolist() == [True, False] and t.ts[1] == T0 + 5.5 and abs(t.alt_m[1] - 304.8) < 1e-6 and abs(t.speed_mps[1] - 51.4444) < 1e-3 and t.callsign[0] == "AZA1"


def test_geofences_and_graph(spark, tmp_path):
    ring = [[12.24, 41.80], [12.25, 41.80], [12.25, 41.81], [12.24, 41.81], [12.24, 41.80]]
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"zone_id": "z", "zone_class": "apron", "allowed_groups": "b, a", "speed_limit_kmh": "36"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    (tmp_path / "g.json").write_text(json.dumps(fc))
    twice = {"type": "Feature", "properties": {"zone_id": "y", "zone_class": "taxi_corridor", "allowed_groups": "all"}, "geometry": {"type": "Polygon", "coordinates": [[ring[0], ring[0], *ring[1:4]]]}}
    thin = {"type": "Feature", "properties": {"zone_id": "x", "zone_class": "apron"}, "geometry": {"type": "Polygon", "coordinates": [[ring[0], ring[1], ring[1]]]}}
    edge = {"type": "Feature", "properties": {"zone_class": "aerodrome_boundary"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    (tmp_path / "h.json").write_text(json.dumps(fc | {"features": fc["features"] + [twice, thin, edge]}))
    found, boundary = readers.geofences(spark, str(tmp_path / "h.json"), ["tug", "bus"])
    got = {r["zone_id"]: r for r in found.collect()}
    assert set(got) == {"z", "y"} and got["y"]["allowed_groups"] == ["bus", "tug"] and len(got["y"]["ring"]) == 5 and boundary.count() == 1
    assert abs(got["y"]["area"] - got["z"]["area"]) < 1
    (tmp_path / "i.json").write_text(json.dumps(fc | {"features": [edge | {"properties": {"zone_class": "moat"}}]}))
    with pytest.raises(ValueError, match="moat"):
        readers.geofences(spark, str(tmp_path / "i.json"))
    z = readers.geofences(spark, str(tmp_path / "g.json"))[0].head()
    assert z["allowed_groups"] == ["a", "b"] and abs(z["speed_limit_mps"] - 10) < 1e-9 and len(z["ring"]) == 5 and 900_000 < z["area"] < 940_000
    xml = """<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="lat"/><key id="d1" for="node" attr.name="lon"/><key id="d2" for="edge" attr.name="domain"/><graph>
    <node id="1"><data key="d0">41.80</data><data key="d1">12.24</data></node><node id="2"><data key="d0">41.80</data><data key="d1">12.25</data></node><node id="3"><data key="d0">41.81</data><data key="d1">12.25</data></node>
    <edge source="1" target="2"><data key="d2">vehicle</data></edge><edge source="2" target="3"><data key="d2">vehicle</data></edge><edge source="1" target="3"><data key="d2">aircraft</data></edge></graph></graphml>"""
    nodes, edges = readers.graph(xml)
    assert readers.routes(spark, xml).count() == 3 and readers.shortest_path(nodes, edges, "1", "3", "vehicle") == ["1", "2", "3"] and readers.shortest_path(nodes, edges, "1", "3") == ["1", "3"] and readers.shortest_path(nodes, edges[:1], "1", "3") == []


def test_archive_members(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with tarfile.open(tmp_path / "r.tar", "w") as t:
        t.add(tmp_path / "x.csv", "data/x.csv")
    m = readers.members(spark, str(tmp_path / "r.tar"), "x.csv").head()
    assert m["name"] == "data/x.csv" and bytes(m["content"]) == b"a,b\n1,2\n"


def test_live_messages_reject_points_not_batches(spark):
    good = {"asset_id": "a", "t": T0, "lat": 41.8, "lon": 12.2, "domain": "vehicle", "asset_class": "bus", "track_deg": 360.0}
    body = [good, good | {"lat": 95}, good | {"x": 1}, good | {"t": T0 * 1000}, good | {"asset_class": "widebody"}, {k: v for k, v in good.items() if k != "asset_class"}, good | {"t": T0 + 500}]
    df = spark.createDataFrame([(json.dumps(body),)], "value string")
    ok, bad = live.sink_frame(live.accept(live.parse(df), reference_t=F.lit(float(T0))))
    ok = ok.orderBy("place").collect()
    assert [r["place"] for r in ok] == [0, 5] and ok[0]["track_deg"] == 0.0 and ok[1]["asset_class"] == "follow_me"
    assert {r["place"]: r["rejected"] for r in bad.collect()} == {1: "no position", 2: "unknown fields: x", 3: "t is not in UNIX seconds", 4: "asset_class of the other domain", 6: "too far ahead of its batch"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 0.123456789), ("a", 2.0, None), ("b", 1.0, 5.0)], "track_id string, t_end double, v double")
    sinks.csv(df, str(tmp_path / "c"))
    assert sorted(r["v"] or "" for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["", "0.123457", "5.00000"]
    assert sinks.latest(df).filter("track_id = 'a'").head()["t_end"] == 2.0
    assert [r["t_end"] for r in sinks.history(df, "a", 0.5).collect()] == [2.0]
    p = sinks.profile(df, "track_id", "t_end").head()
    assert p["rows"] == 3 and p["tracks"] == 2 and abs(p["null_v"] - 1 / 3) < 1e-9
    v = df.selectExpr("t_end AS t", "track_id", "named_struct('v', v, 'id', track_id) AS verdict")
    m = sinks.replay(sinks.frames(v), None, str(tmp_path / "r"), "demo")
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "r/frames")).collect()]
    assert m["n_frames"] == 2 and sorted(len(x["verdicts"]) for x in lines) == [1, 2] and "v" not in [x for x in lines if x["t"] == 2.0][0]["verdicts"][0]


def test_model_round_trip(spark, tmp_path):
    from waywarden.operators.models import Linear

    m = Linear(["kin_speed_resid_max"], ["y"], {"kin_speed_resid_max": 1.0}, {"kin_speed_resid_max": 2.0}, [{"kin_speed_resid_max": 0.5}], [0.1], 1.5, [(0.0, 0.0), (1.0, 1.0)])
    sinks.save_model(spark, m, str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m")) == m


def test_release_is_fetched_unpacked_and_gated(spark, tmp_path):
    import io
    import tarfile

    from waywarden.sources import release

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for i in range(3):
            data = b"x" * (i + 1) * 1000
            info = tarfile.TarInfo(f"traces/{i}.json")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    whole, failed = raw.getvalue(), []
    cut = {"r.tar.aa": whole[:100], "r.tar.ab": whole[100:]}

    def get(name):
        if name == "r.tar.ab" and not failed:
            failed.append(name)
            raise OSError("lost")
        return io.BytesIO(cut[name])

    parts = release.fetch(sorted(cut), str(tmp_path), get)
    assert release.unpack(parts, str(tmp_path)) == 3 and (tmp_path / "traces/2.json").stat().st_size == 3000 and failed
    assert release.fetch(sorted(cut), str(tmp_path), lambda name: 1 / 0) == parts
    with pytest.raises(release.GateError):
        release.unpack(parts, str(tmp_path), spare=1e15)
    df = spark.range(10)
    assert release.row_gate(df, 10, 10) == 10
    for bounds in ((11, None), (0, 9)):
        with pytest.raises(release.GateError):
            release.row_gate(df, *bounds)


def test_order_is_restored(spark):
    df = spark.createDataFrame([((i * 37) % 101, f"t{i % 5}") for i in range(101)], "v long, track_id string").coalesce(3)
    want = [r["v"] for r in df.collect()]
    back = segments.restored(segments.with_order(df).repartition(4, "track_id"))
    assert [r["v"] for r in back.collect()] == want and back.columns == df.columns


def test_runways_fall_back_by_designators():
    rows = [("16R/34L", 1)]
    assert readers.runways_or(rows, [("34L/16R", 2), ("7/25", 3), ("", 4), ("07/25", 5)]) == [("16R/34L", 1), ("7/25", 3), ("07/25", 5)]
