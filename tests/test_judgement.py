import duckdb

from waywarden.plans import judgement


def test_json_params_keeps_every_event(spark, tmp_path):
    rows = [(0, '{"k": 4}', "view"), (1, '{"k": 7}', "click"), (2, '{"j": 1}', "error"), (3, None, "view"), (4, '{"k": null}', "signup"), (5, "no json", "view"), (6, '{"k": -2}', None)]
    spark.createDataFrame(rows, "event_id long, props string, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in judgement.json_params(spark, str(tmp_path)).collect()}
    assert got == {(0, 4, "view"), (1, 7, "click"), (2, None, "error"), (3, None, "view"), (4, None, "signup"), (5, None, "view"), (6, -2, None)}
    # the registered SQL still has the filter: its rows are those of an even k
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet') WHERE event_id <> 5")
        assert set(db.execute(judgement.ORACLES["json_params"]).fetchall()) == {r for r in got if r[0] != 5}
