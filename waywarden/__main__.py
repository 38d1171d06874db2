"""Commands: python -m waywarden <ingest | features | verdicts | regional | scenes | demo | train | replay> ...

Each reads and writes Parquet (replay writes JSON lines), and prints a short profile.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="waywarden", description=__doc__.splitlines()[0])
    sub = parser.add_subparsers(dest="command", required=True)
    for name, takes in {"ingest": ("raw", "out", "source"), "features": ("points", "out"), "verdicts": ("features", "out"), "regional": ("points", "out"), "scenes": ("out",), "demo": ("out",), "train": ("points", "out"), "replay": ("verdicts", "out")}.items():
        p = sub.add_parser(name)
        for t in takes:
            p.add_argument(t)
        if name == "ingest":
            p.add_argument("--order", default="arrival", help="column of arrival order")
        if name == "scenes":
            p.add_argument("--seeds", type=int, default=8)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"waywarden-{a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()

    from waywarden.operators import fleet, segments, synth
    from waywarden.operators.verdict import contract
    from waywarden.plans import batch
    from waywarden.sources import readers, sinks

    def done(path: str, t: str) -> None:
        df = spark.read.parquet(path)
        print(json.dumps({k: v for k, v in sinks.profile(df, "track_id", t).head().asDict().items() if not k.startswith("null_") or v}, default=str))

    if a.command == "ingest":
        sinks.parquet(segments.validate(segments.from_flat(spark.read.parquet(a.raw), a.source, a.order)), a.out)
        done(a.out, "t")
    elif a.command == "features":
        sinks.parquet(batch.features(readers.points(spark, a.points)), a.out)
        done(a.out, "t_end")
    elif a.command == "verdicts":
        sinks.parquet(batch.verdicts(spark.read.parquet(a.features)), a.out)
        done(a.out, "t_end")
    elif a.command == "regional":
        sinks.parquet(fleet.regional(readers.points(spark, a.points)), a.out)
        spark.read.parquet(a.out).groupBy("level").count().show()
    elif a.command == "scenes":
        sinks.parquet(synth.scenes(spark, a.seeds), f"{a.out}/points")
        sinks.parquet(synth.events(spark, a.seeds), f"{a.out}/events")
        done(f"{a.out}/points", "t")
    elif a.command == "demo":
        points, told = synth.demo()
        faults = synth.demo_faults(points, told)
        sinks.parquet(spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in points.itertuples(index=False)], synth.POINTS), f"{a.out}/points")
        done(f"{a.out}/points", "t")
        print(json.dumps({"events": told, "faults": faults}, default=str))
    elif a.command == "train":
        from waywarden.operators import models

        rows = batch.labelled_windows(readers.points(spark, a.points))
        bundle = batch.train(rows, models.splits_for(spark, rows, f"{a.out}/splits"))
        for name in ("first", "second", "causes"):
            sinks.save_model(spark, getattr(bundle, name), f"{a.out}/{name}")
        sinks.parquet(bundle.baseline, f"{a.out}/baseline")
        told = json.dumps(batch.card(bundle), sort_keys=True)
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/card")
        print(told)
    else:
        print(json.dumps(sinks.replay(sinks.frames(contract(spark.read.parquet(a.verdicts))), None, a.out, "verdicts")))


if __name__ == "__main__":
    main()
