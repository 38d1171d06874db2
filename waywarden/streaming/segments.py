"""Live track ids: a keyed state that cuts an asset's stream at silences and numbers its points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waywarden.params import Timing


class LiveSegments(StatefulProcessor):
    """State of an asset: its segment, the latest time so far, the next number. Points come in order of arrival."""

    def __init__(self, gap_s: float, fields: list[str]):
        self.gap_s, self.fields = gap_s, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("segment", "segment long, latest double, next long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        segment, latest, number = held if held else (-1, float("-inf"), 0)
        for pdf in rows:
            pdf = pdf.sort_values("arrival", kind="stable")
            ids, numbers = [], []
            for t in pdf["t"]:
                if segment < 0 or t - latest > self.gap_s:
                    segment, latest, number = segment + 1, t, 0
                latest = max(latest, t)
                ids.append(f"live:{key[0]}:{segment}")
                numbers.append(number)
                number += 1
            yield pdf.assign(track_id=ids, seq=numbers)[["track_id", "seq", *self.fields]]
        self.state.update((segment, float(latest), number))

    def close(self) -> None:
        pass


def live_segments(points: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """A stream of points (asset_id, t, arrival, ...) with track_id and seq. Needs the RocksDB state store.

    A late point belongs to the segment of its arrival, as in batch.
    """
    fields = points.columns
    schema = "track_id string, seq long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.groupBy("asset_id").transformWithStateInPandas(statefulProcessor=LiveSegments(timing.gap_s, fields), outputStructType=schema, outputMode="Append", timeMode="None")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
