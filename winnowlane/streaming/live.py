"""Streams: sessions with late data, rankings that follow an op log, batches applied once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_sessions(events: DataFrame, when: str, by: list[str], gap_hours: float, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream: put out once the watermark has passed their end; later events are dropped."""
    gap = f"{int(gap_hours * 3600)} seconds"
    s = events.withWatermark(when, late).groupBy(*by, F.session_window(F.col(when), gap).alias("w"))
    return s.agg(F.min(when).alias("started"), F.max(when).alias("ended"), F.count("*").alias("n")).drop("w")


def live_counts(events: DataFrame, when: str, by: list[str], width: str, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows of a stream."""
    w = events.withWatermark(when, late).groupBy(*by, F.window(F.col(when), width).alias("w")).agg(F.count("*").alias("n"))
    return w.select(*by, F.col("w.start").alias("window_start"), "n")


def live_ranking(ops: DataFrame, pools: dict[str, list[str]], target: int, seed: int) -> DataFrame:
    """A row of state a unit after each batch of its op log (unit, seq, type, mid, winner; text).

    The state is the log as far as it fits; every batch replays it, so a restart gives the same ranking.
    ``pools`` gives the few fields being ranked by hand.
    """
    from winnowlane.operators.ranking import replay

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(zip(*state.get)) if state.exists else []
        new = pd.concat(list(batches)).sort_values("seq")
        seen = {x[0] for x in log}
        log += [(int(x.seq), x.type, x.mid or "", x.winner or "") for x in new.itertuples() if int(x.seq) not in seen]
        log.sort()
        state.update(tuple(list(c) for c in zip(*log)))
        r = replay(pools.get(key[0], []), target, seed, [{"t": t, "m": m or None, "w": w or None} for _, t, m, w in log])
        yield pd.DataFrame({"unit": [key[0]], "comparisons": [r.asked], "places": [list(r.places)], "pending": [r.pending[0] if r.pending else None], "broke": [r.broke]})

    out = "unit string, comparisons long, places array<string>, pending string, broke string"
    kept = "seqs array<long>, types array<string>, mids array<string>, winners array<string>"
    return ops.groupBy("unit").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def snapshots(frame: DataFrame, store, name: str, checkpoint: str, seconds: float | None = 0.4):
    """Write each micro-batch of a stream to a keyed store; a batch written twice gives the same table. Without ``seconds`` it ends with what is there."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{int(seconds * 1000)} milliseconds"}
    return frame.writeStream.foreachBatch(lambda batch, _: store.put(name, batch)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def upserts(frame: DataFrame, table, writer: str, checkpoint: str, seconds: float | None = 0.4):
    """Put each micro-batch of a stream into a DeltaTable under its own number, so one that is delivered twice counts once. A new checkpoint asks for a new writer."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{int(seconds * 1000)} milliseconds"}
    return frame.writeStream.foreachBatch(lambda batch, number: table.put(batch, writer, number) and None).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def action_log(stream_folder: str, spark) -> DataFrame:
    """A stream of named actions (t in milliseconds, a) appended as Parquet files."""
    return spark.readStream.schema("t long, a string").parquet(stream_folder)


class Watch(StreamingQueryListener):
    """Calls subscribers with (event, name, rows) as streams start, go on and end; one that fails harms neither streams nor the others."""

    def __init__(self):
        self.subscribers: list = []

    def subscribe(self, call):
        """Adds a subscriber; what is returned takes it away again."""
        self.subscribers.append(call)
        return lambda: self.subscribers.remove(call) if call in self.subscribers else None

    def _tell(self, event: str, name, rows: int) -> None:
        for call in list(self.subscribers):
            try:
                call(event, name, rows)
            except Exception:  # a subscriber's own fault
                continue

    def onQueryStarted(self, event) -> None:
        self._tell("started", event.name, 0)

    def onQueryProgress(self, event) -> None:
        self._tell("progress", event.progress.name, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._tell("idle", None, 0)

    def onQueryTerminated(self, event) -> None:
        self._tell("ended", None, 0)
