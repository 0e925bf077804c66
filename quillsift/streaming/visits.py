"""Streaming twins: visit pairs under a watermark, rate-limited analysis, live queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillsift.functions.scalars import percent_change


def events_stream(spark, path: str, schema: str) -> DataFrame:
    """Event files as a stream; times are read as instants in the session's zone."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value per window and type; late rows count up to the watermark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def visit_changes(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Change of each event against the one before it of its user and type.

    State is one row a key.  Rows of a batch are put in order; an event older than
    the last one seen of its key has no successor to compare and is passed over.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for e, t, v in zip(rows.event_id, rows.ts, rows.value):
            ms = int(t.timestamp() * 1000)
            if last is not None and (ms, e) > (last[0], last[1]):
                out.append((key[0], key[1], int(last[1]), int(e), float(last[2]), float(v)))
            if last is None or (ms, e) > (last[0], last[1]):
                last = (ms, int(e), float(v))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["user_id", "event_type", "older_event_id", "newer_event_id", "older_value", "newer_value"])

    d = stream.withWatermark("ts", late).groupBy("user_id", "event_type").applyInPandasWithState(
        run, "user_id long, event_type string, older_event_id long, newer_event_id long, older_value double, newer_value double", "ms long, event_id long, value double", "append", GroupStateTimeout.NoTimeout
    )
    return d.withColumn("change_pct", percent_change("older_value", "newer_value"))


def rate_limited(frames: DataFrame, key: str = "camera", gap_ms: int = 500, busy: str = "took_ms") -> DataFrame:
    """Frames that an analyser takes: ``gap_ms`` after the last run ended and none under way; others are dropped, never queued.

    frames: a stream of key, at_ms, took_ms; state is one row a key.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, taken, dropped = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values("at_ms")
        out = []
        for at, took in zip(rows.at_ms, rows[busy]):
            if free is None or at >= free:
                free, taken = int(at + took + gap_ms), taken + 1
                out.append((k[0], int(at), taken, dropped))
            else:
                dropped += 1
        state.update((free, taken, dropped))
        yield pd.DataFrame(out, columns=[key, "at_ms", "n_taken", "n_dropped"])

    kind = dict(frames.dtypes)[key]
    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at_ms long, n_taken long, n_dropped long", "free_ms long, taken long, dropped long", "append", GroupStateTimeout.NoTimeout)


def on_change(stream: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``emit`` on every micro-batch: a live query."""
    return stream.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).start()
