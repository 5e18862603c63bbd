"""Frames as streams: sessions by silence, and buffers that give a range of frames once it is complete."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "range_no long, n_frames long, total double"
STATE = "seen long, buffered array<double>"


def sessions(events: DataFrame, by: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """by, start, end, n: stretches of events no more than `gap` apart. On a stream, `late` is the watermark's delay."""
    df = events.withWatermark(ts, late) if late else events
    grouped = df.groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def buffered(frames: DataFrame, by: str, value: str, size: int, order: str = "event_id", last: str | None = None) -> DataFrame:
    """by, range_no, n_frames, total: each `size` frames of a recording, by `order` within what comes at once, once the last of them has come.

    frames: a stream. last: a boolean column that is true for a recording's final frame; with it, what is left then comes as a
    shorter range and the recording's state is given up. State holds what is not complete yet: fewer than `size` values a recording."""
    kind = frames.schema[by].dataType.simpleString()

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, [])
        held = list(held)
        came = pd.concat(list(batches)).sort_values("tw_order", kind="stable")
        held += came["tw_value"].tolist()
        ended = bool(came["tw_last"].any())
        out = []
        while len(held) >= size or ended and held:
            out.append((key[0], seen, len(held[:size]), float(sum(held[:size]))))
            held, seen = held[size:], seen + 1
        if ended:
            state.remove()
        else:
            state.update((seen, held))
        if out:
            yield pd.DataFrame(out, columns=[by, "range_no", "n_frames", "total"])

    end = F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)
    rows = frames.select(by, F.col(value).cast("double").alias("tw_value"), F.col(order).alias("tw_order"), end.alias("tw_last"))
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {OUT}", STATE, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that its source holds now: it is run until then and its table read back."""
    base = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def shortage(expected: DataFrame, got: DataFrame, by: str) -> DataFrame:
    """by, expected, got, missing of recordings of which fewer frames came than were expected."""
    joined = expected.join(got, by, "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return joined.filter("got < expected").withColumn("missing", F.col("expected") - F.col("got"))
