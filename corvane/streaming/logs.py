"""Append-only logs as streams: spending by stage, alarms with hysteresis, work that resumes where it stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

USAGE = "ts double, stage string, role string, model string, input long, output long, cost double, cached boolean, batch string"


def usage_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(USAGE).json(path)


def spending(usage: DataFrame) -> DataFrame:
    """stage (up to its first ':'), role, batch, calls, input, output, cost of what was not cached; on a stream, in complete or update mode."""
    rows = usage.where(~F.coalesce(F.col("cached"), F.lit(False)))
    stage = F.substring_index("stage", ":", 1)
    return rows.groupBy(stage.alias("stage"), "role", F.col("batch").isNotNull().alias("batch")).agg(F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cost").alias("cost"))


def windowed_spending(usage: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Cost per window of event time and role; windows close when the watermark has passed them."""
    rows = usage.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), "role").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("calls")).select(F.col("w.start").alias("start"), "role", "cost", "calls")


ALARM = "device string, time timestamp, value double, state string"


def alarms(readings: DataFrame, high: float = 84.0, low: float = 75.0, times: int = 4) -> DataFrame:
    """PAUSE at the `times`-th reading in a row of `high` or more, RESUME at the first below `low` after that. readings: device, time, value (a stream).

    Readings of a micro-batch are taken in order of time. One that is older than the last reading of its device in an earlier batch comes
    too late: the run it belonged to has been judged, so it changes nothing.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, paused, last = state.get if state.exists else (0, False, None)
        rows = pd.concat(list(batches)).sort_values("time", kind="stable")
        out = []
        for r in rows.itertuples():
            if last is not None and r.time.value < last:
                continue
            run, paused, event = next_state(run, paused, r.value, high, low, times)
            if event:
                out.append((key[0], r.time, r.value, event))
        newest = int(rows["time"].max().value)
        state.update((run, paused, newest if last is None else max(last, newest)))
        yield pd.DataFrame(out, columns=["device", "time", "value", "state"])

    return readings.groupBy("device").applyInPandasWithState(step, ALARM, "run int, paused boolean, last long", "append", GroupStateTimeout.NoTimeout)


def next_state(run: int, paused: bool, value: float, high: float, low: float, times: int) -> tuple[int, bool, str | None]:
    run = run + 1 if value >= high else 0
    if not paused and run >= times:
        return run, True, "PAUSE"
    if paused and value < low:
        return 0, False, "RESUME"
    return run, paused, None


def alarm_history(readings: DataFrame, key: str, time: str, value: str, high: float, low: float, times: int) -> DataFrame:
    """The same events in a batch, by windows: candidates for PAUSE and RESUME, of which each that differs from the one before counts."""
    w = Window.partitionBy(key).orderBy(time)
    below = F.sum((F.col(value) < high).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = readings.withColumn("_island", below)
    within = Window.partitionBy(key, "_island").orderBy(time)
    rows = rows.withColumn("_run", F.sum((F.col(value) >= high).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    event = F.when((F.col(value) >= high) & (F.col("_run") >= times), "PAUSE").when(F.col(value) < low, "RESUME")
    rows = rows.withColumn("state", event).where("state is not null")
    before = F.lag("state", 1, "RESUME").over(w)
    return rows.withColumn("_before", before).where("state <> _before").select(key, time, value, "state")


def change_points(series: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows at which the value differs from the one before; each key's first row is one."""
    w = Window.partitionBy(key).orderBy(time)
    before = F.lag(value).over(w)
    return series.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(value))).drop("_b")


def remaining(work: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """What is still to be done: exactly once per key, over any number of runs."""
    return work.join(done, key, "left_anti")


def process_new(stream: DataFrame, sink: str, checkpoint: str, key: list[str], time: str | None = None, late: str = "1 day") -> None:
    """Append the rows of a stream to a Parquet sink, each key once; available rows only, resumable by its checkpoint.

    Keys seen before are held by the stream's state, those of the last `late` only where `time` names an event time. A micro-batch goes into a
    folder of its own number, which a repeated batch writes anew: the sink is never read.
    """
    once = stream.dropDuplicates(key) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_buffered(stream: DataFrame, sink: str, checkpoint: str, every: str | None = None) -> None:
    """Append the rows of a stream as JSON lines: a buffer is a micro-batch (`every`, e.g. 60 seconds; None: what is there now), durable when its number is committed."""
    writer = stream.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint)
    (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start().awaitTermination()
