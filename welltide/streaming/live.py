"""Live versions of the batch operators: a landing folder of time rows, windows, alerts, sessions and held flags."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

c = F.col
LATE = "10 minutes"


def read_landing(spark: SparkSession, folder: str, files_per_trigger: int = 1000, late: str = LATE) -> DataFrame:
    """Time rows ``well \\t timestamp \\t id=value,...`` as samples, as they land. Late rows past the watermark drop out."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    p = F.split("value", "\t")
    d = raw.select(F.get(p, 0).alias("well_id"), F.try_to_timestamp(F.get(p, 1)).alias("ts"), F.explode(F.split(F.get(p, 2), ",")).alias("_t"))
    d = d.where(c("ts").isNotNull() & F.contains("_t", F.lit("=")))
    return d.select("well_id", "ts", F.trim(F.substring_index("_t", "=", 1)).alias("wits_id"), F.expr("try_cast(trim(substr(_t, instr(_t, '=') + 1)) AS DOUBLE)").alias("value")) \
        .withWatermark("ts", late)


def windowed_stats(samples: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Channel statistics per tumbling (or sliding) time window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return samples.groupBy("well_id", "wits_id", w.alias("w")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")) \
        .select("well_id", "wits_id", c("w.start").alias("start"), c("w.end").alias("end"), "n", "mean", "lo", "hi")


def range_alerts(samples: DataFrame, profiles: DataFrame, margin: float = 0.1) -> DataFrame:
    """Samples outside their channel's informative range by more than a tenth of it (static profile table)."""
    j = samples.join(profiles, ["well_id", "wits_id"])
    span = c("hi") - c("lo")
    return j.where(c("informative") & (span > 0) & ((c("value") < c("lo") - span * margin) | (c("value") > c("hi") + span * margin))) \
        .select("well_id", "wits_id", "ts", "value", "lo", "hi")


def sessions(samples: DataFrame, gap: str = "30 minutes", keys: Sequence[str] = ("well_id", "wits_id")) -> DataFrame:
    """Stretches of activity per key (well and channel, well and state), closed after ``gap`` without a sample."""
    return samples.groupBy(*keys, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")) \
        .select(*keys, c("s.start").alias("start"), c("s.end").alias("end"), "n")


def flip_after(up: np.ndarray, held: bool | None, run: int, n: int) -> tuple[np.ndarray, bool, int]:
    """Held flag at each sample, and at the end with the number of opposite samples since. ``held`` and ``run``: what came before."""
    first = bool(up[0]) if held is None else held
    x = np.concatenate([np.full(run if held is not None else 0, not first), up.astype(bool)])
    start = np.concatenate([[True], x[1:] != x[:-1]])
    at = np.arange(len(x))
    length = at - np.maximum.accumulate(np.where(start, at, 0)) + 1
    sure = np.maximum.accumulate(np.where(length >= n - 1, at, -1))
    out = np.where(sure >= 0, x[np.maximum(sure, 0)], first)
    return out[len(x) - len(up):], bool(out[-1]), 0 if x[-1] == out[-1] else int(length[-1])


def held_flags(samples: DataFrame, threshold: float, n: int, idle: str = "365 days") -> DataFrame:
    """The hysteresis of the batch job on a stream: a flag flips after ``n - 1`` samples of the new value.

    State per (well, channel): the held flag and how long the opposite has lasted; it goes once the watermark is ``idle``
    past the last sample. Rows of one micro-batch are taken in time order, so the files of a trigger bound the group; a
    row that arrives after a later one has been handled counts from then on.
    """
    keep_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        g = pd.concat([x[["ts", "value"]] for x in batches]).sort_values("ts", kind="stable")
        held, run = state.get if state.exists else (None, 0)
        flags, last, run = flip_after((g["value"] >= threshold).to_numpy(), held, run, n)
        state.update((last, run))
        state.setTimeoutTimestamp(max(int(g["ts"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame({"well_id": key[0], "wits_id": key[1], "ts": g["ts"].to_numpy(), "held": flags})

    return samples.where("value is not null").groupBy("well_id", "wits_id").applyInPandasWithState(
        step, "well_id string, wits_id string, ts timestamp, held boolean", "held boolean, run int", "append", GroupStateTimeout.EventTimeTimeout)


class HeldFlag(StatefulProcessor):
    """Held flag of one (well, channel) over buckets of event time that come once they are complete, those of one watermark in any order.

    ``last`` is the end of the last bucket (0: none yet). A bucket that ends more than ``idle_ms`` after it begins anew; the flag goes once the
    watermark has passed that. State is read and written once for all buckets of a key, as each access is a call from Python.
    """

    def __init__(self, threshold: float, n: int, idle_ms: int):
        self.threshold, self.n, self.idle_ms = threshold, n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flag = handle.getValueState("flag", "held boolean, run int, last long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.flag.update((bool(r.held), int(r.run), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values("end", kind="stable")
        held, run, last = self.flag.get() or (None, 0, 0)
        at, values, flags = f["at"].tolist(), f["value"].tolist(), []
        for end, v in zip(f["end"].tolist(), values, strict=True):
            if last and end > last + self.idle_ms:
                held, run = None, 0
            out, held, run = flip_after(np.asarray(v) >= self.threshold, held, run, self.n)
            flags.append(out)
            last = end
        self.flag.update((held, run, last))
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame({"well_id": key[0], "wits_id": key[1], "ts": np.concatenate(at).astype("datetime64[us]"),
                            "value": np.concatenate(values), "held": np.concatenate(flags)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        flag = self.flag.get()
        if flag and flag[2] + self.idle_ms == expiredTimerInfo.getExpiryTimeInMs():
            self.flag.clear()
        return iter([])


def held_flags_in_order(samples: DataFrame, threshold: float, n: int, before: DataFrame | None = None, bucket: str = "1 hour", idle: str = "365 days") -> DataFrame:
    """The batch job's hysteresis on samples that land out of order: equal to it for every sample the watermark lets in.

    Samples wait in buckets of event time, one row of a windowed aggregation per (well, channel, bucket), which come out once the watermark has
    passed them; then each key's flag goes on over its buckets. Samples of one instant count in order of value. Memory holds what one key hands
    on between two watermarks. ``before`` (well_id, wits_id, held, run) goes on from what a batch job ended with. The query needs the RocksDB
    state store (``rocks``).
    """
    width, rest = (int(pd.Timedelta(t).total_seconds() * 1000) for t in (bucket, idle))
    d = samples.where("value is not null").groupBy("well_id", "wits_id", F.window("ts", bucket).alias("w")).agg(
        F.sort_array(F.collect_list(F.struct(F.unix_micros("ts").alias("at"), "value"))).alias("s"))
    d = d.select("well_id", "wits_id", F.unix_millis("w.end").alias("end"), c("s.at").alias("at"), c("s.value").alias("value"))
    return d.groupBy("well_id", "wits_id").transformWithStateInPandas(
        HeldFlag(threshold, n, -(-rest // width) * width), "well_id string, wits_id string, ts timestamp, value double, held boolean", "Append", "EventTime",
        None if before is None else before.groupBy("well_id", "wits_id"))


def companion_rows(depth: DataFrame, time: DataFrame, depth_wits: str = "0108") -> DataFrame:
    """The batch job's companion merge on two streams: depth samples as they land, time samples with the hole depth of their instant.

    ``time`` (ip, wits_id, ts, value, pos) has a watermark. The last hole depth written at an instant is settled, and joined to the samples of
    that instant (none: no depth), once the watermark has passed it; then the state of the instant goes. A stream-stream join on (ip, ts) holds what
    the watermark's delay spans, and one recorder's samples spread over the partitions by instant. Samples without a time come out with no depth
    at once. ``depth`` (ip, wits_id, ts, depth, value) passes through without a watermark of its own, so it holds nothing back.
    """
    at = time.where((c("wits_id") == depth_wits) & c("ts").isNotNull()).groupBy("ip", "ts").agg(F.max_by("value", "pos").alias("depth")) \
        .select(c("ip").alias("_ip"), c("ts").alias("_ts"), "depth")
    timed = time.where("ts is not null").join(at, (c("ip") == c("_ip")) & (c("ts") == c("_ts")), "left")
    own = ["ip", "wits_id", "ts", "depth", "value"]
    loose = time.where("ts is null").withColumn("depth", F.lit(None).cast("double"))
    late = timed.select(*own).unionByName(loose.select(*own)).withColumn("origin", F.lit("time"))
    return late.unionByName(depth.select(*own).withColumn("origin", F.lit("depth")))


def rocks(spark: SparkSession) -> None:
    """Keep the state of queries started from now on in RocksDB, on disk, which state of several kinds needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has landed, into a parquet table, and stop."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda d, _: d.write.mode("overwrite").parquet(table)).option("checkpointLocation", checkpoint) \
            .outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
