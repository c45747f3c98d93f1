"""Live bars and alerts with Structured Streaming; batches come as files, one a micro-batch."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import floor_to
from ..sources.store import Store, latest
from . import stateful

BATCH_SCHEMA = "batch_id long, symbol string, agg_trade_id long, price decimal(18,8), quantity decimal(18,8), is_buyer_maker boolean, event_us long, arrival_us long"
#: As they lie in the folder: a closing row ends the tape of its symbol and is no trade.
FILE_SCHEMA = BATCH_SCHEMA + ", closing boolean"


def write_batches(batched: DataFrame, folder: str) -> int:
    """One Parquet file a batch, in batch order, for a file stream that takes one file a trigger."""
    columns = [c.split()[0] for c in BATCH_SCHEMA.split(", ")]
    ids = [r[0] for r in batched.select("batch_id").distinct().orderBy("batch_id").collect()]
    for k in ids:
        batched.where(F.col("batch_id") == k).select(*columns).coalesce(1).write.mode("append").parquet(folder)
    return len(ids)


def close_tape(batched: DataFrame, folder: str, lateness_s: float, up_us: int) -> None:
    """A last file with one closing row a symbol, late enough that the watermark passes every open bar of up_us."""
    ends = batched.groupBy("symbol").agg(F.max("event_us").alias("own")).crossJoin(F.broadcast(batched.agg((F.max("event_us") + round(lateness_s * 1e6) + up_us).alias("event_us"))))
    blank = {c.split()[0]: F.lit(None).cast(c.split(" ", 1)[1]) for c in FILE_SCHEMA.split(", ")}
    ends.select(*[{"symbol": F.col("symbol"), "event_us": F.col("event_us"), "arrival_us": F.col("event_us"), "closing": F.lit(True)}.get(c, v).alias(c) for c, v in blank.items()]).coalesce(1).write.mode("append").parquet(folder)


def first_bar(batched: DataFrame, up_us: int) -> int:
    """The bar of the earliest trade in the tape's first batch, before which no larger bar is given out."""
    return batched.agg(floor_to(F.min_by("event_us", F.struct("batch_id", "event_us")), up_us)).first()[0]


def trade_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(folder).withColumn("event_time", F.timestamp_micros("event_us"))


def stream_bars(trades: DataFrame, lateness_s: float = 10.0, step_s: int = 1) -> DataFrame:
    """Bars closed by the watermark, in append mode. For late rows to be dropped by the watermark that their own
    batch met, run with spark.sql.streaming.statefulOperator.allowMultiple=false."""
    sell = F.when(F.col("is_buyer_maker"), F.col("quantity")).otherwise(F.lit(0).cast("decimal(18,8)"))
    w = F.window("event_time", f"{step_s} seconds")
    g = trades.withWatermark("event_time", f"{int(lateness_s * 1000)} milliseconds").groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", "agg_trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "agg_trade_id").alias("close"),
        F.sum("quantity").cast("decimal(24,8)").alias("volume"), F.sum(sell).cast("decimal(24,8)").alias("sell_volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return g.select("symbol", F.unix_micros("w.start").alias("bar_us"), "open", "high", "low", "close", "volume", "sell_volume", "trade_count")


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> None:
    """Runs a stream over all files there are and appends the result to a memory table."""
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_to_store(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream whose batches go to a sink function, several tables in one if it likes."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()


def stream_alerts(conditions: DataFrame, clear_after_s: int = 60) -> DataFrame:
    """conditions: a stream of (symbol, rule, t_us, is_true). Emits (symbol, rule, fired_us) when an alert begins: a true
    step more than clear_after since the last true one. The state of a key is the time of its last true step."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        fired = []
        for t in sorted(t for f in frames for t in f.loc[f["is_true"], "t_us"]):
            if last is None or t - last > clear_after_s * 1_000_000:
                fired.append(int(t))
            last = int(t) if last is None else max(last, int(t))  # a batch may bring older steps than the state's
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"symbol": [key[0]] * len(fired), "rule": [key[1]] * len(fired), "fired_us": fired})

    return conditions.groupBy("symbol", "rule").applyInPandasWithState(step, "symbol string, rule string, fired_us long", "last long", "append", GroupStateTimeout.NoTimeout)


def flush_tape(store: Store, run_id: str, lateness_s: float, step_us: int, up_us: int) -> Callable[[DataFrame, int], None]:
    """A sink for stream_tape: each batch's bars and late trades to their tables, as the flush of that batch. A batch that
    comes again replaces its own flush, so the tables stay as they are. A symbol's end is a row of step 0 among the bars."""

    def write(rows: DataFrame, flush_id: int) -> None:
        rows = rows.persist()
        keyed = rows.withColumns({"run_id": F.lit(run_id), "lateness_s": F.lit(float(lateness_s)), "flush_id": F.lit(flush_id)})
        step = F.when(F.col("kind") == "bar", step_us // 1_000_000).when(F.col("kind") == "larger", up_us // 1_000_000).otherwise(0).alias("step_s")
        bars = [c for c in stateful.names(stateful.TAPE_OUT) if c not in ("kind", "agg_trade_id", "quantity", "event_us", "arrival_us", "watermark_us")]
        store.replace("live/bars", keyed.where("kind <> 'late'").select("run_id", "lateness_s", "flush_id", step, *bars))
        late = ["symbol", "agg_trade_id", "quantity", "event_us", "arrival_us", "watermark_us"]
        store.replace("live/late_trades", keyed.where("kind = 'late'").select("run_id", "lateness_s", "flush_id", *late))
        rows.unpersist()

    return write


def flush_rules(store: Store, run_id: str) -> Callable[[DataFrame, int], None]:
    """A sink for stream_incidents: the rows that a batch changed, each key once, in its last state of the batch. Tables are
    read by current(), which takes the latest flush of each key."""

    def write(rows: DataFrame, flush_id: int) -> None:
        rows = rows.withColumns({"run_id": F.lit(run_id), "flush_id": F.lit(flush_id), "at": F.monotonically_increasing_id()}).persist()
        for table, kind, keys in (("live/alerts", "alert", ALERT_KEY), ("live/incidents", "incident", INCIDENT_KEY)):
            own = rows.where(F.col("kind") == kind)
            last = own.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in own.columns if c not in keys]), "at").alias("row")).select(*keys, "row.*")
            store.replace(table, last.select(*[c for c in store.columns(table) if c in last.columns]))
        rows.unpersist()

    return write


ALERT_KEY, INCIDENT_KEY = ["run_id", "symbol", "rule", "fired_us"], ["run_id", "symbol", "opened_us"]


def current(store: Store, table: str, keys: list[str]) -> DataFrame:
    """The rows of a flushed table as of their latest flush."""
    return latest(store.read(table), keys, "flush_id").drop("flush_id")


def observed(trades: DataFrame, name: str = "tape") -> DataFrame:
    """trades, with counts that a RunListener reads from each batch's progress."""
    own = ~F.coalesce("closing", F.lit(False))
    return trades.observe(name, F.count_if(own).alias("events"), F.max(F.when(own, F.col("arrival_us"))).alias("sim_us"), F.count_if(~own).alias("closings"))


class RunListener(StreamingQueryListener):
    """Keeps a run's row up to date: events so far and the tape's clock at each beat, and how the run ended.

    write gets (status, events, sim_us, detail): "running" at most every beat_s seconds; at the end "completed" where the
    closing rows were seen, "failed" after an error, else "interrupted". A run that is started again from its checkpoint
    goes on from `events`.
    """

    def __init__(self, write: Callable[[str, int, int | None, str | None], None], name: str = "tape", beat_s: float = 5.0, events: int = 0):
        self.write, self.name, self.beat_s = write, name, beat_s
        self.events, self.sim_us, self.closed, self.beat, self.run = events, None, False, 0.0, None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        self.run = event.progress.runId
        self.events += seen["events"] or 0
        self.sim_us = max(filter(None, (self.sim_us, seen["sim_us"])), default=None)
        self.closed |= bool(seen["closings"])
        if time.monotonic() - self.beat >= self.beat_s:
            self.beat = time.monotonic()
            self.write("running", self.events, self.sim_us, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.run is None or event.runId != self.run:
            return
        status = "failed" if event.exception else "completed" if self.closed else "interrupted"
        self.write(status, self.events, self.sim_us, event.exception and str(event.exception)[-500:])
        self.ended.set()


class LiveRun:
    """Two running queries of one tape: its bars, and the rules over them. stop() ends both at a batch's border."""

    def __init__(self, spark: SparkSession, queries: list, listener: RunListener):
        self.spark, self.queries, self.listener = spark, queries, listener

    def wait(self, timeout_s: float | None = None) -> bool:
        """Whether the tape came to its end in time."""
        began = time.monotonic()
        while timeout_s is None or time.monotonic() - began < timeout_s:
            if self.listener.closed and not any(q.isActive and (q.status["isDataAvailable"] or q.status["isTriggerActive"]) for q in self.queries):
                return True
            if failed := next((q for q in self.queries if not q.isActive and q.exception()), None):
                raise failed.exception()
            time.sleep(0.2)
        return False

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self.listener.ended.wait(30)
        self.spark.streams.removeListener(self.listener)


def start_live(
    spark: SparkSession, store: Store, run_id: str, folder: str, checkpoint: str, conditions_of: Callable[[DataFrame], DataFrame], write_run: Callable[[str, int, int | None, str | None], None],
    first_up_us: int, lateness_s: float = 10.0, step_us: int = 1_000_000, up_us: int = 60_000_000, resolve_after_s: int = 900, lookback_s: int = 300, trigger_s: float = 1.0, beat_s: float = 5.0,
) -> LiveRun:
    """Follows a folder of trades: bars, larger bars and late trades to live/bars and live/late_trades, and from the bars, which
    the second query follows in turn, alerts and incidents to live/alerts and live/incidents.

    conditions_of makes the true conditions (see stream_incidents) from the stream of live/bars rows. Each query goes on from its
    own checkpoint when the run is started again; write_run is told of the run's state (see RunListener).
    """
    listener = RunListener(write_run, f"tape-{run_id}", beat_s)
    spark.streams.addListener(listener)
    trades = observed(trade_stream(spark, folder), listener.name)
    start = lambda stream, write, name: stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}").trigger(processingTime=f"{trigger_s} seconds").start()
    tape = stateful.stream_tape(trades, lateness_s, step_us, up_us, first_up_us)
    bars = start(tape, flush_tape(store, run_id, lateness_s, step_us, up_us), "bars")
    written = store.stream("live/bars", run_id=run_id, lateness_s=float(lateness_s))
    true = conditions_of(written.where(F.col("step_s") == step_us // 1_000_000))
    ends = written.where("step_s = 0").select("symbol", F.col("bar_us").alias("t_us"), F.lit("").alias("rule"), F.lit(-1).alias("place"), F.lit(True).alias("closing"))
    found = stateful.stream_incidents(true.unionByName(ends, allowMissingColumns=True), step_us, resolve_after_s, lookback_s)
    return LiveRun(spark, [bars, start(found, flush_rules(store, run_id), "rules")], listener)
