"""Structured Streaming jobs (STR1-STR7).

Every job is a function from a streaming DataFrame to a streaming DataFrame or a started query; sinks and
checkpoints live under a folder the caller gives (by default the shared folder of the session).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.classify import emergency_message, emergency_rule, emergency_severity
from ..functions.text import text_hash
from ..lexicon import MEDICAL, Profile
from ..operators.logs import error_burst
from ..operators.monitoring import ACCURACY_DROP, BASE_ROWS
from ..operators.staging import compute, keep
from ..plans.answer import valid_requests
from ..schema import PREDICTION_LOG
from ..session import new_path


def read_prediction_log(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """STR1: follow daily JSON-lines files; malformed lines are skipped."""
    reader = spark.readStream.schema(PREDICTION_LOG).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def tumbling_metrics(
    log: DataFrame, accuracy: Column, latency: Column, error: Column, ts: str = "ts", length: str = "1 day",
    slide: str | None = None, delay: str = "1 day", groups: tuple[str, ...] = (),
) -> DataFrame:
    """STR2: rows, accuracy, latency and error rate per time window; the same code serves batch and stream."""
    if log.isStreaming:
        log = log.withWatermark(ts, delay)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        log.groupBy(w.alias("w"), *groups)
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.avg(accuracy.cast("double")).alias("accuracy"),
            F.avg(latency).alias("avg_latency_ms"),
            F.avg(error.cast("double")).alias("error_rate"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *groups,
                "n_samples", "accuracy", "avg_latency_ms", "error_rate")
    )


def start_alerts(
    log: DataFrame, folder: str, ts: str = "timestamp", tie: str = "event_id", accuracy: str = "accuracy",
    model: str = "model", n: int = BASE_ROWS, limit: float = ACCURACY_DROP, trigger: dict | None = None,
):
    """STR3: after every micro-batch compare the first ``n`` with the last ``n`` rows and write alerts.

    State after batch i is a folder with at most 2n rows plus the row count; it is derived from the state
    before and the batch, and rewritten whole when a batch is replayed, so a retry gives the same result.
    The batch itself is only ever reduced by heaps of n rows.
    """
    spark = log.sparkSession
    cols = [ts, tie, accuracy]

    def state_path(i: int) -> str:
        return f"{folder}/state/batch={i}"

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*cols)
        previous = spark.read.parquet(state_path(batch_id - 1)) if batch_id > 0 else None
        seen = rows.count()
        kept_first, kept_last, total = None, None, seen
        if previous is not None:
            kept_first = previous.where("part = 'first'").select(*cols)
            kept_last = previous.where("part = 'last'").select(*cols)
            total += previous.agg(F.max("total")).first()[0] or 0
            have = kept_first.count()
        else:
            have = 0
        # the baseline is frozen once it holds n rows
        fresh = rows.orderBy(ts, tie).limit(max(0, n - have))
        first = fresh if kept_first is None else kept_first.unionByName(fresh)
        newest = rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)
        last = newest if kept_last is None else kept_last.unionByName(newest).orderBy(F.desc(ts), F.desc(tie)).limit(n)
        state = first.withColumn("part", F.lit("first")).unionByName(last.withColumn("part", F.lit("last")))
        state.withColumn("total", F.lit(total)).coalesce(1).write.mode("overwrite").parquet(state_path(batch_id))
        now = spark.read.parquet(state_path(batch_id))
        mean = now.groupBy().pivot("part", ["first", "last"]).agg(F.avg(F.coalesce(F.col(accuracy), F.lit(0.0))))
        drop = F.col("first") - F.col("last")
        found = mean.where((F.lit(total) > n) & (drop > limit)).select(
            F.lit(batch_id).alias("batch_id"), F.lit("ACCURACY_DROP").alias("type"), F.col("first").alias("baseline"),
            F.col("last").alias("recent"), drop.alias("change"), F.lit(model).alias("model"),
        )
        found.write.mode("overwrite").json(f"{folder}/alerts/batch={batch_id}")

    writer = log.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _with_state_store(spark: SparkSession) -> None:
    """List state and timers need the RocksDB store, which spills to disk; only that is set."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


class _FirstOfKey(StatefulProcessor):
    """Holds the smallest (time, id) of a key with its row and emits it when the watermark has passed its time by the delay."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("row", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # every call on state or timers is a round trip, so none is made that the state already answers
        known = self.best.get()
        timer = None if known is None else known[0] // 1000 + self.hold_ms
        best = before = None if known is None else tuple(known)
        if timer is not None and timer <= timerValues.getCurrentWatermarkInMs():
            yield Row(row=best[2])  # its timer is due: input comes before timers
            best = before = None
            self.best.clear()
        for r in rows:
            if best is None or (r["at_us"], r["order_id"]) < best[:2]:
                best = (r["at_us"], r["order_id"], r["packed"])
        if best is not None and best != before:
            self.best.update(best)
            if timer is not None:
                self.handle.deleteTimer(timer)  # a key has one timer, that of its row
            self.handle.registerTimer(best[0] // 1000 + self.hold_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.best.get()
        if known is not None:
            self.best.clear()
            yield Row(row=known[2])

    def close(self) -> None:
        pass


def dedupe_stream(rows: DataFrame, ts: str, column: str = "question", delay: str = "7 days", tie: str = "event_id", hold: str | None = None,
                  carry: tuple[str, ...] | None = None) -> DataFrame:
    """STR4: of every normalised question the row with the smallest (``ts``, ``tie``), emitted once the watermark is ``hold`` past it.

    Rows may come ``delay`` late.  State is one row for each question that waits.  A question is known until the watermark has passed
    its first time by ``hold`` (by default ``delay``): a repeat that is processed before that never gets out, whichever micro-batch
    or task it comes to; one that comes later is a new question.  Only the columns ``carry`` (by default all) are shuffled, held and
    returned; a text that is only hashed need not wait in the state.  ``tie`` must be a whole number; equal (``ts``, ``tie``) keep the row that came first.
    """
    _with_state_store(rows.sparkSession)
    columns = list(carry or rows.columns)
    kind = T.StructType([rows.schema[c] for c in columns])
    marked = rows.withWatermark(ts, delay).withColumn("_key", text_hash(F.col(column))).where(F.col("_key").isNotNull() & F.col(ts).isNotNull())
    packed = marked.select(F.col("_key").alias("qhash"), _micros(ts).alias("at_us"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("order_id"), F.to_json(F.struct(*columns)).alias("packed"), ts)
    out = T.StructType([T.StructField("row", T.StringType())])
    hold_ms = int(pd.Timedelta(hold or delay).total_seconds() * 1000)
    kept = packed.groupBy("qhash").transformWithState(_FirstOfKey(hold_ms), out, "Append", "EventTime")
    return kept.select(F.from_json("row", kind).alias("r")).select("r.*")


_MEMORY_OUT = T.StructType(
    [T.StructField("user_id", T.StringType()), T.StructField("n_seen", T.LongType()), T.StructField("memory", T.StringType())]
)
_EXCHANGE = T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])


class _Memory(StatefulProcessor):
    """Per user a list of the last exchanges and a count; both go when the user has been idle for long enough of event time."""

    def __init__(self, keep: int, idle_ms: int):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", _EXCHANGE)
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        seen = self.seen.get()[0] if self.seen.exists() else 0
        if items and items[-1][0] // 1000 + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            items, seen = [], 0  # the timer is due: input comes before timers
        for chunk in (c for c in rows if len(c)):
            seen += len(chunk)
            items += chunk[["ts_us", "tie", "question", "answer"]].itertuples(index=False, name=None)
            items = sorted(items, key=lambda r: r[:2])[-self.keep :]
        if not items:
            return
        items = [(int(at), int(tie), *(None if pd.isna(x) else x for x in texts)) for at, tie, *texts in items]
        self.last.put(items)
        self.seen.update((seen,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(items[-1][0] // 1000 + self.idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "n_seen": [seen], "memory": [json.dumps(items, ensure_ascii=False)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def conversation_memory(
    exchanges: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id", keep: int = 5, delay: str = "1 day", idle: str = "30 days"
) -> DataFrame:
    """STR5: per user the last ``keep`` exchanges (JSON list, oldest first), updated by every micro-batch.

    State is ``keep`` exchanges and a count per user, and leaves when the watermark (``delay`` behind) is ``idle`` past the user's last
    exchange; after that the user starts anew.  A user's new rows arrive as Arrow chunks and only ``keep`` of them are held at a
    time.  Rows are ordered by event time, then ``tie``; rows without a time are left out.
    """
    _with_state_store(exchanges.sparkSession)
    rows = exchanges.where(F.col(ts).isNotNull()).select(
        F.col(user).cast("string").alias("user_id"), _micros(ts).alias("ts_us"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"),
        "question", "answer", F.col(ts).alias("seen_at"),
    ).withWatermark("seen_at", delay)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("user_id").transformWithStateInPandas(_Memory(keep, idle_ms), _MEMORY_OUT, "Update", "EventTime")


def triage_stream(questions: DataFrame, profile: Profile = MEDICAL) -> DataFrame:
    """STR6: alert rows for incoming questions; stateless, so an alert leaves with its micro-batch."""
    staged = questions.withColumn("_low", F.lower("question"))
    kind = compute(staged, {"alert_type": emergency_rule(F.col("_low"), profile)})
    return (
        keep(kind, F.col("alert_type").isNotNull())
        .drop("_low")
        .withColumn("severity", emergency_severity(F.col("alert_type"), profile))
        .withColumn("alert_message", emergency_message(F.col("alert_type"), profile))
    )


def curate_stream(requests: DataFrame, question: str = "question", user: str = "user_id") -> DataFrame:
    """STR7: request validation."""
    return valid_requests(requests, question, user)


def burst_alerts(
    errors: DataFrame, kind: str = "error_type", ts: str = "ts", minutes: int = 10, slide: int = 5, more_than: int = 5, delay: str = "1 day",
    quiet: str = "hour",
) -> DataFrame:
    """LOG5 as a stream: sliding windows with more errors of a type than allowed, one alert for each type and ``quiet`` period.

    Windows are counted until the watermark closes them; overlapping windows of one burst raise one alert, known for as long as the
    watermark allows another of the same period.
    """
    counts = error_burst(errors.withWatermark(ts, delay), kind, ts, minutes, more_than, slide)
    period = counts.select(kind, F.date_trunc(quiet, F.col("window_start")).alias("period"), "window_end")
    return period.dropDuplicates([kind, "period"]).select(kind, "period")


def run_available(stream: DataFrame, mode: str = "append", kind: str = "stream") -> DataFrame:
    """Process what is there, write Parquet under the shared folder, return it as a batch DataFrame.

    ``update`` and ``complete`` results are written per micro-batch and carry ``batch_id``.
    """
    spark = stream.sparkSession
    folder = new_path(spark, kind)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    schema = stream.schema
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/data").start()
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/data/part={batch_id}")

        query = writer.foreachBatch(save).start()
        schema = T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/data")
