"""Search log and feedback as streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from shelfmark.operators.feedback import feedback_entries, validate_feedback
from shelfmark.session import staged


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def search_log_append(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append (session_id, query_text, timestamp) rows; a session without an id gets one,
    and a request without a time is stamped on arrival."""
    rows = requests.select(
        F.coalesce(F.col("session_id").cast("string"), F.uuid()).alias("session_id"),
        "query_text",
        F.coalesce(F.col("timestamp").cast("timestamp"), F.current_timestamp()).alias("timestamp"),
    )
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


_LOG = ["session_id", "ts", "event_id", "pid", "feedback"]


def feedback_stream(events: DataFrame, path: str, checkpoint: str, idle: timedelta | None = None, every: str = "1 minute") -> StreamingQuery:
    """Valid feedback rows appended to a log table by micro-batch, each with its place in its session.

    State is a row of fixed size per session: how many entries it has and which was the last, so
    a session may grow for ever. A row that comes after the last entry gets the next place. One that
    does not, because it is late, out of order or delivered again, goes to the log without
    a place, however late it is: nothing is dropped, and the reader places it. A repeated
    micro-batch replaces its own folder, which makes the sink exactly-once.

    By default the stream takes what there is and ends. With ``idle`` it goes on, a micro-batch
    ``every`` so often, and a session without rows for that long loses its state, which bounds
    the number of states; when it comes back it starts another segment, which the reader joins.
    """
    valid = validate_feedback(events.withColumn("ts", F.col("ts").cast("timestamp"))).select(*_LOG)
    kind = valid.schema["event_id"].dataType
    none = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    # Order as plain values: a NULL would turn whole numbers into floats on the way.
    ordered = valid.withColumns(
        {"_us": F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))), "_named": F.col("event_id").isNotNull(), "event_id": F.coalesce("event_id", none)}
    )
    log = T.StructType([*(T.StructField(c, valid.schema[c].dataType) for c in _LOG), T.StructField("_named", T.BooleanType()), T.StructField("pos", T.LongType()), T.StructField("opens", T.BooleanType())])
    state_type = T.StructType([T.StructField("n", T.LongType()), T.StructField("us", T.LongType()), T.StructField("named", T.BooleanType()), T.StructField("event_id", kind)])
    millis = None if idle is None else int(idle.total_seconds() * 1000)

    def place(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opens = not state.exists
        n, last = (0, None) if opens else (state.get[0], tuple(state.get[1:]))
        for frame in frames:
            # Sessions are mostly short: sorting tuples costs less than a sort by three columns.
            rows = [*zip(frame["_us"].tolist(), frame["_named"].tolist(), frame["event_id"].tolist())]
            order = sorted(range(len(rows)), key=rows.__getitem__)
            places, firsts = [], []
            for row in map(rows.__getitem__, order):
                later = last is None or row > last
                if later:
                    n, last = n + 1, row
                places.append(n if later else None)
                firsts.append(later and opens)
                opens = opens and not later
            out = frame[[*_LOG, "_named"]].take(order)
            out["pos"], out["opens"] = pd.array(places, dtype="Int64"), firsts
            yield out
        state.update((n, *last))
        if millis is not None:
            state.setTimeoutDuration(millis)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    placed = ordered.groupBy("session_id").applyInPandasWithState(place, log, state_type, "append", timeout)

    def store(batch: DataFrame, batch_id: int) -> None:
        named = F.when(F.col("_named"), F.col("event_id")).alias("event_id")
        batch.select("session_id", "ts", named, "pid", "feedback", "pos", "opens").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = placed.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if idle is None else {"processingTime": every})).start()


def read_feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """The logged events, each once: of repeated deliveries the earliest by time, then by
    content. Rows without an event id cannot be matched and all stay."""
    return _once(spark.read.parquet(path).select(*_LOG))


def _once(log: DataFrame) -> DataFrame:
    known = log.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.min(F.struct("ts", "session_id", "pid", "feedback")).alias("e"))
    once = known.select("e.session_id", "e.ts", "event_id", "e.pid", "e.feedback")
    return once.unionByName(log.filter("event_id IS NULL").select(*once.columns))


def logged_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all sessions, ``session_id, pos, pid, feedback``, as ``feedback_entries`` gives them for
    the events. Places from the stream are taken as they are; only sessions with a row that has
    none, or with several segments, are put in order again. An event that is delivered again is
    taken to repeat its session and time.
    """
    log = spark.read.parquet(path).drop("batch_id")
    open_ = log.groupBy("session_id").agg(F.count_if(F.col("pos").isNull()).alias("late"), F.count_if("opens").alias("segments"))
    again = staged(open_.filter("late > 0 OR segments > 1").select("session_id"), "sessions-again")
    placed = log.join(again, "session_id", "left_anti").select("session_id", "pos", "pid", "feedback")
    return placed.unionByName(feedback_entries(_once(log.join(again, "session_id", "left_semi").select(*_LOG))))
