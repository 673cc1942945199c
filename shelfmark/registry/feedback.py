"""Search log and feedback queries over `events`: a session is a user, a view is a search,
a click or purchase is a thumbs-up, an error a thumbs-down."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import feedback as ops
from shelfmark.registry.base import query, table
from shelfmark.session import scratch_path
from shelfmark.streaming import feedback as streams

FOLD_ROWS = 16
LATE_BATCHES = 6
RATED = """rated AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session_id, props AS pid,
    CASE WHEN event_type IN ('click', 'purchase') THEN true WHEN event_type = 'error' THEN false END AS feedback FROM events),
    valid AS (SELECT * FROM rated WHERE feedback IS NOT NULL)"""
FOLDED = f"""folded AS (SELECT session_id, CAST((pos - 1) // {FOLD_ROWS} AS INTEGER) AS fold,
      string_agg(concat(pid, '=', CAST(feedback AS VARCHAR)), ';' ORDER BY pos) AS feedback, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS pos FROM valid) GROUP BY 1, 2)"""


def shaped(events):
    kind = F.col("event_type")
    thumb = F.when(kind.isin("click", "purchase"), True).when(kind == "error", False)
    return events.select("event_id", "ts", F.col("user_id").cast("string").alias("session_id"), F.col("props").alias("pid"), thumb.alias("feedback"))


def rated(spark, sf_dir):
    return shaped(table(spark, sf_dir, "events"))


def as_text(folded):
    entry = F.transform("feedback", lambda e: F.concat(e["pid"], F.lit("="), e["feedback"].cast("string")))
    return folded.select("session_id", "fold", F.array_join(entry, ";").alias("feedback"), F.size("feedback").cast("bigint").alias("n"))


@query("validate_feedback", f"WITH {RATED} SELECT event_id, session_id, pid, feedback FROM valid")
def validate_feedback(spark, sf_dir):
    return ops.validate_feedback(rated(spark, sf_dir)).select("event_id", "session_id", "pid", "feedback")


@query("rejected_feedback", f"WITH {RATED} SELECT event_id, session_id, pid FROM rated WHERE feedback IS NULL")
def rejected_feedback(spark, sf_dir):
    return ops.rejected_feedback(rated(spark, sf_dir)).select("event_id", "session_id", "pid")


@query("feedback_fold", f"WITH {RATED}, {FOLDED} SELECT session_id, fold, feedback, n FROM folded")
def feedback_fold(spark, sf_dir):
    return as_text(ops.feedback_fold(rated(spark, sf_dir), FOLD_ROWS))


@query("feedback_stream", f"WITH {RATED}, {FOLDED} SELECT session_id, fold, feedback, n FROM folded")
def feedback_stream(spark, sf_dir):
    """The events file as a stream into the feedback log, which is then folded."""
    schema = table(spark, sf_dir, "events").schema
    log, state = scratch_path(spark, "feedback-log"), scratch_path(spark, "feedback-state")
    source = streams.file_stream(spark, sf_dir, schema, "events.parquet")
    streams.feedback_stream(shaped(source), log, state).awaitTermination()
    return as_text(ops.fold_entries(streams.logged_entries(spark, log), FOLD_ROWS))


@query("feedback_late", f"WITH {RATED}, {FOLDED} SELECT session_id, fold, feedback, n FROM folded")
def feedback_late(spark, sf_dir):
    """The events in three deliveries, the newest third first and the oldest last, with the middle
    third delivered twice; a micro-batch takes a share of the files, so that there are as many whatever the input."""
    events = table(spark, sf_dir, "events")
    folder, log, state = (scratch_path(spark, n) for n in ("late-events", "late-log", "late-state"))
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.33, 0.67]).alias("c")).first()["c"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for part in (at > cuts[1], (at > cuts[0]) & (at <= cuts[1]), (at > cuts[0]) & (at <= cuts[1]), at <= cuts[0]):
        events.filter(part).write.mode("append").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    source = streams.file_stream(spark, folder, events.schema, "*.parquet", files_per_batch=max(2, -(-files // LATE_BATCHES)))
    streams.feedback_stream(shaped(source), log, state).awaitTermination()
    return as_text(ops.fold_entries(streams.logged_entries(spark, log), FOLD_ROWS))


@query(
    "feedback_entries",
    f"WITH {RATED} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS pos, pid, feedback FROM valid",
)
def feedback_entries(spark, sf_dir):
    return ops.feedback_entries(rated(spark, sf_dir))


@query("search_log_append", "SELECT CAST(user_id AS VARCHAR) AS session_id, props AS query_text, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def search_log_append(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    log, state = scratch_path(spark, "search-log"), scratch_path(spark, "search-state")
    source = streams.file_stream(spark, sf_dir, schema, "events.parquet").filter("event_type = 'view'")
    requests = source.select(F.col("user_id").alias("session_id"), F.col("props").alias("query_text"), F.col("ts").alias("timestamp"))
    streams.search_log_append(requests, log, state).awaitTermination()
    return spark.read.parquet(log).groupBy("session_id", "query_text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "log_search_merge",
    f"""WITH {RATED}, {FOLDED}, searches AS (SELECT CAST(user_id AS VARCHAR) AS session_id, arg_min(props, event_id) AS query_text
      FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT coalesce(s.session_id, f.session_id) AS session_id, query_text, coalesce(fold, 0) AS fold, feedback, n
    FROM searches s FULL JOIN folded f ON s.session_id = f.session_id AND f.fold = 0""",
)
def log_search_merge(spark, sf_dir):
    searches = (
        table(spark, sf_dir, "events")
        .filter("event_type = 'view'")
        .groupBy(F.col("user_id").cast("string").alias("session_id"))
        .agg(F.min_by("props", "event_id").alias("query_text"))
    )
    return ops.log_search_merge(searches, feedback_fold(spark, sf_dir))


@query("feedback_precision", f"WITH {RATED} SELECT pid, count(*) AS n, round(avg(CAST(feedback AS INTEGER)), 6) AS precision FROM valid GROUP BY 1")
def feedback_precision(spark, sf_dir):
    return ops.feedback_precision(rated(spark, sf_dir), "pid").withColumn("precision", F.round("precision", 6))
