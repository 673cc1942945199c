"""Feedback rows folded per session, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.parsing import is_blank
from shelfmark.functions.ranking import index_within


def _complete():
    return (
        ~is_blank(F.col("pid").cast("string"))
        & F.col("feedback").isNotNull()
        & ~is_blank(F.col("session_id").cast("string"))
    )


def validate_feedback(events: DataFrame) -> DataFrame:
    """Rows with pid, feedback and session."""
    return events.filter(_complete())


def rejected_feedback(events: DataFrame) -> DataFrame:
    return events.filter(~_complete())


def feedback_entries(events: DataFrame) -> DataFrame:
    """Each session's entries in time order, a row each: ``session_id``, ``pos`` (from 1),
    ``pid``, ``feedback``. Sessions may have any length."""
    valid = validate_feedback(events).select("session_id", "ts", "event_id", "pid", "feedback")
    return index_within(valid, ["session_id"], ["ts", "event_id"]).select("session_id", "pos", "pid", "feedback")


def feedback_fold(events: DataFrame, rows_per_fold: int) -> DataFrame:
    """The entries as arrays for presentation, ``rows_per_fold`` to a row.

    A longer session goes on in further rows with the next ``fold`` number, from 0, so
    that no row and no task has to hold a session without bound. Nothing is dropped.
    """
    return fold_entries(feedback_entries(events), rows_per_fold)


def fold_entries(placed: DataFrame, rows_per_fold: int) -> DataFrame:
    """Entries ``session_id, pos, pid, feedback`` as arrays."""
    fold = F.floor((F.col("pos") - 1) / rows_per_fold).cast("int")
    lists = placed.groupBy("session_id", fold.alias("fold")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "pid", "feedback"))).alias("_l")
    )
    return lists.select(
        "session_id", "fold", F.transform("_l", lambda e: F.struct(e["pid"].alias("pid"), e["feedback"].alias("feedback"))).alias("feedback")
    )


def log_search_merge(searches: DataFrame, folded: DataFrame) -> DataFrame:
    """Search rows, one per session, with their session's feedback; either side may be alone. A
    search stands at the first fold of its session, so it comes once however long that is."""
    first = searches.withColumn("fold", F.lit(0))
    return first.join(folded, ["session_id", "fold"], "full")


def feedback_precision(events: DataFrame, by: str) -> DataFrame:
    """Share of positive feedback."""
    return validate_feedback(events).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("feedback").cast("int")).alias("precision")
    )
