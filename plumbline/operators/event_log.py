"""Reports over the event log (one JSON object per line), as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.percentile import nearest_ranks

SCHEMA = (
    "event string, ts timestamp, seq long, query_hash string, ref string, error string, latency_ms double, bytes_scanned long, "
    "trust_tier string, outcome string, milestone string, decision string, binding string, resolved map<string, string>, "
    "stale boolean, guardrails array<string>"
)
# The milestones of a project's first use, in order (fixed values).
MILESTONES = ("setup_started", "connection_added", "bootstrap_completed", "first_answer_served", "first_curated_review_completed")
#: The version of what ``telemetry`` sends.
TELEMETRY_VERSION = "1"


def _served(log: DataFrame) -> DataFrame:
    return log.filter("event = 'served_answer'")


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of one row as one."""
    return one.join(F.broadcast(other), how="left")


def answer_report(log: DataFrame) -> DataFrame:
    """One row: answers, errors, first and last time, latency with nearest-rank percentiles, bytes, stale answers, answers that met a guardrail.

    The percentiles hold no group's values in one buffer.
    """
    served = _served(log)
    out = served.agg(
        F.count(F.lit(1)).alias("answers"),
        F.count("error").alias("errors"),
        F.min_by("ts", "seq").alias("first_ts"),
        F.max_by("ts", "seq").alias("last_ts"),
        F.min("latency_ms").alias("latency_min"),
        F.max("latency_ms").alias("latency_max"),
        F.avg("latency_ms").alias("latency_avg"),
        F.sum("bytes_scanned").alias("bytes_total"),
        F.min("bytes_scanned").alias("bytes_min"),
        F.max("bytes_scanned").alias("bytes_max"),
        F.avg("bytes_scanned").alias("bytes_avg"),
        F.count_if("stale").alias("stale_answers"),
        F.count_if(F.size("guardrails") > 0).alias("guardrail_coverage"),
    )
    return _beside(out, nearest_ranks(served, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95}))


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    """The last n answers, the latest first."""
    return _served(log).orderBy(F.desc("seq")).limit(n)


def error_distribution(log: DataFrame) -> DataFrame:
    """Answers by error code; those without an error are ``ok``."""
    return _served(log).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("answers"))


def errors_by_code(log: DataFrame) -> DataFrame:
    return error_distribution(log).filter("error != 'ok'")


def latest_outcomes(log: DataFrame) -> DataFrame:
    """The last outcome of each reference, in the order of the log."""
    rows = log.filter("event = 'answer_outcome' and ref is not null")
    last = rows.groupBy("ref").agg(F.max_by(F.struct("outcome", "ts"), "seq").alias("last"))
    return last.select("ref", "last.outcome", "last.ts")


def _judged(log: DataFrame, *columns: str) -> DataFrame:
    """Each judged reference once, whether it was wrong, and columns of the last answer with that hash (known: there is one)."""
    last = F.max_by(F.struct(*columns), "seq").alias("last")
    served = _served(log).groupBy("query_hash").agg(last)
    joined = latest_outcomes(log).join(served, F.col("ref") == F.col("query_hash"), "left")
    return joined.select(F.col("outcome").like("wrong%").alias("incorrect"), F.col("query_hash").isNotNull().alias("known"), *[f"last.{c}" for c in columns])


def calibration(log: DataFrame) -> DataFrame:
    """For each trust tier how many judged answers there are, how many were wrong, and their share; each answer counts once."""
    tiers = _judged(log, "trust_tier").filter("trust_tier is not null").groupBy(F.col("trust_tier").alias("tier"))
    counted = tiers.agg(F.count(F.lit(1)).alias("judged"), F.count_if("incorrect").alias("incorrect"))
    return counted.withColumn("incorrect_rate", F.col("incorrect") / F.col("judged"))


def unmatched(log: DataFrame) -> DataFrame:
    """One row: judged references without an answer in the log, or whose answer has no trust tier."""
    return _judged(log, "trust_tier").agg(F.count_if(F.col("trust_tier").isNull()).alias("unmatched"))


def recurring_corrections(log: DataFrame) -> DataFrame:
    """Bindings of answers whose last verdict is wrong, if there are several; an answer that was marked again counts once."""
    wrong = _judged(log, "resolved").filter("incorrect")
    each = wrong.select(F.explode(F.map_values("resolved")).alias("binding"))
    return each.groupBy("binding").agg(F.count(F.lit(1)).alias("corrections")).filter("corrections > 1").orderBy(F.desc("corrections"), "binding")


def funnel(log: DataFrame) -> DataFrame:
    """When each milestone was first met, in the order of the log."""
    rows = log.filter("event = 'funnel_milestone'").groupBy("milestone")
    return rows.agg(F.min("seq").alias("place"), F.min_by("ts", "seq").alias("first")).orderBy("place")


def funnel_report(log: DataFrame, milestones: Sequence[str] = MILESTONES) -> DataFrame:
    """One row: the milestones reached, in their order, the last one if others are missing, and the seconds to the first answer."""
    # At most one row for each milestone.
    firsts = {m: F.min(F.when(F.col("milestone") == m, F.col("first").cast("timestamp"))).alias(f"at{i}") for i, m in enumerate(milestones)}
    met = funnel(log).agg(*firsts.values())
    named = [F.when(F.col(f"at{i}").isNotNull(), F.lit(m)) for i, m in enumerate(milestones)]
    reached = F.array_compact(F.array(*named))
    part = F.when((F.size("reached") > 0) & (F.size("reached") < len(milestones)), F.element_at("reached", -1))
    took = F.lit(None).cast("double")
    if {"setup_started", "first_answer_served"} <= set(milestones):
        start, end = (F.unix_micros(f"at{milestones.index(m)}") for m in ("setup_started", "first_answer_served"))
        took = (end - start) / 1e6
    return met.select(reached.alias("reached"), took.alias("time_to_first_answer_seconds")).withColumn("dropped_after", part)


def capped_bindings(log: DataFrame, days: int, now: str) -> DataFrame:
    """Bindings confirmed to be wrongly defined within so many days and not judged correct since."""
    since = F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval({int(days)})")
    rows = log.filter("event = 'answer_outcome' and binding is not null and outcome in ('wrong_definition', 'correct')")
    last = rows.groupBy("binding").agg(F.max_by(F.struct("outcome", "ts"), "seq").alias("last"))
    return last.filter((F.col("last.outcome") == "wrong_definition") & (F.col("last.ts") >= since)).select("binding")


def event_counts(log: DataFrame) -> DataFrame:
    """Counts by event and error."""
    return log.groupBy("event", "error").agg(F.count(F.lit(1)).alias("n"))


def telemetry(log: DataFrame, accuracy: float | None = None, baseline_accuracy: float | None = None) -> DataFrame:
    """One row, all that telemetry would send: aggregates of the reports, no names, filters or values.

    Accuracies are left out, not null, where they aren't given.
    """
    answers = answer_report(log).drop("first_ts", "last_ts", "errors")
    answers = answers.withColumnsRenamed({"answers": "answer_count", "stale_answers": "stale_answer_count", "guardrail_coverage": "guardrail_hit_count"})
    # A row for each error code and each tier.
    entries = F.array_sort(F.collect_list(F.struct("error", "answers")))
    errors = error_distribution(log).agg(F.map_from_entries(entries).alias("error_distribution"))
    tiers = calibration(log).agg(F.array_sort(F.collect_list(F.struct("tier", "judged", "incorrect", "incorrect_rate"))).alias("trust_calibration"))
    recurring = recurring_corrections(log).agg(F.count(F.lit(1)).alias("recurring_binding_count"))
    reached = funnel_report(log).select(F.col("reached").alias("funnel_reached"), "time_to_first_answer_seconds")
    out = answers
    for part in (errors, tiers, recurring, reached):
        out = _beside(out, part)
    given = {"accuracy": accuracy, "baseline_accuracy": baseline_accuracy}
    return out.select(F.lit(TELEMETRY_VERSION).alias("schema_version"), "*", *[F.lit(v).alias(k) for k, v in given.items() if v is not None])


def running_errors(log: DataFrame) -> DataFrame:
    """Each answer with the number of errors so far on its day."""
    day = Window.partitionBy(F.to_date("ts")).orderBy("seq")
    return _served(log).withColumn("errors_so_far", F.count("error").over(day))
