"""State of sources, jobs and batches, folded from their reports. A fold is an aggregate, so no key's history meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Failures, states that block whatever the time, and states that block until their cooldown ends.
FAILURES = ("quota_exhausted", "rate_limited", "captcha_cooldown", "unavailable")
HARD = ("quota_exhausted", "missing_key", "not_installed")
SOFT = ("captcha_cooldown", "rate_limited")


def source_states(reports: DataFrame) -> DataFrame:
    """One row per source from (source, at, seq, status, base_seconds), in order of time and seq.

    Out: status (the last), failures (in a row since the last ok; states of set-up neither count nor reset), successes, failed (all
    failures), cooldown (seconds, doubled for each failure in a row, at most 3600; null after an ok) and until (end of the
    cooldown). A failure without a base counts but sets no cooldown."""
    when = F.struct("at", "seq")
    bad = F.col("status").isin(*FAILURES)
    last_ok = reports.where("status = 'ok'").groupBy("source").agg(F.max(when).alias("ok"))
    # one row a source on this side
    seen = reports.join(last_ok, "source", "left").withColumn("after", F.col("ok").isNull() | (when > F.col("ok")))
    set_by = F.max(F.when(bad & F.col("after") & (F.col("base_seconds") > 0), F.struct("at", "seq", "base_seconds")))
    whole = seen.groupBy("source").agg(
        F.max_by("status", when).alias("status"), F.count_if(bad & F.col("after")).alias("failures"), F.count_if(F.col("status") == "ok").alias("successes"), F.count_if(bad).alias("failed"), set_by.alias("s"),
    )
    upto = seen.join(whole.select("source", F.struct("s.at", "s.seq").alias("limit")), "source").where(bad & F.col("after") & (when <= F.col("limit"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    cool = F.least(F.lit(3600.0), F.col("s.base_seconds") * F.pow(F.lit(2.0), F.least(F.col("n"), F.lit(30)) - 1)).cast("bigint")
    out = whole.join(upto, "source", "left").withColumn("cooldown", F.when(F.col("s").isNotNull(), cool))
    return out.select("source", "status", "failures", "successes", "failed", "cooldown", (F.unix_micros(F.col("s.at").cast("timestamp")) + F.col("cooldown") * 1_000_000).alias("until"))


def blocked(now: Column) -> Column:
    """Whether a source must not be called at ``now`` (microseconds)."""
    return F.col("status").isin(*HARD) | (F.col("status").isin(*SOFT) & F.coalesce(F.col("until") > now, F.lit(False)))


def job_states(events: DataFrame) -> DataFrame:
    """One row per job from (job, at, seq, kind): pending until a start, running until done or error, whichever comes first; what follows an end does not count."""
    when = F.struct("at", "seq")
    first = events.groupBy("job").agg(
        F.min(F.when(F.col("kind") == "start", when)).alias("started"), F.min(F.when(F.col("kind").isin("done", "error"), F.struct("at", "seq", "kind"))).alias("ended"),
        F.min("at").alias("created"), F.count(F.lit(1)).alias("n_events"),
    )
    status = F.when(F.col("ended").isNotNull(), F.col("ended.kind")).when(F.col("started").isNotNull(), "running").otherwise("pending")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return first.select("job", status.alias("status"), micros(F.col("created")).alias("created"), micros(F.col("ended.at")).alias("finished"), "n_events")


def batch_states(members: DataFrame) -> DataFrame:
    """One row per batch of (batch, status): its members by status; without errors it is done, without any done it is an error, else partial."""
    n = {s: F.count_if(F.col("status") == s) for s in ("done", "error", "running", "queued", "skipped")}
    counts = members.groupBy("batch").agg(F.count(F.lit(1)).alias("members"), *[v.alias(k) for k, v in n.items()])
    return counts.withColumn("status", F.when(F.col("error") == 0, "done").when(F.col("done") == 0, "error").otherwise("partial"))


def cancelled(status: Column) -> Column:
    """A member's status after its batch was cancelled."""
    return F.when(status.isin("queued", "running"), "skipped").otherwise(status)


def restored(status: Column, of_batch: bool = False) -> Column:
    """Status of a snapshot read back after the session ended: what was running failed, or is partial for a batch."""
    return F.when(status == "running", "partial" if of_batch else "error").otherwise(status)
