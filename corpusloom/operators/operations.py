"""Operational queries: statistics, queues, jobs, retention, conversations and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.sinks import latest

FILE_STATUSES = ["queued", "processing", "completed", "failed"]


def file_stats(files: DataFrame, statuses: list[str] = FILE_STATUSES) -> DataFrame:
    """Per status: files, bytes, chunks; known statuses without files are zero, blank ones are unknown."""
    known = files.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    status = F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("unknown"))
    rows = files.select(status.alias("status"), "size", "chunks", F.lit(1).alias("one")).unionByName(known.select("status", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("chunks"), F.lit(0).alias("one")))
    return rows.groupBy("status").agg(F.sum("one").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def file_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.round(F.sum("size") / F.count("*"), 6).alias("average"))


def queue_metrics(files: DataFrame, now: Column, failures: int = 5) -> DataFrame:
    """Ages of what waits, last activity and the latest failures, in one pass."""
    age = F.greatest(F.unix_timestamp(now) - F.unix_timestamp("created_at"), F.lit(0))
    waiting = F.when(F.col("status") == "queued", age)
    totals = files.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "queued").alias("depth"), F.max(waiting).alias("oldest_age"), F.round(F.avg(waiting), 6).alias("average_age"), F.max("created_at").alias("last_activity"))
    recent = files.where("status = 'failed'").orderBy(F.desc("created_at"), "id").limit(failures)
    listed = recent.agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", (-F.col("id")).alias("k"), "id")), asc=False), lambda x: x["id"]).alias("recent_failures"))
    return totals.crossJoin(listed)  # one row each


def child_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordered listing, every row with the total."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(total)


def stale(jobs: DataFrame, before: Column) -> DataFrame:
    return jobs.where((F.col("status") == "processing") & (F.coalesce("updated_at", "started_at", "created_at") <= before))


def next_job(jobs: DataFrame, before: Column) -> DataFrame:
    """The next job: queued before stuck ones, then by priority and age."""
    stuck = (F.col("status") == "processing") & (F.coalesce("updated_at", "started_at", "created_at") <= before)
    ready = jobs.where((F.col("status") == "queued") | stuck)
    return ready.orderBy(F.when(F.col("status") == "queued", 0).otherwise(1), F.desc("priority"), "created_at", "id").limit(1)


def recover(jobs: DataFrame, before: Column, now: Column) -> DataFrame:
    """Stuck jobs with another attempt, the error tag and what is noted in the payload."""
    note = F.create_map(F.lit("attempt"), (F.col("attempt") + 1).cast("string"), F.lit("recovered_stuck_job"), F.lit("true"), F.lit("recovery_reason"), F.lit("RECOVERED_STUCK_JOB"))
    return stale(jobs, before).withColumn("payload", F.map_concat("payload", note)).withColumn("attempt", F.col("attempt") + 1).withColumn("error", F.lit("RECOVERED_STUCK_JOB")).withColumn("updated_at", now)


def retry(jobs: DataFrame, base: float, most: int) -> DataFrame:
    """Failed jobs that may try again, with the wait before it; those beyond the limit stay failed."""
    attempt = F.col("attempt") + 1
    again = attempt <= most
    return jobs.where("status = 'failed'").select("id", attempt.alias("attempt"), F.when(again, "queued").otherwise("failed").alias("status"), F.when(again, F.lit(base) * F.pow(F.lit(2.0), attempt - 1)).alias("delay"))


TRANSITIONS = {"queued": ["processing"], "processing": ["completed", "failed", "queued"], "failed": ["queued"], "completed": []}


def transition(jobs: DataFrame, wanted: Column) -> DataFrame:
    """The state each job has after a request; a request that its state does not allow changes nothing."""
    allowed = F.lit(False)
    for state, following in TRANSITIONS.items():
        if following:
            allowed = allowed | ((F.col("status") == state) & wanted.isin(*following))
    return jobs.withColumn("claimed", allowed).withColumn("status", F.when(allowed, wanted).otherwise(F.col("status")))


def maintain(jobs: DataFrame, cutoff: Column, stuck: Column) -> DataFrame:
    """Jobs finished before the cutoff go; work stuck for too long fails."""
    kept = jobs.where(F.col("finished_at").isNull() | (F.col("finished_at") >= cutoff))
    late = (F.col("status") == "processing") & (F.col("updated_at") < stuck)
    return kept.withColumn("error", F.when(late, "STALE_PROCESSING").otherwise(F.col("error"))).withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def purge(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days; 0 or less keeps all."""
    return df if days <= 0 else df.where(F.col(ts) >= now - F.expr(f"interval {days} days"))


def register(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Uploads against known files by (tenant, sha256): create, requeue what failed, or leave."""
    a = latest(incoming, ["tenant_id", "sha256"], [F.desc("id")])
    b = current.select("tenant_id", "sha256", F.col("id").alias("known"), "status")
    action = F.when(F.col("known").isNull(), "create").when(F.col("status") == "failed", "requeue").otherwise("keep")
    return a.join(b, ["tenant_id", "sha256"], "left").select("tenant_id", "sha256", F.coalesce("known", "id").alias("id"), action.alias("action"))


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation, oldest first."""
    recent = messages.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= n)
    return recent.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("back")


def preceding_question(messages: DataFrame) -> DataFrame:
    """Each message with the last user message before it in its conversation."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def feedback_pairs(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Preference pairs from ratings: the newest of each message and user decides.

    An alternative answer beats the assistant's; an approval without one is paired with the newest
    older disapproval that has one. Messages without a question before them are left out.
    """
    by = Window.partitionBy("message_id", "user_id").orderBy(F.desc("created_at"), F.desc("id"))
    later = by.rowsBetween(1, Window.unboundedFollowing)
    against = F.when((F.col("rating") == -1) & (F.coalesce("alternative", F.lit("")) != ""), F.struct("id", "alternative"))
    ranked = feedback.withColumn("rn", F.row_number().over(by)).withColumn("older", F.first(against, ignorenulls=True).over(later)).where("rn = 1")
    asked = preceding_question(messages).where("question is not null").select("message_id", "question", F.col("text").alias("answer"))
    joined = ranked.join(asked, "message_id")
    has = F.coalesce("alternative", F.lit("")) != ""
    live = joined.select(
        F.col("question").alias("prompt"),
        F.when(has, F.col("alternative")).when((F.col("rating") == 1) & F.col("older").isNotNull(), F.col("answer")).alias("chosen"),
        F.when(has, F.col("answer")).otherwise(F.col("older.alternative")).alias("rejected"),
        F.when(has, "live_alt").otherwise("live_paired").alias("strategy"),
        F.when(has, F.array("id")).otherwise(F.array("id", "older.id")).alias("feedback_ids"),
    )
    return live.where("chosen is not null")


SEVERITY = {"vector_backend_down": 2, "hashing_embedder": 2, "embedding_dim_mismatch": 2, "search_truncated": 1}


def health(reports: DataFrame, now: Column, ttl: int = 300) -> DataFrame:
    """Reasons whose last report is degraded and not older than ``ttl`` seconds, with their age and severity."""
    last = latest(reports, ["reason"], [F.desc("ts"), F.desc("event_id")])
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    level = F.lit("warning")
    for reason, n in SEVERITY.items():
        if n == 2:
            level = F.when(F.col("reason") == reason, "critical").otherwise(level)
    return last.where(F.col("degraded") & (age <= ttl)).select("reason", level.alias("severity"), age.alias("age_s"))
