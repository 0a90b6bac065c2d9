"""The job state machine over its event log, and evaluation of detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Steps of a job in order, the states that end it, and stage and progress shown.
STEPS = ("queued", "upload_validated", "parsing", "checking_format", "checking_sensitive", "checking_chinese", "checking_english", "completed")
FINAL = ("completed", "partial", "failed", "expired")


def events(log: DataFrame) -> DataFrame:
    """The log without repeated rows: of each job and sequence, the first row received."""
    first = Window.partitionBy("job_id", "sequence").orderBy("received_at", "created_at", "status", "progress", "message")
    return log.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def latest(log: DataFrame) -> DataFrame:
    """job_id, sequence, status, progress of the last event of each job, of repeated ones as first received; pre-aggregated before the shuffle."""
    first = F.struct("sequence", *[F.struct(F.col(c).isNull(), F.lit(0) - F.unix_micros(c)).alias(c) for c in ("received_at", "created_at")])
    best = F.max(F.struct(first.alias("order"), F.struct("sequence", "status", "progress").alias("e")))
    return log.groupBy("job_id").agg(best.alias("m")).select("job_id", "m.e.sequence", "m.e.status", "m.e.progress")


def violations(log: DataFrame) -> DataFrame:
    """job_id, sequence, problem: steps that go back or leave a final state, progress that falls, and gaps in the sequence."""
    step = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(STEPS) for x in (s, k)]), F.col("status"))
    order = Window.partitionBy("job_id").orderBy("sequence")
    rows = events(log).withColumn("step", step).withColumn("b_step", F.lag("step").over(order)).withColumn("b_status", F.lag("status").over(order)).withColumn("b_progress", F.lag("progress").over(order)).withColumn("b_sequence", F.lag("sequence").over(order))
    problems = F.filter(
        F.array(
            F.when(F.col("b_status").isin(*FINAL), F.lit("after_final")),
            F.when(F.col("step") < F.col("b_step"), F.lit("step_back")),
            F.when(F.col("progress") < F.col("b_progress"), F.lit("progress_falls")),
            F.when(F.col("sequence") > F.coalesce("b_sequence", F.lit(-1)) + 1, F.lit("missing_event")),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("job_id", "sequence", F.explode(problems).alias("problem"))


def resumed(log: DataFrame, after: int) -> DataFrame:
    """Events of each job after a sequence number, as a reader that comes back asks for them."""
    return events(log).where(F.col("sequence") > after).select("job_id", "sequence", "status", "progress")


def stage(log: DataFrame) -> DataFrame:
    """job_id, sequence, stage: the stage shown; parsing from 40 on is ocr, English checks from 95 on are finalizing."""
    shown = F.when((F.col("status") == "parsing") & (F.col("progress") >= 40), "ocr").when((F.col("status") == "checking_english") & (F.col("progress") >= 95), "finalizing").otherwise(F.col("status"))
    return events(log).select("job_id", "sequence", shown.alias("stage"))


def claims(log: DataFrame, stale_before: str, limit: int = 100) -> DataFrame:
    """The oldest jobs to take up again: not in a final state and without an event since."""
    last = events(log).groupBy("job_id").agg(F.max_by("status", "sequence").alias("status"), F.max("received_at").alias("last_seen"))
    return last.where(~F.col("status").isin(*FINAL) & (F.col("last_seen") < F.lit(stale_before).cast("timestamp"))).orderBy("last_seen", "job_id").limit(limit)


def evaluate(found: DataFrame, expected: DataFrame, groups: DataFrame) -> DataFrame:
    """case_group (null for all), tp, fp, fn, precision, recall: one-to-one matches of spans and types, by a full outer join of numbered keys.

    found and expected have case_id, start, end, type; groups has case_id and case_group. A metric without a denominator is null.
    """
    key = ["case_id", "start", "end", "type"]
    nth = Window.partitionBy(*key).orderBy(F.lit(0))
    number = lambda d, c: d.select(*key).withColumn("nth", F.row_number().over(nth)).withColumn(c, F.lit(1))
    met = number(found, "f").join(number(expected, "e"), [*key, "nth"], "full").join(groups.select("case_id", "case_group").distinct(), "case_id", "left")
    both = F.col("f").isNotNull() & F.col("e").isNotNull()
    counts = met.rollup("case_group").agg(F.count_if(both).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return counts.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6))


# The stages of work with the status and progress they show.
STAGES = (("parsing", "parsing", 25), ("ocr", "parsing", 40), ("checking_format", "checking_format", 50), ("checking_sensitive", "checking_sensitive", 65), ("checking_chinese", "checking_chinese", 80), ("checking_english", "checking_english", 90))


def shown(stages: DataFrame) -> DataFrame:
    """The rows with the status and progress that their stage shows; unknown stages show none."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else x for s, status, progress in STAGES for x in (s, F.struct(F.lit(status).alias("status"), F.lit(progress).alias("progress")))])
    told = F.element_at(table, F.col("stage"))
    return stages.withColumn("status", told["status"]).withColumn("progress", told["progress"])


def leased(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """job_id, owner, disposition, lease_until: what becomes of each request for a job at its time.

    jobs: job_id, status, lease_owner, lease_until, expires_at; requests: job_id, owner, asked_at, seconds. A job that does not exist is missing; one in a
    final state is terminal; one past its retention, retention_expired; one that another owner holds until later, leased. Else the request acquires the job, or
    renews it where the owner has it. Of several requests for a job, the first gets it; the others find it leased, and the owner's own renew it.
    """
    order = Window.partitionBy("job_id").orderBy("asked_at", "owner")
    met = requests.join(jobs.withColumn("known", F.lit(True)), "job_id", "left")
    held = (F.col("lease_until") > F.col("asked_at")) & F.col("lease_owner").isNotNull()
    blocked = F.when(F.col("known").isNull(), "missing").when(F.col("status").isin(*FINAL), "terminal").when(F.col("expires_at") <= F.col("asked_at"), "retention_expired").when(held & (F.col("lease_owner") != F.col("owner")), "leased")
    rows = met.withColumn("disposition", blocked).withColumn("winner", F.first(F.when(F.col("disposition").isNull(), F.col("owner")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = F.count(F.lit(1)).over(Window.partitionBy("job_id", "owner").orderBy("asked_at").rowsBetween(Window.unboundedPreceding, -1)) > 0
    told = F.coalesce("disposition", F.when(F.col("winner") != F.col("owner"), "leased").when((held & (F.col("lease_owner") == F.col("owner"))) | own, "renewed").otherwise("acquired"))
    until = F.when(told.isin("acquired", "renewed"), F.timestamp_micros(F.unix_micros("asked_at") + F.col("seconds") * 1_000_000))
    return rows.select("job_id", "owner", told.alias("disposition"), until.alias("lease_until"))


def expired(jobs: DataFrame, cutoff: str) -> DataFrame:
    """job_id, status: the jobs whose retention has ended by a time and that nobody holds then, as the event that ends them. Jobs expired already are left out."""
    at = F.lit(cutoff).cast("timestamp")
    return jobs.where((F.col("expires_at") <= at) & ~F.coalesce(F.col("lease_until") > at, F.lit(False)) & (F.col("status") != "expired")).select("job_id", F.lit("expired").alias("status"))


def metrics(found: DataFrame, expected: DataFrame, cases: DataFrame, *groups: str) -> DataFrame:
    """The groups (null for all of the rest), cases, characters, tp, fp, fn, right_suggestions, valid_spans, precision, recall, suggestion_accuracy, span_validity,
    false_per_1000: found against expected findings, one to one by case, span and type, in their order.

    found: case_id, start, end, type, suggestion, original, nth; expected: case_id, start, end, type, suggestion, nth; cases: case_id, text and the groups. A metric
    without a denominator is null.
    """
    key = ["case_id", "start", "end", "type"]
    order = Window.partitionBy(*key).orderBy("nth")
    number = lambda d, p: d.select(*key, F.struct("*").alias(p)).withColumn("k", F.row_number().over(order.orderBy(F.col(p + ".nth"))))
    met = number(found, "f").join(number(expected, "e"), [*key, "k"], "full").join(cases.select("case_id", "text", *groups), "case_id")
    both = F.col("f").isNotNull() & F.col("e").isNotNull()
    holds = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text")) & (F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")) == F.col("f.original"))
    per = met.groupBy("case_id").agg(F.count_if(both).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"), F.count_if(both & F.col("f.suggestion").eqNullSafe(F.col("e.suggestion"))).alias("right"), F.count_if(F.col("f").isNotNull() & holds).alias("valid"))
    rows = cases.select("case_id", *groups, F.length("text").alias("size")).join(per, "case_id", "left").na.fill(0)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    sums = rows.rollup(*groups).agg(F.count(F.lit(1)).alias("cases"), total("size", "characters"), total("tp", "tp"), total("fp", "fp"), total("fn", "fn"), total("right", "right_suggestions"), total("valid", "valid_spans"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a) if isinstance(a, str) else a, b), 6)
    told = F.col("tp") + F.col("fp")
    return sums.withColumn("precision", rate("tp", told)).withColumn("recall", rate("tp", F.col("tp") + F.col("fn"))).withColumn("suggestion_accuracy", rate("right_suggestions", F.col("tp"))).withColumn("span_validity", rate("valid_spans", told)).withColumn("false_per_1000", rate(F.col("fp") * 1000, F.col("characters")))
