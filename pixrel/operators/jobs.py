"""The life of a run as tables: progress stages, admission, time limits, retention, timing history."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pixrel.functions.text import csv_field, iso_time

#: Names of stages for people: fixed values. Others are made from their key.
STAGE_LABELS = {
    "queued": "Queued", "initializing_engine": "Engine startup", "validating_input": "Input validation", "feature_extraction": "Feature extraction", "segmentation": "Segmentation",
    "merge_tree": "Energy merge tree", "cross_scale": "Cross-scale correspondence", "reconstruction": "Reconstruction", "sensitivity": "Sensitivity study",
    "serialization": "Representation export", "analysis_complete": "Engine completion", "uploading_artifacts": "Artifact upload", "finalizing": "Finalization",
}
#: Limits of a run in milliseconds: fixed values. A run has BASE, in the merge tree EXTENSION more at a time up to MOST
#: while a heartbeat is no older than FRESH; a study has VARIANT more for each of VARIANTS variants at most, up to STUDY.
BASE, EXTENSION, MOST, FRESH, VARIANT, STUDY, VARIANTS = 120_000, 30_000, 300_000, 10_000, 60_000, 420_000, 5


def by_job() -> WindowSpec:
    return Window.partitionBy("job").orderBy("now_ms", "seq")


def progress_from_events(events: DataFrame) -> DataFrame:
    """Progress reports (job, seq, stage, percent, now_ms, message) made from the events table."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.least(F.lit(99), F.floor(F.col("value") / 5).cast("int")).alias("percent"), ms.alias("now_ms"), F.col("props").alias("message"))


def stage_islands(progress: DataFrame) -> DataFrame:
    """Runs of reports of one stage: job, island, stage, started, ended, reports, and duration until the next one starts."""
    d = progress.withColumn("__new", F.coalesce((F.lag("stage").over(by_job()) != F.col("stage")).cast("int"), F.lit(1)))
    d = d.withColumn("island", F.sum("__new").over(by_job()))
    i = d.groupBy("job", "island").agg(F.first("stage").alias("stage"), F.min("now_ms").alias("started"), F.max("now_ms").alias("ended"), F.count(F.lit(1)).alias("reports"))
    following = F.lead("started").over(Window.partitionBy("job").orderBy("island"))
    return i.withColumn("duration", F.coalesce(following, F.col("ended")) - F.col("started"))


def running_percent(progress: DataFrame) -> DataFrame:
    """Adds shown: percent never falls, and stays below 100 until the end."""
    return progress.withColumn("shown", F.least(F.max("percent").over(by_job().rowsBetween(Window.unboundedPreceding, 0)), F.lit(99)))


def safe_message(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 280)


def stage_label(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in STAGE_LABELS.items() for x in kv))
    return F.coalesce(known[c], F.array_join(F.transform(F.split(c, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " "))


def stage_messages(progress: DataFrame, last: int = 8) -> DataFrame:
    """job, island, stage, label, place, text, offset_ms: the messages that each interval of a stage keeps, oldest first.

    A message is kept unless it is empty or among those kept just then; beyond last the oldest goes, so that it may
    come again. An interval's first message is kept even if empty. What is kept follows from what was kept before, so
    an interval's reports pass in order, with last messages of state.
    """
    d = progress.withColumn("__new", F.coalesce((F.lag("stage").over(by_job()) != F.col("stage")).cast("int"), F.lit(1)))
    d = d.withColumn("island", F.sum("__new").over(by_job())).withColumn("text", safe_message(F.coalesce("message", F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, started, kept = None, 0, []

        def rows() -> list[tuple]:
            return [(at[0], at[1], at[2], k, text, now - started) for k, (text, now) in enumerate(kept, 1)] if at else []

        for batch in batches:
            out: list[tuple] = []
            for job, island, stage, text, now in zip(*(batch.column(c).to_pylist() for c in ("job", "island", "stage", "text", "now_ms")), strict=True):
                if (job, island, stage) != at:
                    out += rows()
                    at, started, kept = (job, island, stage), now, [(text, now)]
                elif text and all(text != x for x, _ in kept):
                    kept = [*kept, (text, now)][-last:]
            if out:
                yield table(out)
        if at:
            yield table(rows())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["job", "island", "stage", "place", "text", "offset_ms"])

    ordered = d.select("job", "island", "stage", "text", "now_ms", "seq").repartition("job").sortWithinPartitions("job", "now_ms", "seq")
    kept = ordered.mapInArrow(run, "job long, island long, stage string, place int, text string, offset_ms long")
    return kept.withColumn("label", stage_label(F.col("stage")))


def admit(attempts: DataFrame, window_ms: int, most: int) -> DataFrame:
    """attempts (client, seq, now_ms) gain window_start, used and admitted.

    A client's window opens with its first attempt after the one before has run out, and admits most attempts. The
    windows of a client follow from each other, so its attempts pass in order, with a state of two numbers.
    """
    fields = ["client", "seq", "now_ms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, start, used = object(), 0, 0
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for c, now in zip(batch.column("client").to_pylist(), batch.column("now_ms").to_pylist(), strict=True):
                if c != client or now - start >= window_ms:
                    client, start, used = c, now, 0
                ok = used < most
                used += ok
                out.append((start, used, ok))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_())], names=[*fields, "window_start", "used", "admitted"])

    ordered = attempts.select(*fields).repartition("client").sortWithinPartitions("client", "now_ms", "seq")
    return ordered.mapInArrow(run, "client long, seq long, now_ms long, window_start long, used int, admitted boolean")


def in_flight(runs: DataFrame, bucket_ms: int) -> DataFrame:
    """Most runs at once in each time bucket, from (started, ended).

    Starts and ends are summed by bucket first; only the bucket totals pass through one ordered window.
    """
    steps = runs.select(F.explode(F.array(F.struct(F.col("started").alias("at"), F.lit(1).alias("step")), F.struct(F.col("ended").alias("at"), F.lit(-1).alias("step")))).alias("s")).select("s.*").withColumn("bucket", F.expr(f"at div {bucket_ms}"))
    total = steps.groupBy("bucket").agg(F.sum("step").alias("net"))
    opening = total.withColumn("before", F.coalesce(F.sum("net").over(Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = steps.withColumn("here", F.sum("step").over(Window.partitionBy("bucket").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(opening, "bucket").groupBy("bucket").agg(F.max(F.col("before") + F.greatest("here", F.lit(0))).alias("most"))


def silences(progress: DataFrame, startup_ms: int, silence_ms: int) -> DataFrame:
    """Reports after which a job was silent for longer than its limit: the first report has the longer one."""
    k = F.row_number().over(by_job())
    d = progress.withColumns({"__k": k, "silence": F.lead("now_ms").over(by_job()) - F.col("now_ms")})
    limit = F.when(F.col("__k") == 1, startup_ms).otherwise(silence_ms)
    return d.withColumn("limit", limit).filter(F.col("silence") > F.col("limit")).select("job", "seq", "stage", "silence", "limit")


def allowance(variants: Column) -> Column:
    """Milliseconds that a run starts with: a study has more for each of its variants."""
    return F.when(variants > 0, F.least(F.lit(STUDY), F.lit(BASE) + F.least(variants, F.lit(VARIANTS)) * VARIANT)).otherwise(F.lit(BASE)).cast("long")


def budgets(jobs: DataFrame) -> DataFrame:
    """jobs (job, variants, stage, elapsed, heartbeat_age) gain allowance, extended and over.

    In the merge tree a run without variants whose heartbeat is fresh is granted one extension after the other; the
    number that has been granted by now follows from the time that has passed.
    """
    may = (F.col("variants") == 0) & (F.col("stage") == "merge_tree") & (F.col("heartbeat_age") <= FRESH)
    steps = F.greatest(F.lit(0), F.ceil((F.col("elapsed") - BASE + 1) / EXTENSION))
    granted = F.when(may, F.least(F.lit(MOST), F.lit(BASE) + steps * EXTENSION)).otherwise(allowance(F.col("variants")))
    return jobs.withColumn("allowance", granted.cast("long")).withColumn("extended", may & (F.col("elapsed") >= BASE)).withColumn("over", F.col("elapsed") >= F.col("allowance"))


#: Bases of a study's remaining time, with the shares of the projection that bound it: fixed values.
ETA_SHARES = {"sensitivity_variant": (0.35, 1.0), "observed_progress": (0.6, 1.45), "advanced_budget": (0.3, 1.0)}


def eta(jobs: DataFrame) -> DataFrame:
    """jobs (job, status, variants, stage, percent, elapsed, message) gain basis, eta_low and eta_high in milliseconds.

    Only studies that still run and have time left have an estimate: by the variant that the message names in the
    sensitivity stage, by progress from 10 percent on, else by the whole budget. No bound lies above the time left, nor
    below 5 seconds.
    """
    left = F.greatest(F.lit(0), allowance(F.col("variants")) - F.greatest("elapsed", F.lit(0)))
    named = [F.regexp_extract(F.lower("message"), r"variant\s+(\d+)\s+of\s+(\d+)", k).try_cast("long") for k in (1, 2)]
    total = F.greatest(F.lit(1), F.least(F.lit(VARIANTS), F.coalesce(named[1], "variants")))
    current = F.greatest(F.lit(1), F.least(total, F.coalesce(named[0], F.lit(1))))
    basis = F.when(F.col("stage") == "sensitivity", "sensitivity_variant").when(F.col("percent") >= 10, "observed_progress").otherwise("advanced_budget")
    projected = F.when(F.col("stage") == "sensitivity", F.greatest(F.lit(15_000), (total - current + 1) * VARIANT).cast("double")).when(F.col("percent") >= 10, F.greatest(F.lit(15_000.0), F.greatest("elapsed", F.lit(0)) * ((100 - F.col("percent")) / F.greatest("percent", F.lit(1))))).otherwise(F.greatest(F.lit(30_000), F.greatest(F.lit(1), "variants") * VARIANT).cast("double"))
    running = (F.col("variants") > 0) & ~F.col("status").isin("completed", "failed", "cancelled", "expired") & (left > 0)
    j = jobs.withColumns({"__left": left, "__on": running, "basis": F.when(running, basis)})
    j = j.withColumn("__all", F.least(F.col("__left").cast("double"), projected))
    share = lambda k: F.create_map(*(F.lit(x) for n, v in ETA_SHARES.items() for x in (n, v[k])))[F.col("basis")]
    held = lambda k: F.when(F.col("__on"), F.greatest(F.lit(5_000), F.least(F.col("__left"), F.floor(F.col("__all") * share(k) + 0.5))))
    return j.withColumns({"eta_low": held(0).cast("long"), "eta_high": held(1).cast("long")}).drop("__left", "__on", "__all")


#: How a run can end, as its supervisor sees it, and the category of its receipt: fixed values.
FAILURES = {"spawn": "spawn_failure", "budget": "process_budget", "exit": "engine_exit", "malformed": "malformed_completion"}


def failure_receipts(ends: DataFrame, prefix: str = "RUN-") -> DataFrame:
    """A receipt of each failed run from ends (job, outcome, stage, created, ended, spawned, heartbeat, ready), with a token.

    Silence is that of the start-up until the engine is ready, later that of a stage; what no supervisor foresees is
    unexpected. A run that was cancelled or completed has no receipt.
    """
    known = F.create_map(*(F.lit(x) for kv in FAILURES.items() for x in kv))
    silent = F.when(F.col("ready"), "stage_silence").otherwise("startup_silence")
    category = F.when(F.col("outcome") == "silence", silent).otherwise(F.coalesce(known[F.col("outcome")], F.lit("unexpected_failure")))
    foreseen = category != "unexpected_failure"
    seen = lambda c: (F.col(c) & foreseen).alias(c)
    failed = ends.filter(~F.col("outcome").isin("cancelled", "completed"))
    return failed.select("job", category.alias("category"), F.col("stage").alias("last_safe_stage"), F.greatest(F.lit(0), F.col("ended") - F.col("created")).alias("elapsed_ms"), seen("spawned"), seen("heartbeat"), seen("ready"), F.concat(F.lit(prefix), F.col("job").cast("string")).alias("token"))


def latest(manifest: DataFrame) -> DataFrame:
    """The last write of each job wins; groupBy keeps one row a job before the shuffle."""
    return manifest.groupBy("job").agg(F.max_by(F.struct(*(c for c in manifest.columns if c != "job")), F.struct("updated", "seq")).alias("m")).select("job", "m.*")


def revoke(manifest: DataFrame, job: int, owner: int, now: int) -> DataFrame:
    """The job's rows, if owner's, lose payload and access."""
    hit = (F.col("job") == job) & (F.col("owner") == owner) & (F.col("status") != "revoked")
    return manifest.withColumns({"payload": F.when(~hit, F.col("payload")), "revoked_at": F.when(hit, F.lit(now)), "status": F.when(hit, "revoked").otherwise(F.col("status"))})


def history(manifest: DataFrame, owner: int, now: int, most: int) -> DataFrame:
    """An owner's completed and unexpired runs, latest first, 1 to 100 of them."""
    kept = manifest.filter((F.col("owner") == owner) & (F.col("status") == "completed") & (F.col("expires") > now))
    return kept.orderBy(F.desc("updated"), "job").limit(min(max(most, 1), 100))


def upsert(manifest: DataFrame, writes: DataFrame) -> DataFrame:
    """The manifest after writes of the same columns: the last write of a job replaces its row, values it leaves null stay.

    Columns of the manifest that writes lack keep what they have.
    """
    both = manifest.withColumn("__w", F.lit(0)).unionByName(writes.withColumn("__w", F.lit(1)), allowMissingColumns=True)
    order = F.struct("__w", "updated", "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    return both.groupBy("job").agg(*(last(c).alias(c) for c in manifest.columns if c != "job"))


def point_read(manifest: DataFrame, job: object) -> DataFrame:
    return manifest.filter(F.col("job") == job).limit(1)


def restored(manifest: DataFrame, now: int) -> DataFrame:
    """Jobs as their durable rows tell them after a restart: what ran then has failed, what is out of date has expired."""
    status = F.when(F.col("status").isin("queued", "running", "uploading"), "failed").when((F.col("status") == "completed") & (F.col("expires") <= now), "expired").otherwise(F.col("status"))
    return manifest.withColumns({"status": status, "result_available": (F.col("status") == "completed") & (F.col("expires") > now)})


def access(manifest: DataFrame, entries: DataFrame, owner: object, now: int) -> DataFrame:
    """What an owner finds of each of their jobs: from the cache, from the store, or why not. entries: job, stored."""
    j = manifest.join(entries.select("job", F.lit(True).alias("cached")), "job", "left")
    found = F.when(F.col("owner") != owner, "not_found").when(F.col("status") == "revoked", "revoked").when(F.col("expires") <= now, "expired").when(F.col("status") != "completed", "not_ready").when(F.col("cached"), "cache").otherwise("store")
    return j.select("job", found.alias("access"))


def snapshots(entries: DataFrame, ttl: int) -> DataFrame:
    """A cache's accesses (key, seq, now_ms, op: put or get) gain hit, expired: an entry lives ttl after its last put.

    Which put an access sees is the last before it, so that one window a key tells all.
    """
    w = Window.partitionBy("key").orderBy("now_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    stored = F.max(F.when(F.col("op") == "put", F.col("now_ms"))).over(w)
    d = entries.withColumn("__stored", stored)
    fresh = F.col("now_ms") - F.col("__stored") < ttl
    return d.withColumns({"hit": (F.col("op") == "get") & F.coalesce(fresh, F.lit(False)), "expired": (F.col("op") == "get") & F.coalesce(~fresh, F.lit(False))}).drop("__stored")


def timing_csv(records: DataFrame, stages: list[str]) -> DataFrame:
    """line: a record as a line of CSV, every value in quotes; stages name the columns of durations, 0 where a record has none."""
    duration = lambda s: F.coalesce(F.expr(f"aggregate(filter(stages, x -> x.label = {s!r}), cast(null as bigint), (a, x) -> x.duration)"), F.lit(0))
    fields = [F.col("job"), F.when(F.col("completed").isNotNull(), iso_time(F.col("completed"))), F.col("segmentation"), F.col("total"), *(duration(s) for s in stages)]
    return records.select("job", F.concat_ws(",", *map(csv_field, fields)).alias("line"))


def timing_header(stages: list[str]) -> str:
    return ",".join('"' + n.replace('"', '""') + '"' for n in ["job_id", "completed_at", "segmentation", "total_duration_ms", *(f"{s}_ms" for s in stages)])


def timing_json(records: DataFrame) -> DataFrame:
    """One versioned document of all records of an owner, in order; a document is an owner's retained history."""
    body = F.array_sort(F.collect_list(F.struct("job", "completed", "segmentation", "total", "stages")))
    return records.groupBy("owner").agg(F.to_json(F.struct(F.lit("execution-timing-comparison.v1").alias("schema"), body.alias("records"))).alias("document"))


def timing_pivot(islands: DataFrame, stages: list[str]) -> DataFrame:
    """A row a job with the time of each stage, 0 where it has none."""
    wide = islands.groupBy("job").pivot("stage", stages).agg(F.sum("duration"))
    return wide.na.fill(0, stages)


def evict(entries: DataFrame, now: int, ttl: int, capacity: int) -> DataFrame:
    """Cache entries (key, stored) that are neither expired nor beyond the latest capacity ones."""
    return entries.filter(F.col("stored") + ttl > now).orderBy(F.desc("stored"), F.desc("key")).limit(capacity)


def cache_telemetry(lookups: DataFrame, entries: int, capacity: int) -> DataFrame:
    """hits, misses, hit_rate and fill_ratio."""
    return lookups.agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses")).select("hits", "misses", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0).alias("hit_rate"), F.lit(entries / capacity).alias("fill_ratio"))
