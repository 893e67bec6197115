"""Streams over the event log: windows, folds into kept state, journals, joins within an interval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import usage
from webloom.plans.lineage import shared_dir

# Days that a batch may be old and ahead, days of a judgement, and of a lead's life.
OLD_DAYS, AHEAD_DAYS, JUDGE_DAYS, LEAD_DAYS = 7, 1, 2, 30
#: Files of the log that a micro-batch takes, and parts that the log is cut into for the queries.
FILES, PARTS = 1, 4
#: Rows of a journal from which it is folded into its base.
COMPACT_ROWS = 400


def _stream(spark, d) -> DataFrame:
    """The event table as a file stream; its schema is that of the file, no data is read for it."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)


def _cut_stream(spark, d, *columns: str) -> DataFrame:
    """The log as a stream of several files, one a micro-batch, in any order: for folds that don't depend on it."""
    e = spark.read.parquet(f"{d}/events.parquet")
    path = f"{shared_dir(spark)}/webloom-log-{uuid.uuid4().hex}"
    e.repartitionByRange(PARTS, "ts").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def _run(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all there is; each micro-batch's result is written whole under its number. In complete mode the last one counts, else all do."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"
    done = []

    def write(batch: DataFrame, number: int) -> None:  # the same number writes the same files again after a failure
        batch.write.mode("overwrite").parquet(f"{at}/result/{number}")
        done.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{at}/result/{max(done)}" if mode == "complete" else f"{at}/result/*")


def fold(stream: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """The latest row of each key over all micro-batches: each folds into the state that the former one left, under a path of its own number.

    A batch that is run again reads the state of the one before it and writes its own anew, so a failure changes nothing. Rows of a null key
    are left out.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"
    done = []

    def merge(batch: DataFrame, number: int) -> None:
        before = [n for n in done if n < number]
        rows = batch.filter(F.col(key).isNotNull())
        if before:
            rows = rows.unionByName(spark.read.schema(stream.schema).parquet(f"{at}/state/{max(before)}"))
        rest = [c for c in stream.columns if c != key]
        rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*stream.columns).write.mode("overwrite").parquet(f"{at}/state/{number}")
        done.append(number)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/state/{max(done)}") if done else spark.createDataFrame([], stream.schema)


def stream_epoch_counts(spark, d):
    """Events of each day and type, kept up to date as they arrive."""
    e = _cut_stream(spark, d).withColumn("epoch", F.floor(F.unix_timestamp("ts") / usage.DAY))
    return _run(e.groupBy("epoch", "event_type").agg(F.count("*").alias("n")), "complete", "epochs")


def stream_hourly_windows(spark, d):
    """Events in sliding windows of six hours, every hour, given out once the log is a day past a window's end; later events are left out."""
    e = _stream(spark, d).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    w = F.window("at", "6 hours", "1 hour")
    counts = e.groupBy(w, "event_type").agg(F.count("*").alias("n"))
    return _run(counts.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n"), "append", "windows")


def upsert_latest(spark, d):
    """The last event of each user, folded from batch to batch."""
    return fold(_cut_stream(spark, d).select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "latest").select("user_id", "event_id", "event_type")


def stream_sessions(spark, d):
    """Sessions of each user (gaps of half an hour end one) that the log is a day past."""
    e = _stream(spark, d).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    s = e.groupBy(F.session_window("at", f"{usage.GAP_S} seconds").alias("w"), "user_id").agg(F.count("*").alias("events"))
    return _run(s.select("user_id", F.unix_timestamp("w.start").alias("start"), "events"), "append", "sessions")


def stream_distinct_keys(spark, d):
    """First event of each user, type and second: what is delivered twice within a day counts once."""
    e = _stream(spark, d).select("user_id", "event_type", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at")).withWatermark("at", "1 day")
    return _run(e.dropDuplicatesWithinWatermark(["user_id", "event_type", "at"]), "append", "distinct").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_judgements(spark, d):
    """Purchases that an error of the same key and user follows within JUDGE_DAYS, as a join of two streams within an interval."""
    e = lambda kind, p: _stream(spark, d).filter(F.col("event_type") == kind).select(F.col("user_id").alias(f"{p}_user"), F.get_json_object("props", "$.k").cast("int").alias(f"{p}_k"), F.col("ts").cast("timestamp").alias(f"{p}_at")).withWatermark(f"{p}_at", "2 days")
    a, b = e("purchase", "a"), e("error", "b")
    near = (F.col("a_user") == F.col("b_user")) & (F.col("a_k") % 10 == F.col("b_k") % 10) & (F.col("b_at") >= F.col("a_at")) & (F.col("b_at") <= F.col("a_at") + F.expr(f"INTERVAL {JUDGE_DAYS} DAYS"))
    return _run(a.join(b, near).select("a_user", "a_k", "b_k"), "append", "judgements").groupBy(F.col("a_user").alias("user_id")).agg(F.count("*").alias("pairs"))


def fresh_batches(spark, d):
    """Events of each day that are neither older than OLD_DAYS nor ahead by more than AHEAD_DAYS of the day they are told on (here the log's 15th)."""
    e = usage.events(spark, d)
    first = e.agg(F.min("epoch").alias("first"))
    rows = e.crossJoin(F.broadcast(first)).withColumn("told", F.col("first") + 14)  # one row
    return rows.filter(F.col("epoch").between(F.col("told") - OLD_DAYS, F.col("told") + AHEAD_DAYS)).groupBy("epoch").agg(F.count("*").alias("events"))


def journal_state(spark, d):
    """The last event of each user by a base and a journal: every batch is appended to the journal, which is folded into the base once it has COMPACT_ROWS rows; a reader sees both."""
    stream = _cut_stream(spark, d).select("user_id", "event_id", "event_type", "ts")
    at = f"{shared_dir(spark)}/webloom-journal-{uuid.uuid4().hex}"
    held = {"base": None, "journal": []}

    def latest(paths: list[str]) -> DataFrame:
        rows = spark.read.schema(stream.schema).parquet(*paths)
        return rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")

    def append(batch: DataFrame, number: int) -> None:
        path = f"{at}/journal/{number}"
        batch.write.mode("overwrite").parquet(path)
        held["journal"] = [p for p in held["journal"] if p != path] + [path]
        if spark.read.parquet(*held["journal"]).count() >= COMPACT_ROWS:
            new = f"{at}/base/{number}"
            latest([*([held["base"]] if held["base"] else []), *held["journal"]]).write.mode("overwrite").parquet(new)
            held.update(base=new, journal=[])

    stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    paths = [*([held["base"]] if held["base"] else []), *held["journal"]]
    return latest(paths).select("user_id", "event_id", "event_type") if paths else spark.createDataFrame([], stream.schema).select("user_id", "event_id", "event_type")


def live_leads(spark, d):
    """Leads (signups) of the last LEAD_DAYS of the log, the newest three of each reporter and day, one a key."""
    from pyspark.sql import Window

    e = usage.events(spark, d).filter("event_type = 'signup'")
    last = e.agg(F.max("at").alias("last"))
    live = e.crossJoin(F.broadcast(last)).filter(F.col("at") > F.col("last") - LEAD_DAYS * usage.DAY)  # one row
    w = Window.partitionBy("user_id", "epoch").orderBy(F.desc("at"), F.desc("event_id"))
    capped = live.withColumn("n", F.row_number().over(w)).filter("n <= 3")
    return capped.groupBy("k").agg(F.max(F.struct("at", "event_id"))["event_id"].alias("event_id"))


QUERIES = {f.__name__: f for f in (stream_epoch_counts, stream_hourly_windows, upsert_latest, stream_sessions, stream_distinct_keys, stream_judgements, fresh_batches, journal_state, live_leads)}
_LATEST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"
SQL = {
    "stream_epoch_counts": usage.SQL["daily_epoch_counts"],
    "stream_hourly_windows": "WITH e AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS h, unnest(range(0, 6)) AS i FROM events) SELECT (h - i) * 3600 AS start, event_type, count(*) AS n FROM e WHERE (h - i) * 3600 + 21600 <= (SELECT floor(max(epoch(ts)) * 1000) / 1000 - 86400 FROM events) GROUP BY 1, 2",
    "upsert_latest": _LATEST,
    "stream_sessions": f"WITH n AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER v < INTERVAL {usage.GAP_S} SECONDS THEN 0 ELSE 1 END AS new FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM n), g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS events FROM s GROUP BY user_id, s) SELECT user_id, floor(epoch(a))::BIGINT AS start, events FROM g WHERE b + INTERVAL {usage.GAP_S} SECONDS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
    "stream_distinct_keys": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('second', ts) AS at FROM events) GROUP BY 1",
    "stream_judgements": f"WITH {usage._E.replace('event_type, value,', 'event_type, value, ts,')} SELECT a.user_id, count(*) AS pairs FROM e a JOIN e b ON a.user_id = b.user_id AND a.k % 10 = b.k % 10 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {JUDGE_DAYS} DAYS WHERE a.event_type = 'purchase' AND b.event_type = 'error' GROUP BY 1",
    "fresh_batches": f"WITH {usage._E} SELECT epoch, count(*) AS events FROM e WHERE epoch BETWEEN (SELECT min(epoch) FROM e) + 14 - {OLD_DAYS} AND (SELECT min(epoch) FROM e) + 14 + {AHEAD_DAYS} GROUP BY 1",
    "journal_state": _LATEST,
    "live_leads": f"WITH {usage._E}, l AS (SELECT * FROM e WHERE event_type = 'signup'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY sec DESC, event_id DESC) AS n FROM l WHERE sec > (SELECT max(sec) FROM l) - {LEAD_DAYS * usage.DAY}) SELECT k, max({{'a': sec, 'b': event_id}}).b AS event_id FROM r WHERE n <= 3 GROUP BY 1",
}
