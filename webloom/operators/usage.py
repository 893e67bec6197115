"""Clicks, popularity, sessions, experiments, schedules and ledgers over an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.ranking import count_before
from webloom.sources.tables import table

DAY = 86_400
#: Least distinct users of a popular pick, gap that ends a session, longest wait of a retry in days.
THRESHOLD, GAP_S, LONGEST = 2, 1800, 16


def events(spark, d) -> DataFrame:
    """The log with its epoch (days since 1970) and the key inside props."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", "ts", F.unix_timestamp("ts").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k")).withColumn("epoch", F.floor(F.col("at") / DAY))


def daily_epoch_counts(spark, d):
    return events(spark, d).groupBy("epoch", "event_type").agg(F.count("*").alias("n"))


def weekly_tally(spark, d):
    """Picks of each week by key, from THRESHOLD users on."""
    week = F.floor(F.col("epoch") / 7)
    picks = events(spark, d).filter("event_type = 'click'").groupBy(week.alias("week"), "k").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("picks"))
    return picks.filter(F.col("users") >= THRESHOLD)


def popularity_share(spark, d):
    e = events(spark, d).filter("event_type in ('view', 'click')").groupBy("k").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"))
    return e.select("k", "clicks", "views", F.round((F.col("clicks") + 0.5) / (F.col("clicks") + F.col("views") + 1), 5).alias("share"))


def sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = events(spark, d).withColumn("new", F.when(F.col("at") - F.lag("at").over(w) <= GAP_S, 0).otherwise(1))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("events"), (F.max("at") - F.min("at")).alias("seconds"))


def arm(user) -> F.Column:
    return F.when((user * 2654435761) % 100 < 50, "new").otherwise("old")


def experiment_compare(spark, d):
    """Click rate and its standard error in both arms, users assigned by a hash of their id."""
    e = events(spark, d).filter("event_type in ('view', 'click')").groupBy(arm(F.col("user_id")).alias("arm")).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "click").cast("double")).alias("p"))
    return e.select("arm", "n", F.round("p", 5).alias("rate"), F.round(F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), 6).alias("error"))


def passed_over(spark, d):
    """Views that were followed by no click of the same user within a minute."""
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    nexts = e.withColumn("then", F.lead("event_type").over(w)).withColumn("gap", F.lead("at").over(w) - F.col("at"))
    seen = nexts.filter("event_type = 'view'")
    return seen.groupBy("k").agg(F.count("*").alias("views"), F.count_if(~((F.col("then") == "click") & (F.col("gap") <= 60)) | F.col("then").isNull()).alias("passed"))


def retry_backoff(spark, d):
    """When each failed crawl is tried again: a day, doubled with every failure in a row, at most LONGEST days."""
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = e.withColumn("good", F.count_if(F.col("event_type") != "error").over(w)).filter("event_type = 'error'")
    r = Window.partitionBy("user_id", "good").orderBy("at", "event_id")
    failures = F.row_number().over(r)
    return runs.withColumn("failures", failures).select("event_id", "failures", (F.col("at") + DAY * F.least(F.pow(F.lit(2), F.col("failures") - 1), F.lit(LONGEST))).cast("long").alias("next_at"))


def credits_running(spark, d):
    w = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    return events(spark, d).select("event_id", "user_id", F.sum(F.when(F.col("event_type") == "purchase", -cents).otherwise(cents)).over(w).alias("balance"))


def headline_retention(spark, d):
    """The newest ten signups of each key in the last week of the log."""
    e = events(spark, d).filter("event_type = 'signup'")
    last = events(spark, d).agg(F.max("at").alias("last"))
    w = Window.partitionBy("k").orderBy(F.desc("at"), "event_id")
    return e.crossJoin(F.broadcast(last)).filter(F.col("at") > F.col("last") - 7 * DAY).withColumn("place", F.row_number().over(w)).filter("place <= 10").select("k", "event_id", "place")  # one row


def crawl_agreement(spark, d):
    """Pairs of a purchase and an error of one key within two days, counted by exact ranks in time: no pair is made, whatever a key's share of the log."""
    e = events(spark, d).filter("k is not null")
    error = e.filter("event_type = 'error'").select("k", F.col("at").alias("t"), F.lit(1).alias("o"), "event_id", F.lit(1).alias("n"), F.lit(0).alias("sign"))
    ends = F.explode(F.array(F.struct((F.col("at") - 2 * DAY).alias("t"), F.lit(0).alias("o"), F.lit(-1).alias("sign")), F.struct((F.col("at") + 2 * DAY).alias("t"), F.lit(2).alias("o"), F.lit(1).alias("sign")))).alias("x")
    probe = e.filter("event_type = 'purchase'").select("k", "event_id", ends).select("k", "x.t", "x.o", "event_id", F.lit(0).alias("n"), "x.sign")
    counted = count_before(error.union(probe), ["k"], ["t", "o", "event_id"], "n", "before")
    return counted.groupBy("k").agg(F.sum(F.col("sign") * F.col("before")).alias("pairs")).filter("pairs > 0")


QUERIES = {f.__name__: f for f in (daily_epoch_counts, weekly_tally, popularity_share, sessions, experiment_compare, passed_over, retry_backoff, credits_running, headline_retention, crawl_agreement)}
_E = "e AS (SELECT event_id, user_id, event_type, value, floor(epoch(ts))::BIGINT AS sec, (props->>'$.k')::INT AS k, floor(floor(epoch(ts)) / 86400)::BIGINT AS epoch FROM events)"
SQL = {
    "daily_epoch_counts": f"WITH {_E} SELECT epoch, event_type, count(*) AS n FROM e GROUP BY 1, 2",
    "weekly_tally": f"WITH {_E} SELECT floor(epoch / 7)::BIGINT AS week, k, count(DISTINCT user_id) AS users, count(*) AS picks FROM e WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= {THRESHOLD}",
    "popularity_share": f"WITH {_E} SELECT k, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, round((count(*) FILTER (event_type = 'click') + 0.5) / (count(*) + 1), 5) AS share FROM e WHERE event_type IN ('view', 'click') GROUP BY 1",
    "sessions": f"WITH {_E}, n AS (SELECT *, CASE WHEN sec - lag(sec) OVER w <= {GAP_S} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS session FROM n) SELECT user_id, session::BIGINT AS session, count(*) AS events, max(sec) - min(sec) AS seconds FROM s GROUP BY 1, 2",
    "experiment_compare": f"WITH {_E}, a AS (SELECT CASE WHEN (user_id * 2654435761) % 100 < 50 THEN 'new' ELSE 'old' END AS arm, count(*) AS n, avg((event_type = 'click')::INT) AS p FROM e WHERE event_type IN ('view', 'click') GROUP BY 1) SELECT arm, n, round(p, 5) AS rate, round(sqrt(p * (1 - p) / n), 6) AS error FROM a",
    "passed_over": f"WITH {_E}, n AS (SELECT *, lead(event_type) OVER w AS nxt, lead(sec) OVER w - sec AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)) SELECT k, count(*) AS views, count(*) FILTER (NOT coalesce(nxt = 'click' AND gap <= 60, false)) AS passed FROM n WHERE event_type = 'view' GROUP BY 1",
    "retry_backoff": f"WITH {_E}, g AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS good FROM e), f AS (SELECT event_id, sec, row_number() OVER (PARTITION BY user_id, good ORDER BY sec, event_id) AS failures FROM g WHERE event_type = 'error') SELECT event_id, failures, (sec + {DAY} * least(power(2, failures - 1), {LONGEST}))::BIGINT AS next_at FROM f",
    "credits_running": f"WITH {_E} SELECT event_id, user_id, (sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS balance FROM e",
    "headline_retention": f"WITH {_E}, r AS (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY sec DESC, event_id) AS place FROM e WHERE event_type = 'signup' AND sec > (SELECT max(sec) FROM e) - {7 * DAY}) SELECT * FROM r WHERE place <= 10",
    "crawl_agreement": f"WITH {_E} SELECT a.k, count(*) AS pairs FROM e a JOIN e b ON a.k = b.k AND abs(a.sec - b.sec) <= {2 * DAY} WHERE a.event_type = 'purchase' AND b.event_type = 'error' GROUP BY 1",
}
