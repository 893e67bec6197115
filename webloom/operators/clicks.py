"""Clicks, their bias by place, labels, bonuses, tastes, agreement of crawlers, allowances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators import usage
from webloom.operators.strings import jaccard
from webloom.plans.lineage import keep
from webloom.sources.tables import table

# Places of a page, largest weight of a click, least chance of a look, rounds and clicks of an estimate.
PLACES, MAX_WEIGHT, MIN_EXAMINE, EM_ROUNDS, MIN_CLICKS = 10, 5.0, 0.05, 200, 100
#: Kinds of groups up to which the estimate is made in one place.
KINDS = 100_000
# Bonus of a site opened before, for the same query and for another one; of taste at most; and parts of a learned place.
OPENED_SAME, OPENED, TASTE, FOLD, OPEN_FROM, SHOWN = 0.3, 0.05, 0.15, 0.2, 0.5, 3
# Days of the agreement window and of a judgement, observers of a quorum, judgements before distrust, least share of agreement.
WINDOW_DAYS, JUDGE_DAYS, QUORUM, JUDGED, TRUST_SHARE = 14, 2, 2, 10, 0.5
# Reports a day, and requests of an allowance with the seconds in which one comes back.
REPORTS_DAY, ALLOWANCE, REFILL_S = 8, 5, 600


def impressions(spark, d) -> DataFrame:
    """query, domain, place (from 0), shown, opened: the events as impressions; the key inside props and the day make the query, users are sites."""
    e = usage.events(spark, d).filter("event_type in ('view', 'click') and k is not null")
    rows = e.select((F.col("k") * 4 + F.col("epoch") % 4).alias("query"), (F.col("user_id") % 7).alias("domain"), (F.col("event_id") % 4).cast("int").alias("place"), "event_type")
    return rows.groupBy("query", "domain", "place").agg(F.count("*").alias("shown"), F.count_if(F.col("event_type") == "click").alias("opened"))


def _few(kinds: list, prior: list[float]) -> list[float]:
    """The estimate over kinds of groups: rows of `at`, their places with counts, and n, the groups alike."""
    shown, opened = np.zeros((2, len(kinds), PLACES))
    for i, r in enumerate(kinds):
        for x in r["at"]:
            shown[i, x["place"]], opened[i, x["place"]] = x["shown"], x["opened"]
    n = np.array([r["n"] for r in kinds], dtype=float)[:, None]
    e, w, there = np.array(prior), np.full((len(kinds), 1), 0.5), shown.sum(axis=0) > 0
    for _ in range(EM_ROUNDS):
        none, missed = np.maximum(1 - e * w, 1e-9), shown - opened
        looked = (n * (opened + missed * e * (1 - w) / none)).sum(axis=0)
        new = ((opened + missed * (1 - e) * w / none).sum(axis=1, keepdims=True) + 0.5) / (shown.sum(axis=1, keepdims=True) + 1)
        at = np.where(there, looked / np.maximum((n * shown).sum(axis=0), 1e-9), e)
        change = max(np.abs(new - w).max(), np.abs(at - e).max())
        e, w = at, new
        if change < 1e-6:
            break
    return [float(x) for x in np.clip(e / e[0], MIN_EXAMINE, 1.0)]


def position_bias(counts: DataFrame) -> DataFrame:
    """place, examine: how likely each place is looked at, the first being 1, by expectation maximisation over (query, domain, place, shown, opened).

    Only a query and site shown at two places tells a place apart from a result. Fewer than MIN_CLICKS clicks of such give the prior
    1 / (place + 1). The state of a round is one number a query and site, written each round; the places' sums are observed as it is written.
    """
    spark = counts.sparkSession
    prior = [1 / (k + 1) for k in range(PLACES)]
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("place", "shown", F.least("opened", "shown").alias("opened")))), lambda x: x)  # one entry a place
    groups = counts.filter(f"shown > 0 and place between 0 and {PLACES - 1}").groupBy("query", "domain").agg(pairs.alias("at")).filter(F.size("at") >= 2)
    state = keep(groups.withColumn("w", F.lit(0.5)))
    clicks = state.agg(F.sum(F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x["opened"]))).first()[0] or 0
    if clicks < MIN_CLICKS:
        return spark.createDataFrame(list(enumerate(prior)), "place int, examine double")
    kinds = state.groupBy("at").agg(F.count("*").alias("n"))
    if kinds.count() <= KINDS:  # groups of equal counts move alike: few kinds are counted here, with the same steps
        return spark.createDataFrame(list(enumerate(_few(kinds.collect(), prior))), "place int, examine double")
    examine = list(prior)
    for _ in range(EM_ROUNDS):
        e = lambda x: F.get(F.array(*[F.lit(v) for v in examine]), x["place"])  # noqa: E731, B023
        missed = lambda x: (x["shown"] - x["opened"]).cast("double")
        none = lambda x: F.greatest(1 - e(x) * F.col("old"), F.lit(1e-9))  # noqa: E731, B023
        want = F.aggregate("at", F.lit(0.0), lambda s, x: s + x["opened"] + missed(x) * (1 - e(x)) * F.col("old") / none(x))  # noqa: B023
        shown = F.aggregate("at", F.lit(0.0), lambda s, x: s + x["shown"])
        looked = lambda k: F.aggregate(F.filter("at", lambda x: x["place"] == k), F.lit(0.0), lambda s, x: s + x["opened"] + missed(x) * e(x) * (1 - F.col("old")) / none(x))  # noqa: E731, B023
        seen = lambda k: F.aggregate(F.filter("at", lambda x: x["place"] == k), F.lit(0.0), lambda s, x: s + x["shown"])
        rows = state.withColumnRenamed("w", "old").withColumn("w", (want + 0.5) / (shown + 1))
        watch = Observation()
        sums = [F.sum(looked(k)).alias(f"l{k}") for k in range(PLACES)] + [F.sum(seen(k)).alias(f"s{k}") for k in range(PLACES)]
        state = keep(rows.observe(watch, F.max(F.abs(F.col("w") - F.col("old"))).alias("change"), *sums)).drop("old")
        got, change = watch.get, watch.get["change"] or 0.0
        for k in range(PLACES):
            if got[f"s{k}"]:
                new = got[f"l{k}"] / got[f"s{k}"]
                change, examine[k] = max(change, abs(new - examine[k])), new
        if change < 1e-6:
            break
    out = [(k, min(max(x / examine[0], MIN_EXAMINE), 1.0)) for k, x in enumerate(examine)]
    return spark.createDataFrame(out, "place int, examine double")


def fitted_bias(spark, d):
    return position_bias(impressions(spark, d)).select("place", F.round("examine", 4).alias("examine"))


def click_labels(spark, d):
    """How much each site is wanted for each query: clicks, each weighed by how rarely its place is looked at (prior, MAX_WEIGHT at most), a time shown."""
    weight = F.least(F.col("place") + 1.0, F.lit(MAX_WEIGHT))
    g = impressions(spark, d).groupBy("query", "domain").agg(F.sum("shown").alias("shown"), F.sum("opened").alias("opened"), F.sum(weight * F.col("opened")).alias("weighed"))
    return g.select("query", "domain", "shown", "opened", F.round(F.least(F.col("weighed") / F.col("shown"), F.lit(1.0)), 6).alias("wanted"))


def clear_answers(spark, d):
    """The site that each query's clicks are clearly after: opened twice and wanted twice as much as the next."""
    w = Window.partitionBy("query").orderBy(F.desc("wanted"), "domain")
    rows = click_labels(spark, d).withColumn("next", F.coalesce(F.lead("wanted").over(w), F.lit(0.0))).withColumn("n", F.row_number().over(w))
    return rows.filter((F.col("n") == 1) & (F.col("opened") >= 2) & (F.col("wanted") > 0) & (F.col("wanted") >= 2 * F.col("next"))).select("query", "domain")


def history_bonuses(spark, d):
    """Bonus of each site for each case's query, if the sites of the list of the same words were opened before: OPENED_SAME for the same query, else by shared words."""
    lists = table(spark, d, "candidate_lists").filter("query is not null and site_id % 50 = 0").select(F.col("query").alias("was"), "site_id").distinct()
    now = table(spark, d, "candidate_lists").filter("query is not null").select("query").distinct()
    words = lists.select("was", "site_id", F.explode(F.array_distinct(T.words(F.col("was")))).alias("word"))
    meets = words.join(now.select("query", F.explode(F.array_distinct(T.words(F.col("query")))).alias("word")), "word").select("query", "was", "site_id").distinct()
    alike = jaccard(F.col("query"), F.col("was"))
    bonus = F.when(F.lower("query") == F.lower("was"), OPENED_SAME).otherwise(F.least(F.greatest(F.lit(OPENED), OPENED_SAME * alike), F.lit(OPENED_SAME)))
    return meets.groupBy("query", "site_id").agg(F.round(F.max(bonus), 5).alias("bonus"))


def learned_places(spark, d):
    """Keys whose results are folded (opened in less than FOLD of the times shown) or opened from the start, from SHOWN times on."""
    c = impressions(spark, d).groupBy("query").agg(F.sum("shown").alias("shown"), F.sum("opened").alias("opened"))
    rate = F.col("opened") / F.col("shown")
    return c.filter(F.col("shown") >= SHOWN).select("query", F.when(rate < FOLD, "fold").when(rate >= OPEN_FROM, "open").otherwise("plain").alias("place"))


def tastes(spark, d):
    """What a site's results gain over the others' by their clicks, only beyond twice the error, TASTE at most."""
    c = impressions(spark, d).groupBy("domain").agg(F.sum("shown").alias("n"), F.sum("opened").alias("c"))
    whole = c.agg(F.sum("n").alias("all_n"), F.sum("c").alias("all_c"))
    r = c.crossJoin(F.broadcast(whole)).select("domain", "n", (F.col("c") / F.col("n")).alias("p"), (F.col("all_n") - F.col("n")).alias("m"), ((F.col("all_c") - F.col("c")) / (F.col("all_n") - F.col("n"))).alias("q"))  # one row
    error = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + F.col("q") * (1 - F.col("q")) / F.col("m"))
    gap = F.col("p") - F.col("q")
    beyond = F.signum(gap) * F.greatest(F.abs(gap) - 2 * error, F.lit(0.0))
    return r.select("domain", F.round(F.greatest(F.least(beyond, F.lit(TASTE)), F.lit(-TASTE)), 5).alias("taste"))


def arm_difference(spark, d):
    """Difference of the arms' click rates with its error and 95 % bounds; none below 100 searches in an arm."""
    e = usage.experiment_compare(spark, d).groupBy().pivot("arm", ["new", "old"]).agg(F.first("n").alias("n"), F.first("rate").alias("p"))
    error = F.sqrt(F.col("new_p") * (1 - F.col("new_p")) / F.col("new_n") + F.col("old_p") * (1 - F.col("old_p")) / F.col("old_n"))
    rows = e.filter("new_n >= 100 and old_n >= 100").select(F.round(F.col("new_p") - F.col("old_p"), 5).alias("difference"), F.round(error, 5).alias("error"))
    return rows.select("difference", "error", F.round(F.col("difference") - 1.96 * F.col("error"), 5).alias("low"), F.round(F.col("difference") + 1.96 * F.col("error"), 5).alias("high"))


def _observations(spark, d) -> DataFrame:
    """domain, crawler, at, title: who saw which title on a homepage; crawlers are the remainders of the reading's id, and times are folded into ten days."""
    meta = table(spark, d, "homepage_meta").filter("domain is not null and title is not null and fetched_at is not null")
    return meta.select("domain", (F.col("meta_id") % 5).alias("crawler"), (F.unix_timestamp("fetched_at") % (10 * usage.DAY)).alias("at"), "title")


def agreements(spark, d):
    """Judgements of two crawlers' readings of one site within JUDGE_DAYS: whether their titles have three fourths of their words in common."""
    o = _observations(spark, d)
    a = o.select("domain", F.col("crawler").alias("a"), F.col("at").alias("at_a"), F.col("title").alias("title_a"))
    near = a.join(o, "domain").filter((F.col("a") != F.col("crawler")) & (F.abs(F.col("at_a") - F.col("at")) <= JUDGE_DAYS * usage.DAY))
    return near.select("domain", "a", F.col("crawler").alias("b"), (jaccard(F.col("title_a"), F.col("title")) >= 0.75).alias("agree")).groupBy("domain", "a", "b").agg(F.bool_or("agree").alias("agree"))


def crawler_scores(spark, d):
    """How often each crawler agreed, and whether it is trusted: not below TRUST_SHARE of JUDGED judgements and more."""
    j = agreements(spark, d).groupBy(F.col("a").alias("crawler")).agg(F.count("*").alias("judged"), F.count_if("agree").alias("agreed"))
    return j.select("crawler", "judged", "agreed", ((F.col("judged") < JUDGED) | (F.col("agreed") >= TRUST_SHARE * F.col("judged"))).alias("trusted"))


def confirmed_homepages(spark, d):
    """Sites that QUORUM crawlers read alike within WINDOW_DAYS before the newest reading: the title most of them saw."""
    o = _observations(spark, d)
    last = o.groupBy("domain").agg(F.max("at").alias("last"))
    inside = o.join(last, "domain").filter(F.col("at") >= F.col("last") - WINDOW_DAYS * usage.DAY)
    votes = inside.groupBy("domain", T.normalize(F.col("title")).alias("title")).agg(F.count_distinct("crawler").alias("crawlers"))
    w = Window.partitionBy("domain").orderBy(F.desc("crawlers"), "title")
    return votes.withColumn("n", F.row_number().over(w)).filter((F.col("n") == 1) & (F.col("crawlers") >= QUORUM)).select("domain", "title", "crawlers")


def paced_reports(spark, d):
    """The picks reported: each key once a week of its user, REPORTS_DAY a user and day at most, the most picked first."""
    e = usage.events(spark, d).filter("event_type = 'click'").withColumn("week", F.floor(F.col("epoch") / 7))
    first = e.groupBy("user_id", "week", "k").agg(F.min("epoch").alias("epoch"), F.count("*").alias("picks"))
    w = Window.partitionBy("user_id", "epoch").orderBy(F.desc("picks"), "k")
    return first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= REPORTS_DAY).groupBy("epoch").agg(F.count("*").alias("reports"))


def allowances(spark, d):
    """Requests of each user and day that an allowance lets through: ALLOWANCE at once, one back every REFILL_S seconds."""
    e = usage.events(spark, d).groupBy("user_id", "epoch").agg(F.array_sort(F.collect_list("at")).alias("at"))  # the requests of one source and day
    start = F.struct(F.lit(float(ALLOWANCE)).alias("left"), F.lit(0).cast("long").alias("last"), F.lit(0).alias("ok"))
    back = lambda s, x: F.least(s["left"] + F.when(s["last"] > 0, (x - s["last"]) / REFILL_S).otherwise(0.0), F.lit(float(ALLOWANCE)))
    step = lambda s, x: F.struct((back(s, x) - F.when(back(s, x) >= 1, 1.0).otherwise(0.0)).alias("left"), x.alias("last"), (s["ok"] + F.when(back(s, x) >= 1, 1).otherwise(0)).alias("ok"))
    return e.select("user_id", "epoch", F.size("at").alias("asked"), F.aggregate("at", start, step)["ok"].alias("let_through"))


def wanted_pages(spark, d):
    """Keys asked for in the last 30 days of the log, the hundred most often asked."""
    e = usage.events(spark, d).filter("event_type = 'view'")
    last = e.agg(F.max("at").alias("last"))
    rows = e.crossJoin(F.broadcast(last)).filter(F.col("at") > F.col("last") - 30 * usage.DAY)  # one row
    return rows.groupBy("k").agg(F.count("*").alias("asks"), F.max("at").alias("latest")).orderBy(F.desc("asks"), "k").limit(100)


def crawl_schedule(spark, d):
    """The hundred sites crawled next: half of the places, rounded up, to those never read, by name; the rest to those read longest ago."""
    items = table(spark, d, "site_items").filter("id is not null").select("id").distinct()
    read = table(spark, d, "homepage_meta").filter("domain is not null").groupBy(F.col("domain").alias("id")).agg(F.max("fetched_at").alias("read"))
    rows = items.join(read, "id", "left")
    never = rows.filter("read is null").orderBy("id").limit(50).select("id", F.lit("new").alias("why"))
    due = rows.filter("read is not null").orderBy("read", "id").limit(50).select("id", F.lit("due").alias("why"))
    return never.union(due)


def offline_days(spark, d):
    """Days on which nine tenths of twenty attempts and more failed: the crawler itself was cut off, so its sites are tried again."""
    e = usage.events(spark, d).groupBy("epoch", F.floor(F.col("at") / 21600).alias("quarter")).agg(F.count("*").alias("tries"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return e.select("epoch", "quarter", "tries", "failed", ((F.col("tries") >= 20) & (F.col("failed") >= 0.9 * F.col("tries"))).alias("offline"))


def feed_due(spark, d):
    """When each feed (a user's signups) is read next: after half its mean gap, an hour at least, a day at most."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = usage.events(spark, d).filter("event_type = 'signup'").withColumn("gap", F.col("at") - F.lag("at").over(w))
    return e.groupBy("user_id").agg((F.max("at") + F.floor(F.least(F.greatest(F.coalesce(F.avg("gap"), F.lit(float(usage.DAY))) / 2, F.lit(3600.0)), F.lit(float(usage.DAY))))).cast("long").alias("due"))


QUERIES = {f.__name__: f for f in (fitted_bias, click_labels, clear_answers, history_bonuses, learned_places, tastes, arm_difference, agreements, crawler_scores, confirmed_homepages, paced_reports, allowances, wanted_pages, crawl_schedule, offline_days, feed_due)}
_IM = f"{usage._E}, im AS (SELECT k * 4 + epoch % 4 AS query, user_id % 7 AS domain, (event_id % 4)::INT AS place, count(*) AS shown, count(*) FILTER (event_type = 'click') AS opened FROM e WHERE event_type IN ('view', 'click') AND k IS NOT NULL GROUP BY 1, 2, 3)"
_LABELS = f"{_IM}, lb AS (SELECT query, domain, sum(shown)::BIGINT AS shown, sum(opened)::BIGINT AS opened, round(least(sum(least(place + 1.0, {MAX_WEIGHT}) * opened) / sum(shown), 1), 6) AS wanted FROM im GROUP BY 1, 2)"
_JAC = lambda x, y: f"(CASE WHEN len(list_distinct(list_concat({T.words_sql(x)}, {T.words_sql(y)}))) = 0 THEN 0 ELSE len(list_intersect({T.words_sql(x)}, {T.words_sql(y)}))::DOUBLE / len(list_distinct(list_concat({T.words_sql(x)}, {T.words_sql(y)}))) END)"
_OB = "ob AS (SELECT domain, meta_id % 5 AS crawler, floor(epoch(fetched_at))::BIGINT % 864000 AS sec, title FROM homepage_meta WHERE domain IS NOT NULL AND title IS NOT NULL AND fetched_at IS NOT NULL)"
_AG = f"{_OB}, ag AS (SELECT x.domain, x.crawler AS a, y.crawler AS b, bool_or({_JAC('x.title', 'y.title')} >= 0.75) AS agree FROM ob x JOIN ob y ON x.domain = y.domain AND x.crawler <> y.crawler AND abs(x.sec - y.sec) <= {JUDGE_DAYS * usage.DAY} GROUP BY 1, 2, 3)"
SQL = {
    "click_labels": f"WITH {_LABELS} SELECT * FROM lb",
    "clear_answers": f"WITH {_LABELS}, r AS (SELECT *, coalesce(lead(wanted) OVER v, 0) AS nxt, row_number() OVER v AS n FROM lb WINDOW v AS (PARTITION BY query ORDER BY wanted DESC, domain)) SELECT query, domain FROM r WHERE n = 1 AND opened >= 2 AND wanted > 0 AND wanted >= 2 * nxt",
    "history_bonuses": f"WITH l AS (SELECT DISTINCT query AS was, site_id FROM candidate_lists WHERE query IS NOT NULL AND site_id % 50 = 0), q AS (SELECT DISTINCT query FROM candidate_lists WHERE query IS NOT NULL) SELECT query, site_id, round(max(CASE WHEN lower(query) = lower(was) THEN {OPENED_SAME} ELSE least(greatest({OPENED}, {OPENED_SAME} * {_JAC('query', 'was')}), {OPENED_SAME}) END), 5)::DOUBLE AS bonus FROM l JOIN q ON list_has_any({T.words_sql('query')}, {T.words_sql('was')}) GROUP BY 1, 2",
    "learned_places": f"WITH {_IM}, c AS (SELECT query, sum(shown) AS shown, sum(opened) AS opened FROM im GROUP BY 1) SELECT query, CASE WHEN opened / shown < {FOLD} THEN 'fold' WHEN opened / shown >= {OPEN_FROM} THEN 'open' ELSE 'plain' END AS place FROM c WHERE shown >= {SHOWN}",
    "tastes": f"WITH {_IM}, c AS (SELECT domain, sum(shown) AS n, sum(opened) AS c FROM im GROUP BY 1), r AS (SELECT domain, n, c / n AS p, (SELECT sum(n) FROM c) - n AS m, ((SELECT sum(c) FROM c) - c) / ((SELECT sum(n) FROM c) - n) AS q FROM c) SELECT domain, round(greatest(least(sign(p - q) * greatest(abs(p - q) - 2 * sqrt(p * (1 - p) / n + q * (1 - q) / m), 0), {TASTE}), -{TASTE}), 5)::DOUBLE AS taste FROM r",
    "arm_difference": f"WITH x AS ({usage.SQL['experiment_compare']}), y AS (SELECT a.rate AS p, a.n AS n, b.rate AS q, b.n AS m FROM x a, x b WHERE a.arm = 'new' AND b.arm = 'old'), z AS (SELECT round(p - q, 5) AS difference, round(sqrt(p * (1 - p) / n + q * (1 - q) / m), 5) AS error FROM y WHERE n >= 100 AND m >= 100) SELECT difference, error, round(difference - 1.96::DOUBLE * error, 5) AS low, round(difference + 1.96::DOUBLE * error, 5) AS high FROM z",
    "agreements": f"WITH {_AG} SELECT * FROM ag",
    "crawler_scores": f"WITH {_AG}, j AS (SELECT a AS crawler, count(*) AS judged, count(*) FILTER (agree) AS agreed FROM ag GROUP BY 1) SELECT *, judged < {JUDGED} OR agreed >= {TRUST_SHARE} * judged AS trusted FROM j",
    "confirmed_homepages": f"WITH {_OB}, i AS (SELECT *, max(sec) OVER (PARTITION BY domain) AS last FROM ob), v AS (SELECT domain, array_to_string({T.words_sql('title')}, ' ') AS title, count(DISTINCT crawler) AS crawlers FROM i WHERE sec >= last - {WINDOW_DAYS * usage.DAY} GROUP BY 1, 2) SELECT domain, title, crawlers FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY crawlers DESC, title) AS n FROM v) WHERE n = 1 AND crawlers >= {QUORUM}",
    "paced_reports": f"WITH {usage._E}, f AS (SELECT user_id, epoch // 7 AS week, k, min(epoch) AS epoch, count(*) AS picks FROM e WHERE event_type = 'click' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY picks DESC, k NULLS FIRST) AS n FROM f) SELECT epoch, count(*) AS reports FROM r WHERE n <= {REPORTS_DAY} GROUP BY 1",
    "allowances": f"WITH {usage._E}, g AS (SELECT user_id, epoch, list(sec ORDER BY sec) AS a FROM e GROUP BY 1, 2), s AS (SELECT user_id, epoch, len(a) AS asked, list_reduce(list_prepend({{'l': {float(ALLOWANCE)}::DOUBLE, 't': 0::BIGINT, 'ok': 0}}, list_transform(a, lambda x: {{'l': 0::DOUBLE, 't': x, 'ok': 0}})), lambda s, x: {{'l': least(s.l + CASE WHEN s.t > 0 THEN (x.t - s.t) / {REFILL_S}::DOUBLE ELSE 0 END, {float(ALLOWANCE)}) - CASE WHEN least(s.l + CASE WHEN s.t > 0 THEN (x.t - s.t) / {REFILL_S}::DOUBLE ELSE 0 END, {float(ALLOWANCE)}) >= 1 THEN 1 ELSE 0 END, 't': x.t, 'ok': s.ok + CASE WHEN least(s.l + CASE WHEN s.t > 0 THEN (x.t - s.t) / {REFILL_S}::DOUBLE ELSE 0 END, {float(ALLOWANCE)}) >= 1 THEN 1 ELSE 0 END}}) AS r FROM g) SELECT user_id, epoch, asked, r.ok AS let_through FROM s",
    "wanted_pages": f"WITH {usage._E} SELECT k, count(*) AS asks, max(sec) AS latest FROM e WHERE event_type = 'view' AND sec > (SELECT max(sec) FROM e WHERE event_type = 'view') - {30 * usage.DAY} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "crawl_schedule": "WITH i AS (SELECT DISTINCT id FROM site_items WHERE id IS NOT NULL), r AS (SELECT domain AS id, max(fetched_at) AS read FROM homepage_meta WHERE domain IS NOT NULL GROUP BY 1), j AS (SELECT i.id, read FROM i LEFT JOIN r ON r.id = i.id) SELECT * FROM (SELECT id, 'new' AS why FROM j WHERE read IS NULL ORDER BY id LIMIT 50) UNION ALL SELECT * FROM (SELECT id, 'due' AS why FROM j WHERE read IS NOT NULL ORDER BY read, id LIMIT 50)",
    "offline_days": f"WITH {usage._E}, g AS (SELECT epoch, sec // 21600 AS quarter, count(*) AS tries, count(*) FILTER (event_type = 'error') AS failed FROM e GROUP BY 1, 2) SELECT *, tries >= 20 AND failed >= 0.9 * tries AS offline FROM g",
    "feed_due": f"WITH {usage._E}, g AS (SELECT user_id, sec, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS gap FROM e WHERE event_type = 'signup') SELECT user_id, (max(sec) + floor(least(greatest(coalesce(avg(gap), {float(usage.DAY)}) / 2, 3600), {float(usage.DAY)})))::BIGINT AS due FROM g GROUP BY 1",
}
