"""Measures of results: ranks of answers, contracts, sweeps, judgements, intervals, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators import evaluation, merge
from webloom.sources.tables import table

# Results that count, resamples of an interval.
LIMIT, RESAMPLES = 10, 500


def expected(pattern: Column, key: Column) -> Column:
    """Whether a result is an expected answer: equal, or starting like one that ends in *."""
    return F.when(F.endswith(pattern, F.lit("*")), F.startswith(key, F.rtrim(pattern, F.lit("*")))).otherwise(pattern == key)


def answer_ranks(spark, d) -> DataFrame:
    """case_id, suite, split, family, rank: place of the first expected answer (grade 2 and more) among the graded ones, null where none is in the first LIMIT."""
    first = evaluation.graded(spark, d).filter(f"grade >= 2 and place <= {LIMIT}").groupBy("case_id").agg(F.min("place").alias("rank"))
    cases = table(spark, d, "audit_cases").filter("case_id is not null and size(relevant) > 0")
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return cases.select("case_id", none("suite"), none("split"), none("family")).join(first, "case_id", "left")


def suite_metrics(spark, d):
    """Cases of each suite and split with their answer first, among the first three, and the mean reciprocal rank."""
    r = answer_ranks(spark, d)
    return r.groupBy("suite", "split").agg(F.count("*").alias("cases"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank") <= 3).alias("top3"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 5).alias("mrr"))


def prefix_answers(spark, d):
    """Answers found when each expected one is given as a prefix or whole."""
    g = evaluation.graded(spark, d).filter("grade >= 2").select("case_id", F.when(F.length("domain") % 2 == 0, F.concat(F.substring("domain", 1, 4), F.lit("*"))).otherwise(F.col("domain")).alias("wanted")).distinct()
    got = evaluation.graded(spark, d).filter(f"place <= {LIMIT}").select("case_id", "domain", "place")
    return g.join(got, "case_id").filter(expected(F.col("wanted"), F.col("domain"))).groupBy("case_id").agg(F.min("place").alias("rank"))


def contract_scores(spark, d):
    """Families whose cases all have an answer in the first three, and cases with a wrong answer (grade 0) before it."""
    g = evaluation.graded(spark, d)
    wrong = g.filter("grade = 0").groupBy("case_id").agg(F.min("place").alias("wrong"))
    r = answer_ranks(spark, d).join(wrong, "case_id", "left")
    ok = F.coalesce(F.col("rank") <= 3, F.lit(False))
    return r.groupBy("family").agg(F.count("*").alias("cases"), F.bool_and(ok).alias("passes"), F.count_if(F.col("wrong") < F.coalesce("rank", F.lit(LIMIT + 1))).alias("wrong_first"))


def recall_losses(spark, d):
    """Where the best answer of each case was lost: not in the records, below the first ten, or not at all."""
    best = evaluation.graded(spark, d).filter("grade >= 2")
    w = Window.partitionBy("case_id").orderBy(F.desc("grade"), "domain")
    one = best.withColumn("n", F.row_number().over(w)).filter("n = 1").select("case_id", "domain", "place")
    known = table(spark, d, "site_items").filter("id is not null").select(F.col("id").alias("domain"), F.lit(True).alias("k")).distinct()
    lost = F.when(F.col("k").isNull(), "no record").when(F.col("place") > LIMIT, "ranked low").otherwise("found")
    return one.join(known, "domain", "left").groupBy(lost.alias("stage")).agg(F.count("*").alias("cases"))


def _moves(spark, d) -> DataFrame:
    """suite, move: what each case's reciprocal rank gains if linking sites order the answers."""
    g = evaluation.graded(spark, d)
    links = merge.signals(spark, d).select("domain", "linking_domains")
    w = Window.partitionBy("case_id").orderBy(F.desc(F.coalesce("linking_domains", F.lit(0))), "domain")
    both = g.join(links, "domain", "left").withColumn("other", F.row_number().over(w)).filter("grade >= 2").groupBy("case_id").agg(F.min("place").alias("a"), F.min("other").alias("b"))
    suites = table(spark, d, "audit_cases").filter("case_id is not null").select("case_id", F.coalesce("suite", F.lit("none")).alias("suite"))
    return both.join(suites, "case_id").select("case_id", "suite", (1 / F.col("b") - 1 / F.col("a")).alias("move"))


def upper_tail(z: Column) -> Column:
    """Share of a normal distribution beyond z, by Abramowitz and Stegun 7.1.26."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def judgements(spark, d):
    """Cases of each suite that gain and lose, the net, and the chance that a change that does nothing moves as far (normal sum of signs)."""
    m = _moves(spark, d).groupBy("suite").agg(F.count_if(F.col("move") > 0).alias("gained"), F.count_if(F.col("move") < 0).alias("lost"), F.sum("move").alias("s"), F.sqrt(F.sum(F.col("move") * F.col("move"))).alias("spread"))
    return m.select("suite", "gained", "lost", F.round("s", 5).alias("net"), F.round(F.when(F.col("spread") > 0, upper_tail(F.abs("s") / F.col("spread"))).otherwise(0.5), 5).alias("chance"))


def sweep(spark, d):
    """The mean reciprocal rank of every suite under each of three weights of popularity against linking sites."""
    g = evaluation.graded(spark, d)
    links = merge.signals(spark, d).select("domain", F.least(F.log1p(F.coalesce("linking_domains", F.lit(0))) / 12, F.lit(1.0)).alias("links"))
    variants = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0)])).alias("weight")
    rows = g.join(links, "domain", "left").select("case_id", "domain", "grade", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("links", F.lit(0.0)).alias("links"), variants)
    by = F.round(F.col("weight") * F.col("score") + (1 - F.col("weight")) * F.col("links"), 6)
    w = Window.partitionBy("case_id", "weight").orderBy(F.desc(by), "domain")
    first = rows.withColumn("place", F.row_number().over(w)).filter("grade >= 2").groupBy("case_id", "weight").agg(F.min("place").alias("rank"))
    suites = table(spark, d, "audit_cases").filter("case_id is not null").select("case_id", F.coalesce("suite", F.lit("none")).alias("suite"))
    return first.join(suites, "case_id").groupBy("suite", "weight").agg(F.count("*").alias("cases"), F.round(F.avg(1 / F.col("rank")), 5).alias("mrr"))


def bootstrap(spark, d):
    """Bounds (the 2.5th and 97.5th parts) of the mean reciprocal rank over RESAMPLES resamples of whole families.

    How often a family is in a resample is a Poisson count, found from a hash, so any executor finds the same; families are summed first.
    """
    f = answer_ranks(spark, d).groupBy("family").agg(F.count("*").alias("n"), F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("s"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "family", "i")), 1, 8), 16, 10).cast("double") / 4294967296.0
    borders = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    times = sum(F.when(u >= b, 1).otherwise(0) for b in borders)
    rows = f.select("family", "n", "s", F.explode(F.sequence(F.lit(1), F.lit(RESAMPLES))).alias("i")).withColumn("t", times)
    means = rows.groupBy("i").agg((F.sum(F.col("s") * F.col("t")) / F.sum(F.col("n") * F.col("t"))).alias("m"))
    at = lambda p: F.round(F.expr(f"percentile_disc({p}) within group (order by m)"), 5)
    return means.agg(at(0.025).alias("low"), at(0.975).alias("high"))


def label_checks(spark, d):
    """Expected answers by whether their site has a record: as written, in another letter case, or not at all."""
    a = table(spark, d, "audit_cases").filter("case_id is not null").select(F.explode("relevant").alias("r")).select(F.when(F.length("r.identity") % 5 == 0, F.upper("r.identity")).otherwise(F.col("r.identity")).alias("i")).filter("i is not null")
    ids = table(spark, d, "site_items").filter("id is not null").select("id").distinct()
    rows = a.join(ids.withColumn("same", F.lit(True)), a.i == ids.id, "left").drop("id").withColumn("low", F.lower("i"))
    rows = rows.join(ids.select(F.lower("id").alias("low"), F.lit(True).alias("case")).distinct(), "low", "left")
    return rows.groupBy(F.when(F.col("same"), "ok").when(F.col("case"), "case").otherwise("missing").alias("label")).agg(F.count("*").alias("answers"))


def latencies(spark, d):
    """Median and 95th part of the events' values by type, of those that are there."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), at(0.5).alias("median"), at(0.95).alias("p95"))


def fact_checks(spark, d):
    """Answers (documents' texts) that hold any of the expected texts, here the title's words, of each source."""
    rows = table(spark, d, "documents").filter("text is not null and length(trim(title)) > 0")
    hit = F.contains(F.lower("text"), F.lower(F.trim(F.substring_index("title", " - ", 1))))
    return rows.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("documents"), F.count_if(hit).alias("hold"))


def graded_gain(spark, d):
    """NDCG of each case in which an expected answer (the first of the list) counts as grade 3."""
    a = table(spark, d, "audit_cases").filter("case_id is not null and size(relevant) > 0").groupBy("case_id").agg(F.max(F.get("relevant", F.lit(0))["identity"]).alias("wanted"))
    g = evaluation.graded(spark, d).join(a, "case_id").withColumn("grade", F.when(F.col("domain") == F.col("wanted"), 3).otherwise(F.col("grade")))
    w = Window.partitionBy("case_id").orderBy(F.desc("grade"), "domain")
    gain = lambda place: F.when(F.col(place) <= LIMIT, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1)).otherwise(0.0)
    sums = g.withColumn("best", F.row_number().over(w)).groupBy("case_id").agg(F.sum(gain("place")).alias("dcg"), F.sum(gain("best")).alias("ideal"))
    return sums.select("case_id", F.when(F.col("ideal") > 0, F.round(F.col("dcg") / F.col("ideal"), 5)).otherwise(0.0).alias("ndcg"))


QUERIES = {f.__name__: f for f in (suite_metrics, prefix_answers, contract_scores, recall_losses, judgements, sweep, bootstrap, label_checks, latencies, fact_checks, graded_gain)}
_G = evaluation._GRADED
_RANKS = f"{_G}, fk AS (SELECT case_id, min(place) AS rank FROM g WHERE grade >= 2 AND place <= {LIMIT} GROUP BY 1), ar AS (SELECT c.case_id, coalesce(suite, 'none') AS suite, coalesce(split, 'none') AS split, coalesce(family, 'none') AS family, rank FROM audit_cases c LEFT JOIN fk ON fk.case_id = c.case_id WHERE c.case_id IS NOT NULL AND len(relevant) > 0)"
_TAIL = lambda x: f"0.5 * (1 / (1 + 0.3275911 * ({x}) / sqrt(2))) * (0.254829592 + (1 / (1 + 0.3275911 * ({x}) / sqrt(2))) * (-0.284496736 + (1 / (1 + 0.3275911 * ({x}) / sqrt(2))) * (1.421413741 + (1 / (1 + 0.3275911 * ({x}) / sqrt(2))) * (-1.453152027 + (1 / (1 + 0.3275911 * ({x}) / sqrt(2))) * 1.061405429)))) * exp(-({x}) * ({x}) / 2)"
_BORDERS = " + ".join(f"CASE WHEN u >= {b} THEN 1 ELSE 0 END" for b in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676))
SQL = {
    "suite_metrics": f"WITH {_RANKS} SELECT suite, split, count(*) AS cases, count(*) FILTER (rank = 1) AS top1, count(*) FILTER (rank <= 3) AS top3, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 5) AS mrr FROM ar GROUP BY 1, 2",
    "prefix_answers": f"WITH {_G}, w AS (SELECT DISTINCT case_id, CASE WHEN length(domain) % 2 = 0 THEN domain[:4] || '*' ELSE domain END AS wanted FROM g WHERE grade >= 2) SELECT w.case_id, min(place) AS rank FROM w JOIN g ON g.case_id = w.case_id AND place <= {LIMIT} AND (wanted = domain OR (suffix(wanted, '*') AND starts_with(domain, rtrim(wanted, '*')))) GROUP BY 1",
    "contract_scores": f"WITH {_RANKS}, wr AS (SELECT case_id, min(place) AS wrong FROM g WHERE grade = 0 GROUP BY 1) SELECT family, count(*) AS cases, bool_and(coalesce(rank <= 3, false)) AS passes, count(*) FILTER (wrong < coalesce(rank, {LIMIT + 1})) AS wrong_first FROM ar LEFT JOIN wr USING (case_id) GROUP BY 1",
    "recall_losses": f"WITH {_G}, o AS (SELECT * FROM (SELECT case_id, domain, place, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, domain) AS n FROM g WHERE grade >= 2) WHERE n = 1) SELECT CASE WHEN domain NOT IN (SELECT id FROM site_items WHERE id IS NOT NULL) THEN 'no record' WHEN place > {LIMIT} THEN 'ranked low' ELSE 'found' END AS stage, count(*) AS cases FROM o GROUP BY 1",
    "judgements": f"WITH {_G}, m AS (SELECT case_id, 1.0::DOUBLE / min(other) - 1.0::DOUBLE / min(place) AS mv FROM g WHERE grade >= 2 GROUP BY 1), j AS (SELECT coalesce(suite, 'none') AS suite, count(*) FILTER (mv > 0) AS gained, count(*) FILTER (mv < 0) AS lost, sum(mv) AS sm, sqrt(sum(mv * mv)) AS spread FROM m JOIN audit_cases USING (case_id) GROUP BY 1) SELECT suite, gained, lost, round(sm, 5) AS net, round(CASE WHEN spread > 0 THEN {_TAIL('abs(sm) / spread')} ELSE 0.5 END, 5)::DOUBLE AS chance FROM j",
    "sweep": f"WITH {_G}, v AS (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS weight), x2 AS (SELECT case_id, g.domain, grade, weight, round(weight * coalesce(round(sc.score, 5), 0) + (1 - weight) * least(ln(1 + coalesce(g.l, 0)) / 12, 1) * CASE WHEN s.domain IS NULL THEN 0 ELSE 1 END, 6) AS b FROM g LEFT JOIN sc ON sc.domain = g.domain LEFT JOIN s ON s.domain = g.domain, v), r AS (SELECT *, row_number() OVER (PARTITION BY case_id, weight ORDER BY b DESC, domain) AS pl FROM x2), f1 AS (SELECT case_id, weight, min(pl) AS rank FROM r WHERE grade >= 2 GROUP BY 1, 2) SELECT coalesce(suite, 'none') AS suite, weight, count(*) AS cases, round(avg(1.0::DOUBLE / rank), 5) AS mrr FROM f1 JOIN audit_cases USING (case_id) GROUP BY 1, 2",
    "bootstrap": f"WITH {_RANKS}, fm AS (SELECT family, count(*) AS n, sum(coalesce(1.0::DOUBLE / rank, 0)) AS sm FROM ar GROUP BY 1), ri AS (SELECT family, n, sm, unnest(range(1, {RESAMPLES + 1})) AS i FROM fm), ru AS (SELECT *, ('0x' || md5(family || '|' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM ri), rt AS (SELECT *, {_BORDERS} AS t FROM ru), mm AS (SELECT i, sum(sm * t) / sum(n * t) AS m FROM rt GROUP BY 1) SELECT round(quantile_disc(m, 0.025), 5) AS low, round(quantile_disc(m, 0.975), 5) AS high FROM mm",
    "label_checks": "WITH x AS (SELECT unnest(relevant) AS r FROM audit_cases WHERE case_id IS NOT NULL), a AS (SELECT CASE WHEN length(r.identity) % 5 = 0 THEN upper(r.identity) ELSE r.identity END AS i FROM x), ids AS (SELECT DISTINCT id FROM site_items WHERE id IS NOT NULL) SELECT CASE WHEN i IN (SELECT id FROM ids) THEN 'ok' WHEN lower(i) IN (SELECT lower(id) FROM ids) THEN 'case' ELSE 'missing' END AS label, count(*) AS answers FROM a WHERE i IS NOT NULL GROUP BY 1",
    "latencies": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "fact_checks": "SELECT coalesce(source, 'none') AS source, count(*) AS documents, count(*) FILTER (contains(lower(text), lower(trim(string_split(title, ' - ')[1])))) AS hold FROM documents WHERE text IS NOT NULL AND length(trim(title)) > 0 GROUP BY 1",
    "graded_gain": f"WITH {_G}, wa AS (SELECT case_id, max(relevant[1].identity) AS wanted FROM audit_cases WHERE case_id IS NOT NULL AND len(relevant) > 0 GROUP BY 1), g3 AS (SELECT case_id, domain, place, CASE WHEN domain = wanted THEN 3 ELSE grade END AS grade FROM g JOIN wa USING (case_id)), g4 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, domain) AS bst FROM g3), t AS (SELECT case_id, sum(CASE WHEN place <= {LIMIT} THEN (power(2.0, grade) - 1) / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN bst <= {LIMIT} THEN (power(2.0, grade) - 1) / log2(bst + 1) ELSE 0 END) AS ideal FROM g4 GROUP BY 1) SELECT case_id, CASE WHEN ideal > 0 THEN round(dcg / ideal, 5) ELSE 0 END AS ndcg FROM t",
}
