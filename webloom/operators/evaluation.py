"""Offline evaluation, spelling statistics and quantized vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators import merge
from webloom.sources.tables import table


def contract_summary(spark, d):
    a = table(spark, d, "audit_cases")
    return a.groupBy(F.coalesce("label_status", F.lit("none")).alias("status"), F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("cases"), F.count_if(F.size("relevant") > 0).alias("with_answers"), F.count_distinct("query").alias("queries"))


def graded(spark, d) -> DataFrame:
    """case_id, identity, grade, place: the graded answers of each case in order of popularity."""
    a = table(spark, d, "audit_cases").filter("case_id is not null").select("case_id", F.explode("relevant").alias("r")).groupBy("case_id", F.col("r.identity").alias("domain")).agg(F.max("r.grade").alias("grade"))
    scores = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("score"))
    w = Window.partitionBy("case_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "domain")
    return a.join(scores, "domain", "left").withColumn("place", F.row_number().over(w))


def ndcg10(spark, d):
    g = graded(spark, d)
    w = Window.partitionBy("case_id").orderBy(F.desc("grade"), "domain")
    gain = lambda place: F.when(F.col(place) <= 10, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1)).otherwise(0.0)
    g = g.withColumn("best", F.row_number().over(w))
    sums = g.groupBy("case_id").agg(F.sum(gain("place")).alias("dcg"), F.sum(gain("best")).alias("ideal"))
    return sums.select("case_id", F.when(F.col("ideal") > 0, F.round(F.col("dcg") / F.col("ideal"), 5)).otherwise(0.0).alias("ndcg"))


def mrr_by_suite(spark, d):
    first = graded(spark, d).filter("grade >= 2").groupBy("case_id").agg(F.min("place").alias("place"))
    a = table(spark, d, "audit_cases").filter("case_id is not null and size(relevant) > 0").select("case_id", F.coalesce("suite", F.lit("none")).alias("suite"))
    return a.join(first, "case_id", "left").groupBy("suite").agg(F.count("*").alias("cases"), F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 5).alias("mrr"))


def judge_counts(spark, d):
    """Cases that gain, lose or keep the place of their best answer if popularity alone gives way to linking sites."""
    g = graded(spark, d)
    links = merge.signals(spark, d).select("domain", "linking_domains")
    w = Window.partitionBy("case_id").orderBy(F.desc(F.coalesce("linking_domains", F.lit(0))), "domain")
    both = g.join(links, "domain", "left").withColumn("other", F.row_number().over(w)).filter("grade >= 2").groupBy("case_id").agg(F.min("place").alias("a"), F.min("other").alias("b"))
    return both.groupBy(F.when(F.col("b") < F.col("a"), "gained").when(F.col("b") > F.col("a"), "lost").otherwise("same").alias("move")).agg(F.count("*").alias("cases"))


def unigrams(spark, d) -> DataFrame:
    """word, n: titles and descriptions that hold each word."""
    w = table(spark, d, "homepage_meta").select(F.explode(F.array_distinct(T.words(F.concat_ws(" ", "title", "description")))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


def unigram_counts(spark, d):
    return unigrams(spark, d)


def quantized(spark, d):
    """Vectors of one byte a value, and what they lose in length."""
    q = F.transform("embedding", lambda x: F.round(x * 127).cast("tinyint"))
    v = table(spark, d, "embeddings").select("vec_id", q.alias("q"))
    total = F.aggregate("q", F.lit(0), lambda s, x: s + x.cast("int"))
    squares = F.aggregate("q", F.lit(0), lambda s, x: s + x.cast("int") * x.cast("int"))
    return v.select("vec_id", total.alias("total"), squares.alias("squares"))


def label_centroids(spark, d):
    """Mean of each label's vectors, one row a place of the vector."""
    v = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    means = v.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))
    return means.withColumn("mean", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("mean")))  # no negative zero


QUERIES = {f.__name__: f for f in (contract_summary, ndcg10, mrr_by_suite, judge_counts, unigram_counts, quantized, label_centroids)}
_SITES = f"{merge._SIGNALS}, {merge._SCORE}"
_GRADED = f"{_SITES}, x AS (SELECT case_id, unnest(relevant) AS r FROM audit_cases WHERE case_id IS NOT NULL), a AS (SELECT case_id, r.identity AS domain, max(r.grade) AS grade FROM x GROUP BY 1, 2), g AS (SELECT a.*, l, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(round(score, 5), 0) DESC, domain) AS place, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, domain) AS best, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(l, 0) DESC, domain) AS other FROM a LEFT JOIN sc USING (domain) LEFT JOIN s USING (domain))"
_UNIGRAMS = f"t AS (SELECT unnest(list_distinct({T.words_sql("concat_ws(' ', title, description)")})) AS word FROM homepage_meta), u AS (SELECT word, count(*) AS n FROM t GROUP BY 1)"
SQL = {
    "contract_summary": "SELECT coalesce(label_status, 'none') AS status, coalesce(category, 'none') AS category, count(*) AS cases, count(*) FILTER (len(relevant) > 0) AS with_answers, count(DISTINCT query) AS queries FROM audit_cases GROUP BY 1, 2",
    "ndcg10": f"WITH {_GRADED}, t AS (SELECT case_id, sum(CASE WHEN place <= 10 THEN (power(2.0, grade) - 1) / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN (power(2.0, grade) - 1) / log2(best + 1) ELSE 0 END) AS ideal FROM g GROUP BY 1) SELECT case_id, CASE WHEN ideal > 0 THEN round(dcg / ideal, 5) ELSE 0 END AS ndcg FROM t",
    "mrr_by_suite": f"WITH {_GRADED}, m AS (SELECT case_id, min(place) AS place FROM g WHERE grade >= 2 GROUP BY 1) SELECT coalesce(suite, 'none') AS suite, count(*) AS cases, round(avg(coalesce(1.0::DOUBLE / place, 0)), 5) AS mrr FROM audit_cases LEFT JOIN m USING (case_id) WHERE case_id IS NOT NULL AND len(relevant) > 0 GROUP BY 1",
    "judge_counts": f"WITH {_GRADED}, m AS (SELECT case_id, min(place) AS a, min(other) AS b FROM g WHERE grade >= 2 GROUP BY 1) SELECT CASE WHEN b < a THEN 'gained' WHEN b > a THEN 'lost' ELSE 'same' END AS move, count(*) AS cases FROM m GROUP BY 1",
    "unigram_counts": f"WITH {_UNIGRAMS} SELECT word, n FROM u",
    "quantized": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x * 127)::INT) AS q FROM embeddings) SELECT vec_id, list_sum(q)::BIGINT AS total, list_sum(list_transform(q, lambda x: x * x))::BIGINT AS squares FROM v",
    "label_centroids": "WITH v AS (SELECT label, unnest(range(0, len(embedding))) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, place, round(avg(x), 4) AS mean FROM v GROUP BY 1, 2) SELECT label, place, CASE WHEN mean = 0 THEN 0.0 ELSE mean END AS mean FROM m",
}
