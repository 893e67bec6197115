"""An inverted index as tables, BM25 retrieval, blended ranking and the passes after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators import merge
from webloom.sources.tables import table

K1, B = 1.2, 0.75
#: Postings of a word that one task meets.
BLOCK = 50_000
#: Weight of the text score against popularity, bonus of an exact name, and rows of a result list.
ALPHA, EXACT, TOP = 0.35, 0.25, 10


def site_documents(spark, d) -> DataFrame:
    """domain, name, words: one searchable document of each site, from its item and the last description of its homepage."""
    meta = table(spark, d, "homepage_meta").filter("description is not null")
    last = meta.groupBy(F.col("domain").alias("id")).agg(F.max(F.struct("fetched_at", "meta_id", "description"))["description"].alias("description"))
    items = merge.site_merge(spark, d).join(last, "id", "left")
    return items.select(F.col("id").alias("domain"), T.joined(F.col("title")).alias("name"), T.words(F.concat_ws(" ", "title", "about", "description")).alias("words"))


def postings(spark, d):
    rows = site_documents(spark, d).select("domain", F.explode("words").alias("term"))
    return rows.groupBy("term", "domain").agg(F.count("*").alias("tf"))


def doc_lengths(spark, d):
    return site_documents(spark, d).select("domain", F.size("words").alias("length"))


def term_stats(spark, d):
    n = site_documents(spark, d).agg(F.count("*").alias("n"))
    stats = postings(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(n))  # one row
    return stats.select("term", "df", "cf", F.round(F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 5).alias("idf"))


def _queries(spark, d) -> DataFrame:
    return table(spark, d, "candidate_lists").filter("query is not null").select("query").distinct()


def scored(spark, d) -> DataFrame:
    """query, domain, score, matched: BM25 of every site that shares a word with a query."""
    docs = site_documents(spark, d).withColumn("length", F.size("words"))
    whole = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = docs.select("domain", "length", F.explode("words").alias("term")).groupBy("term", "domain", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    asked = _queries(spark, d).select("query", F.explode(F.array_distinct(T.words(F.col("query")))).alias("term"))
    # the postings of a word that BLOCK sites and more hold are met in blocks, so that no common word gathers all queries and sites in one task
    parts = F.floor(F.col("df") / BLOCK)
    asked = asked.join(df, "term").select("query", "term", "df", F.explode(F.sequence(F.lit(0), parts)).alias("part"))
    tf = tf.join(df.select("term", (parts + 1).alias("parts")), "term").withColumn("part", F.pmod(F.xxhash64("domain"), F.col("parts")))
    hits = asked.join(tf, ["term", "part"]).crossJoin(F.broadcast(whole))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.groupBy("query", "domain").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def _top(rows: DataFrame, by: str) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc(by), "domain")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= TOP)


def bm25_top(spark, d):
    return _top(scored(spark, d).withColumn("score", F.round("score", 4)), "score")


def blended_top(spark, d):
    """Text score over the query's best, blended with popularity, plus a bonus where the site's name is the query."""
    text = scored(spark, d)
    best = text.groupBy("query").agg(F.max("score").alias("best"))
    sites = merge.with_link_score(merge.signals(spark, d)).select("domain", "link_score")
    names = site_documents(spark, d).select("domain", "name")
    rows = text.join(best, "query").join(sites, "domain", "left").join(names, "domain")
    exact = F.when(F.col("name") == T.joined(F.col("query")), EXACT).otherwise(0.0)
    score = ALPHA * F.col("score") / F.col("best") + (1 - ALPHA) * F.coalesce("link_score", F.lit(0.0)) + exact
    return _top(rows.select("query", "domain", F.round(score, 4).alias("score")), "score")


def coverage(spark, d):
    """Part of each query's words that its best site holds."""
    n = _queries(spark, d).select("query", F.size(F.array_distinct(T.words(F.col("query")))).alias("words"))
    most = scored(spark, d).groupBy("query").agg(F.max("matched").alias("matched"))
    return n.join(most, "query", "left").select("query", "words", F.round(F.coalesce("matched", F.lit(0)) / F.greatest("words", F.lit(1)), 4).alias("coverage"))


def candidate_union(spark, d):
    """One row for each site of a list, with all the ways it was found."""
    c = table(spark, d, "candidate_lists").filter("query_id is not null and site_id is not null")
    return c.groupBy("query_id", "site_id").agg(F.count_distinct("found_by").alias("ways"), F.array_join(F.array_sort(F.collect_set("found_by")), ",").alias("found_by"))


def named_domains(spark, d):
    return table(spark, d, "site_signals").filter("site_id is not null").groupBy("site_id").agg(F.max("domain").alias("domain"))


QUERIES = {f.__name__: f for f in (postings, doc_lengths, term_stats, bm25_top, blended_top, coverage, candidate_union)}
_DOCS = f"{merge.SQL['site_merge']}"
_BASE = f"""items AS ({_DOCS}), meta AS (SELECT domain AS id, description, row_number() OVER (PARTITION BY domain ORDER BY fetched_at DESC NULLS LAST, meta_id DESC) AS rn FROM homepage_meta WHERE description IS NOT NULL),
texts AS (SELECT items.*, description FROM items LEFT JOIN meta ON items.id = meta.id AND rn = 1), docs AS (SELECT id AS domain, array_to_string({T.words_sql('title')}, '') AS name, {T.words_sql("concat_ws(' ', title, about, description)")} AS words FROM texts),
tf AS (SELECT term, domain, length, count(*) AS tf FROM (SELECT domain, len(words) AS length, unnest(words) AS term FROM docs) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM docs)"""
_SCORED = f"""{_BASE}, q AS (SELECT DISTINCT query, list_distinct({T.words_sql('query')}) AS w FROM candidate_lists WHERE query IS NOT NULL), asked AS (SELECT query, unnest(w) AS term FROM q),
hits AS (SELECT query, domain, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * length / mean))) AS score, count(*) AS matched FROM asked JOIN df USING (term) JOIN tf USING (term), whole GROUP BY 1, 2)"""
_SITES = f"{merge._SIGNALS}, {merge._SCORE}"
SQL = {
    "postings": f"WITH {_BASE} SELECT term, domain, tf FROM tf",
    "doc_lengths": f"WITH {_BASE} SELECT domain, coalesce(len(words), 0) AS length FROM docs",
    "term_stats": f"WITH {_BASE} SELECT term, df, cf::BIGINT AS cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 5) AS idf FROM df, whole",
    "bm25_top": f"WITH {_SCORED}, r AS (SELECT query, domain, round(score, 4) AS score, matched, row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, domain) AS place FROM hits) SELECT * FROM r WHERE place <= {TOP}",
    "blended_top": f"WITH {_SCORED}, {_SITES}, b AS (SELECT query, domain, round({ALPHA} * hits.score / max(hits.score) OVER (PARTITION BY query) + {1 - ALPHA} * coalesce(sc.score, 0) + CASE WHEN name = array_to_string({T.words_sql('query')}, '') THEN {EXACT} ELSE 0 END, 4) AS score FROM hits JOIN docs USING (domain) LEFT JOIN sc USING (domain)), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, domain) AS place FROM b) SELECT * FROM r WHERE place <= {TOP}",
    "coverage": f"WITH {_SCORED}, m AS (SELECT query, max(matched) AS matched FROM hits GROUP BY 1) SELECT q.query, len(w) AS words, round(coalesce(matched, 0) / greatest(len(w), 1), 4) AS coverage FROM q LEFT JOIN m USING (query)",
    "candidate_union": "SELECT query_id, site_id, count(DISTINCT found_by) AS ways, array_to_string(list_sort(list(DISTINCT found_by)), ',') AS found_by FROM candidate_lists WHERE query_id IS NOT NULL AND site_id IS NOT NULL GROUP BY 1, 2",
}
