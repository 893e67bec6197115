"""Candidates beside the best by words, what of a query they hold, and the passes that options and lists ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import merge, passes, search, sites, usage
from webloom.operators.passes import CANDIDATES, FILLERS, FUNCTION_WORDS, KNOWN
from webloom.operators.strings import language_code, singular
from webloom.plans.lineage import keep
from webloom.sources.tables import table

# Popular candidates of a query, words that say little, weights of little and of intent words, bounds of a word's weight, text from which a partial match stays.
POPULAR, FAINT, FAINT_WEIGHT, INTENT_WEIGHT, LEAST, MOST, CLOSE = 50, "online watch read find learn".split(), 0.1, 0.25, 1.0, 3.0, 0.5
# Bonus of the home country, of the most picked site, and parts that grades take.
COUNTRY, PICKED, SPAM, LOW = 0.06, 0.15, 0.9, 0.3


def _scores(spark, d) -> DataFrame:
    return passes.field_scores(passes.field_words(spark, d), passes.clauses(search._queries(spark, d), T.words(F.col("query"))))


def popular_candidates(spark, d):
    """The POPULAR best linked sites of each query among all that match it."""
    links = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("link_score"))
    w = Window.partitionBy("query").orderBy(F.desc("link_score"), "domain")
    return _scores(spark, d).select("query", "domain").join(links, "domain").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= POPULAR).select("query", "domain", "n")


def named_candidates(spark, d):
    """Sites that the first words of a query name, by their label or title, with the number of words; queries are site names with words behind them too."""
    names = merge.site_merge(spark, d).select(F.col("id").alias("domain"), F.explode(F.array(T.joined(F.substring_index("id", ".", 1)), T.joined(F.col("title")))).alias("key")).filter("key <> ''").distinct()
    q = search._queries(spark, d).union(names.filter("length(key) % 7 = 0").select(F.concat("key", F.lit(" opening hours")))).distinct()
    leads = q.select("query", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(T.words(F.col("query"))), F.lit(1))), lambda k: F.struct(F.array_join(F.slice(T.words(F.col("query")), F.lit(1), k), "").alias("key"), k.alias("k")))).alias("x")).select("query", "x.*")
    return leads.join(names, "key").groupBy("query", "domain").agg(F.max("k").alias("words"))


def kind_candidates(spark, d):
    """Sites of the kind that a query's last word names, in either number; a site's kind is here the last word of what is said about it."""
    last = F.element_at(F.concat(F.array(F.lit("")), T.words(F.col("about"))), -1)
    kinds = table(spark, d, "site_items").filter("id is not null and about is not null").select(F.col("id").alias("domain"), singular(last).alias("kind")).filter("kind <> ''").distinct()
    asked = kinds.select(F.concat(F.lit("best "), "kind", F.lit("s")).alias("query")).distinct().union(search._queries(spark, d)).distinct()
    return asked.select("query", singular(F.element_at(F.concat(F.array(F.lit("")), T.words(F.col("query"))), -1)).alias("kind")).join(kinds, "kind").groupBy("query").agg(F.count_distinct("domain").alias("sites"))


def word_weights(spark, d) -> DataFrame:
    """query, word, weight: none for small words and fillers, little for faint ones and those of intent, else by rarity between LEAST and MOST."""
    postings = keep(passes.field_words(spark, d).select("domain", "term").distinct())
    whole = postings.agg(F.count_distinct("domain").alias("n"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    q = search._queries(spark, d).select("query", passes.subject(F.col("query")).alias("subject"), F.explode(F.array_distinct(T.words(F.col("query")))).alias("word"))
    rows = q.join(df, q.word == df.term, "left").crossJoin(F.broadcast(whole))  # one row
    rare = F.greatest(F.least(1 + F.log1p(F.col("n") / (1 + F.coalesce("df", F.lit(0)))), F.lit(MOST)), F.lit(LEAST))
    outside = F.col("subject").isNotNull() & ~F.array_contains(F.split("subject", " "), F.col("word"))
    weight = F.when(F.col("word").isin(*FUNCTION_WORDS, *FILLERS), 0.0).when(F.col("word").isin(*FAINT), FAINT_WEIGHT).when(outside, INTENT_WEIGHT).otherwise(rare)
    return rows.select("query", "word", F.round(weight, 5).alias("weight"))


def evidence(spark, d) -> DataFrame:
    """query, domain, coverage, main: of each candidate the weight of the query's words that it holds, over all, and whether it has every main word (of weight LEAST and more)."""
    weights = keep(word_weights(spark, d))
    pool = passes._first(_scores(spark, d).select("query", "domain", F.round("score", 4).alias("bm25")), CANDIDATES, F.desc("bm25"), "domain").select("query", "domain", "bm25")
    held = passes.field_words(spark, d).select("domain", F.col("term").alias("word")).distinct()
    total = weights.groupBy("query").agg(F.sum("weight").alias("total"), F.count_if(F.col("weight") >= LEAST).alias("mains"), F.count("*").alias("words"))
    got = pool.join(weights, "query").join(held.withColumn("h", F.lit(1)), ["domain", "word"], "left").groupBy("query", "domain", "bm25").agg(F.sum(F.col("weight") * F.coalesce("h", F.lit(0))).alias("w"), F.count_if((F.col("weight") >= LEAST) & F.col("h").isNotNull()).alias("m"), F.count("h").alias("n"))
    rows = got.join(total, "query")
    cover = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(F.col("n") / F.col("words"))
    return rows.select("query", "domain", "bm25", F.round(cover, 4).alias("coverage"), (F.col("m") == F.col("mains")).alias("main"))


def query_evidence(spark, d):
    return evidence(spark, d).select("query", "domain", "coverage", "main")


def partial_removed(spark, d):
    """Candidates that go: unnamed, below half of the best text, and without a main word of the query."""
    e = evidence(spark, d).withColumn("text", F.col("bm25") / F.max("bm25").over(Window.partitionBy("query")))
    named = T.joined(F.substring_index("domain", ".", 1)) == T.joined(F.col("query"))
    return e.filter(~F.col("main") & (F.col("text") < CLOSE) & ~named).select("query", "domain")


def _listed(spark, d) -> DataFrame:
    """query_id, domain, score: the sites of the candidate lists by link score."""
    c = table(spark, d, "candidate_lists").filter("query_id is not null and site_id is not null").select("query_id", "site_id").distinct()
    names = table(spark, d, "site_signals").filter("site_id is not null").groupBy("site_id").agg(F.max("domain").alias("domain"))
    scores = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("score"))
    return c.join(names, "site_id").join(scores, "domain").select("query_id", "site_id", "domain", "score")


def country_order(spark, d):
    """First five of each list where sites of the home ending (here .test) gain COUNTRY."""
    rows = _listed(spark, d).withColumn("score", F.round(F.col("score") + F.when(F.endswith("domain", F.lit(".test")), COUNTRY).otherwise(0.0), 5))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "domain")
    return rows.withColumn("n", F.row_number().over(w)).filter("n <= 5").select("query_id", "domain", "n")


def language_passed(spark, d):
    """Sites of each list that a filter for English lets through: of that language or undeclared, or well known."""
    lang = merge.site_merge(spark, d).select(F.col("id").alias("domain"), language_code(F.col("lang")).alias("lang"))
    rows = _listed(spark, d).join(lang, "domain", "left").filter(F.col("lang").isNull() | (F.col("lang") == "en") | (F.col("score") >= KNOWN))
    return rows.groupBy("query_id").agg(F.count("*").alias("sites"))


def safe_passed(spark, d):
    """Sites of each list that strict filters leave: no word of a level in their titles."""
    words = merge.site_merge(spark, d).select(F.col("id").alias("domain"), sites.level(T.words(F.concat_ws(" ", "title", "about"))).alias("level"))
    return _listed(spark, d).join(words.filter("level <> 'none'"), "domain", "left_anti").groupBy("query_id").agg(F.count("*").alias("sites"))


def grade_demotions(spark, d):
    """First five of each list after grades: spam loses SPAM of its score, what is of low value LOW unless it is official. Grades are here remainders of the id."""
    official = merge.signals(spark, d).select("domain", F.coalesce("official_site", F.lit(False)).alias("o"))
    spam, low = F.col("site_id") % 11 == 0, (F.col("site_id") % 5 == 0) & ~F.col("o")
    rows = _listed(spark, d).join(official, "domain").withColumn("score", F.round(F.col("score") * F.when(spam, 1 - SPAM).when(low, 1 - LOW).otherwise(1.0), 5))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "domain")
    return rows.withColumn("n", F.row_number().over(w)).filter("n <= 5").select("query_id", "domain", "n")


def picked_bonus(spark, d):
    """First five of each list where sites gain PICKED of their share of the most picked; clicks' keys are remainders of the id."""
    picks = usage.events(spark, d).filter("event_type = 'click'").groupBy(F.col("k").cast("long").alias("key")).agg(F.count("*").alias("picks"))
    most = picks.agg(F.max("picks").alias("most"))
    share = picks.crossJoin(F.broadcast(most)).select("key", (F.col("picks") / F.col("most")).alias("share"))  # one row
    rows = _listed(spark, d).withColumn("key", F.col("site_id") % 100).join(share, "key", "left").withColumn("score", F.round(F.col("score") + PICKED * F.coalesce("share", F.lit(0.0)), 5))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "domain")
    return rows.withColumn("n", F.row_number().over(w)).filter("n <= 5").select("query_id", "domain", "n")


def denied(pages: DataFrame, key: Column, entries: DataFrame) -> DataFrame:
    """pages without those that entries (kind: page, prefix or site; value) deny: a page's hashed match key, a prefix of it that ends where a step does, or its site."""
    rows = pages.withColumn("_k", key)
    steps = F.split(F.regexp_replace("_k", r"\?.*$", ""), "/")
    tried = F.array_distinct(F.concat(F.array(F.struct(F.lit("page").alias("kind"), F.sha2("_k", 256).alias("value")), F.struct(F.lit("site").alias("kind"), U.registrable_domain(F.get(steps, F.lit(0))).alias("value"))), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("value")))))
    bad = rows.filter("_k is not null").select("_k", F.explode(tried).alias("t")).select("_k", "t.kind", "t.value").join(entries, ["kind", "value"], "left_semi").select("_k").distinct()
    return rows.join(bad, "_k", "left_anti").drop("_k")


def allowed_pages(spark, d):
    """Pages left by a list that denies every twentieth page, the docs of .test sites and sites of a name that starts with a."""
    p = table(spark, d, "read_pages").filter("page_id is not null and url is not null")
    key = U.match_key(F.col("url"))
    page = p.filter("page_id % 20 = 0").select(F.lit("page").alias("kind"), F.sha2(key, 256).alias("value"))
    prefix = p.filter("domain like '%.test'").select(F.lit("prefix").alias("kind"), F.concat(U.host(F.col("url")), F.lit("/docs")).alias("value"))
    site = p.filter("domain like 'a%'").select(F.lit("site").alias("kind"), U.registrable_domain(U.host(F.col("url"))).alias("value"))
    return denied(p.select("page_id", "url"), key, page.union(prefix).union(site).distinct()).select("page_id")


QUERIES = {f.__name__: f for f in (popular_candidates, named_candidates, kind_candidates, query_evidence, partial_removed, country_order, language_passed, safe_passed, grade_demotions, picked_bonus, allowed_pages)}
_FIELDS = passes._field_sql()
_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_INTENTS = "|".join(sorted(passes.INTENTS, key=len, reverse=True))
_PLAIN = f"array_to_string({T.words_sql('query')}, ' ')"
_EV = f"""{_FIELDS}, dp AS (SELECT DISTINCT domain, term FROM po), dd AS (SELECT term, count(*) AS df FROM dp GROUP BY 1), sq AS (SELECT DISTINCT query FROM candidate_lists WHERE query IS NOT NULL), su AS (SELECT query, CASE WHEN regexp_replace({_PLAIN}, '( ({_INTENTS}))+$', '') <> {_PLAIN} THEN regexp_replace({_PLAIN}, '( ({_INTENTS}))+$', '') END AS subject, unnest(list_distinct({T.words_sql('query')})) AS word FROM sq),
wt AS (SELECT query, word, round(CASE WHEN word IN {_in([*FUNCTION_WORDS, *FILLERS])} THEN 0 WHEN word IN {_in(FAINT)} THEN {FAINT_WEIGHT} WHEN subject IS NOT NULL AND NOT list_contains(string_split(subject, ' '), word) THEN {INTENT_WEIGHT} ELSE greatest(least(1 + ln(1 + (SELECT nd FROM nn) / (1 + coalesce(df, 0))::DOUBLE), {MOST}), {LEAST}) END, 5)::DOUBLE AS weight FROM su LEFT JOIN dd ON word = term),
pl AS (SELECT * FROM (SELECT query, domain, round(score, 4) AS bm25, row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, domain) AS n FROM fs) WHERE n <= {CANDIDATES}), tl AS (SELECT query, sum(weight) AS total, count(*) FILTER (weight >= {LEAST}) AS mains, count(*) AS words FROM wt GROUP BY 1),
gt AS (SELECT query, pl.domain, any_value(bm25) AS bm25, sum(CASE WHEN term IS NULL THEN 0 ELSE weight END) AS w, count(*) FILTER (weight >= {LEAST} AND term IS NOT NULL) AS m, count(term) AS n FROM pl JOIN wt USING (query) LEFT JOIN dp ON dp.domain = pl.domain AND dp.term = word GROUP BY 1, 2),
ev AS (SELECT query, domain, bm25, round(CASE WHEN total > 0 THEN w / total ELSE n / words END, 4) AS coverage, m = mains AS main FROM gt JOIN tl USING (query))"""
_LI = f"{merge._SIGNALS}, {merge._SCORE}, dn AS (SELECT site_id, max(domain) AS domain FROM site_signals WHERE site_id IS NOT NULL GROUP BY 1), li AS (SELECT DISTINCT query_id, c.site_id, dn.domain, round(score, 5) AS score FROM candidate_lists c JOIN dn ON dn.site_id = c.site_id JOIN sc ON sc.domain = dn.domain WHERE query_id IS NOT NULL)"
_FIVE = lambda source: f"SELECT query_id, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, domain) AS n FROM ({source})) WHERE n <= 5"
_LABEL = f"array_to_string({T.words_sql(chr(115) + 'tring_split(domain, ' + chr(39) + '.' + chr(39) + ')[1]')}, '')"
_NK = f"nk AS (SELECT DISTINCT id AS domain, unnest([array_to_string({T.words_sql('lb')}, ''), array_to_string({T.words_sql('title')}, '')]) AS key FROM (SELECT id, title, string_split(id, '.')[1] AS lb FROM ({merge.SQL['site_merge']})))"


def _singular(x: str) -> str:
    from webloom.operators.strings import _singular_sql

    return _singular_sql(x)


SQL = {
    "popular_candidates": f"{_FIELDS}, {merge._SIGNALS}, {merge._SCORE} SELECT query, domain, n FROM (SELECT query, fs.domain, row_number() OVER (PARTITION BY query ORDER BY round(sc.score, 5) DESC, fs.domain) AS n FROM fs JOIN sc ON sc.domain = fs.domain) WHERE n <= {POPULAR}",
    "named_candidates": f"WITH {_NK}, nz AS (SELECT * FROM nk WHERE key <> ''), q AS (SELECT DISTINCT query FROM candidate_lists WHERE query IS NOT NULL UNION SELECT key || ' opening hours' FROM nz WHERE length(key) % 7 = 0), w AS (SELECT query, {T.words_sql('query')} AS w FROM q), k AS (SELECT query, w, unnest(range(1, greatest(len(w), 1) + 1)) AS k FROM w) SELECT query, domain, max(k) AS words FROM k JOIN nz ON array_to_string(w[:k], '') = key GROUP BY 1, 2",
    "kind_candidates": f"WITH n AS (SELECT id AS domain, coalesce({T.words_sql('about')}[-1], '') AS n FROM site_items WHERE id IS NOT NULL AND about IS NOT NULL), k AS (SELECT DISTINCT domain, {_singular('n')} AS kind FROM n WHERE n <> ''), q AS (SELECT 'best ' || kind || 's' AS query FROM k UNION SELECT query FROM candidate_lists WHERE query IS NOT NULL), z AS (SELECT query, {T.words_sql('query')}[-1] AS lw FROM q) SELECT query, count(DISTINCT domain) AS sites FROM z JOIN k ON {_singular('lw')} = kind GROUP BY 1",
    "query_evidence": f"{_EV} SELECT query, domain, coverage, main FROM ev",
    "partial_removed": f"{_EV}, tx AS (SELECT *, bm25 / max(bm25) OVER (PARTITION BY query) AS text FROM ev) SELECT query, domain FROM tx WHERE NOT main AND text < {CLOSE} AND {_LABEL} <> array_to_string({T.words_sql('query')}, '')",
    "country_order": f"WITH {_LI} " + _FIVE(f"SELECT query_id, domain, round(score + CASE WHEN suffix(domain, '.test') THEN {COUNTRY}::DOUBLE ELSE 0 END, 5) AS score FROM li"),
    "language_passed": f"WITH {_LI}, sm AS ({merge.SQL['site_merge']}), lg AS (SELECT id, CASE WHEN length(trim(lang)) <= 63 AND regexp_full_match(trim(lang), '[A-Za-z0-9]{{1,8}}([-_][A-Za-z0-9]{{1,8}})*') AND regexp_full_match(lower(string_split(replace(trim(lang), '_', '-'), '-')[1]), '[a-z]{{2,3}}') AND lower(string_split(replace(trim(lang), '_', '-'), '-')[1]) NOT IN ('und', 'zxx', 'mul', 'mis') THEN lower(string_split(replace(trim(lang), '_', '-'), '-')[1]) END AS lg FROM sm) SELECT query_id, count(*) AS sites FROM li LEFT JOIN lg ON lg.id = domain WHERE lg IS NULL OR lg = 'en' OR score >= {KNOWN} GROUP BY 1",
    "safe_passed": f"WITH {_LI}, sm AS ({merge.SQL['site_merge']}), bad AS (SELECT id FROM (SELECT id, {T.words_sql('t')} AS w FROM (SELECT id, concat_ws(' ', title, about) AS t FROM sm)) WHERE list_has_any(w, {' '.join(sites.LEVELS.values()).split()})) SELECT query_id, count(*) AS sites FROM li WHERE domain NOT IN (SELECT id FROM bad) GROUP BY 1",
    "grade_demotions": f"WITH {_LI} " + _FIVE(f"SELECT query_id, li.domain, round(score * CASE WHEN site_id % 11 = 0 THEN {1 - SPAM}::DOUBLE WHEN site_id % 5 = 0 AND NOT coalesce(s.o, false) THEN {1 - LOW}::DOUBLE ELSE 1 END, 5) AS score FROM li JOIN s ON s.domain = li.domain"),
    "picked_bonus": f"WITH {_LI}, {usage._E}, pk AS (SELECT k, count(*) AS picks FROM e WHERE event_type = 'click' GROUP BY 1), ps AS (SELECT k, picks / (SELECT max(picks) FROM pk)::DOUBLE AS share FROM pk) " + _FIVE(f"SELECT query_id, domain, round(score + {PICKED}::DOUBLE * coalesce(share, 0), 5) AS score FROM li LEFT JOIN ps ON ps.k = site_id % 100"),
    "allowed_pages": f"WITH p AS (SELECT page_id, domain, {U.match_key_sql('url')} AS k, {U.host_sql('url')} AS h FROM read_pages WHERE page_id IS NOT NULL AND url IS NOT NULL), b AS (SELECT *, regexp_replace(k, '\\?.*$', '') AS s FROM p), px AS (SELECT DISTINCT h || '/docs' AS v FROM p WHERE domain LIKE '%.test'), st AS (SELECT DISTINCT {U.domain_sql('h')} AS v FROM p WHERE domain LIKE 'a%') SELECT page_id FROM b WHERE k IS NULL OR NOT (k IN (SELECT k FROM p WHERE page_id % 20 = 0) OR coalesce({U.domain_sql("string_split(s, '/')[1]")} IN (SELECT v FROM st), false) OR EXISTS (SELECT 1 FROM px WHERE s = v OR starts_with(s, v || '/')))",
}
