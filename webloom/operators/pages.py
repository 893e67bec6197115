"""Pages (the documents as articles): names, popularity, questions, placing beside sites, assembly of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators import merge, search
from webloom.operators.passes import QUESTIONS
from webloom.plans.lineage import keep
from webloom.sources.tables import table

# Marks of names (title, other name, part), share of popularity, least coverage of a question, margins of readers, pages placed.
TITLE, ALIAS, PARTIAL, SHARE, QUESTION, MEANT, THE, FREE, PARTIAL_LEAST = 1.0, 0.9, 0.6, 0.5, 0.75, 3, 10, 2, 0.3


def pages(spark, d) -> DataFrame:
    """page, title, key, views, set, site: documents of a title; the characters of a text stand for its readers."""
    p = table(spark, d, "documents").filter("doc_id is not null and length(trim(title)) > 0")
    return p.select(F.col("doc_id").alias("page"), "title", T.joined(F.col("title")).alias("key"), T.joined(F.substring_index("title", " ", 2)).alias("short"), F.coalesce("n_chars", F.lit(0)).alias("views"), F.coalesce("source", F.lit("none")).alias("set"), "site", "lang").filter("key <> ''")


def _rounded(x: Column) -> Column:
    """x to five places as SQL rounds a double, by its product with 1e5; F.round goes by the written digits, and parts from it at halves."""
    return F.round(x * 1e5) / 1e5


def popularity(p: DataFrame) -> DataFrame:
    """p with popularity: the logarithm of its readers over that of the most read page of its set."""
    most = p.groupBy("set").agg(F.max("views").alias("_most"))
    return p.join(F.broadcast(most), "set").withColumn("popularity", F.round(F.log1p("views") / F.greatest(F.log1p("_most"), F.lit(1e-9)), 5)).drop("_most")


def _asked(spark, d) -> DataFrame:
    """Queries: titles of pages whose id is divisible by 20, alone, with a word more, as "the ...", and inside others.
    All blanks of Unicode go from the ends of a title, as by trim in SQL; F.trim takes the plain one alone."""
    t = pages(spark, d).filter("page % 20 = 0").select(F.regexp_replace("title", r"^\p{Zs}+|\p{Zs}+\z", "").alias("t")).distinct()
    forms = F.array("t", F.concat("t", F.lit(" reviews")), F.concat(F.lit("the "), "t"), F.concat(F.lit("where is "), "t", F.lit(" now")), F.substring_index("t", " ", 2))
    return t.select(F.explode(forms).alias("query")).distinct()


def page_popularity(spark, d):
    return popularity(pages(spark, d)).select("page", "popularity")


def spans(query):
    """All runs of a query's words, joined, with their length."""
    w = T.words(query)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda a: F.transform(F.sequence(a, F.greatest(F.size(w), a)), lambda b: F.struct(F.array_join(F.slice(w, a, b - a + 1), "").alias("key"), (b - a + 1).alias("n"), (a == 1).alias("first")))))
    return F.array_distinct(F.filter(runs, lambda x: x["key"] != ""))


def named_pages(spark, d) -> DataFrame:
    """query, page, name: how well a page's title or short title names the query: all of it, or the part of its words that they are."""
    q = _asked(spark, d).select("query", F.size(T.words(F.col("query"))).alias("words"), F.explode(spans(F.col("query"))).alias("s")).select("query", "words", "s.*")
    p = pages(spark, d)
    names = p.select("page", "key", F.lit(TITLE).alias("mark")).union(p.filter("short <> key and short <> ''").select("page", F.col("short").alias("key"), F.lit(ALIAS).alias("mark")))
    hits = q.join(names, "key")
    name = F.when(F.col("n") == F.col("words"), F.col("mark")).otherwise(PARTIAL * F.col("mark") * F.col("n") / F.col("words"))
    return hits.groupBy("query", "page").agg(_rounded(F.max(name)).alias("name"))


def page_names(spark, d):
    return named_pages(spark, d)


def page_scores(spark, d) -> DataFrame:
    """The ten best pages of each query: its name times a half and half its popularity."""
    s = named_pages(spark, d).join(popularity(pages(spark, d)).select("page", "popularity", "set"), "page")
    s = s.select("query", "page", "set", "name", _rounded(F.col("name") * (1 - SHARE + SHARE * F.col("popularity"))).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "page")
    return s.withColumn("place", F.row_number().over(w)).filter("place <= 10")


def question_pages(spark, d):
    """Pages that hold QUESTION of the weight (rarity) of a question's words, over title words; the best three a question.

    Pages whose titles have the same words cover the same, so that sets of words meet the questions, and the first three pages of each set count.
    A set without any of a question's heaviest words, down to where the others weigh less than QUESTION, can't cover it: only those words are joined.
    """
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.words(F.col("title"))))))
    titled = keep(pages(spark, d).groupBy("page").agg(words.alias("held"), F.count("*").alias("rows")).withColumn("set", F.array_join("held", " ")))
    whole = titled.agg(F.sum("rows").alias("n"))
    df = titled.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole)).select("word", F.round(F.log1p(F.col("n") / F.col("df")), 5).alias("weight"))  # one row
    q = _asked(spark, d).filter(F.get(F.split(F.lower("query"), " "), F.lit(0)).isin(*QUESTIONS)).select("query", F.explode(F.array_distinct(T.words(F.col("query")))).alias("word"))
    terms = q.hint("merge").join(df, "word").groupBy("query").agg(F.reverse(F.array_sort(F.collect_list(F.struct("weight", "word")))).alias("terms"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, t: s + t["weight"])
    total = terms.withColumn("total", add(F.col("terms")))
    spare = 1e-3  # for what is rounded
    heavy = F.filter("terms", lambda t, i: add(F.slice(F.col("terms"), i + 1, F.size("terms"))) >= (QUESTION - spare) * F.col("total"))
    asked = total.select("query", "terms", "total", F.explode(F.transform(heavy, lambda t: t["word"])).alias("word"))
    first = Window.partitionBy("set").orderBy("page")
    three = keep(titled.withColumn("nth", F.row_number().over(first)).filter("nth <= 3").select("set", "held", "page", "nth"))
    sets = three.filter("nth = 1").select("set", "held", F.explode("held").alias("word"))
    coverage = F.round(add(F.filter("terms", lambda t: F.array_contains("held", t["word"]))) / F.col("total"), 4)
    good = asked.hint("merge").join(sets, "word").select("query", "set", coverage.alias("coverage")).filter(F.col("coverage") >= QUESTION).distinct()
    w = Window.partitionBy("query").orderBy(F.desc("coverage"), "page")
    return good.join(three.select("set", "page"), "set").select("query", "page", "coverage").withColumn("place", F.row_number().over(w)).filter("place <= 3")


def the_less(spark, d):
    """Pages meant by "the X": titled X, and read THE times as often as the next page of that title."""
    q = _asked(spark, d).filter(F.startswith("query", F.lit("the "))).select("query", T.joined(F.expr("substring(query, 5)")).alias("key"))
    w = Window.partitionBy("query").orderBy(F.desc("views"), "page")
    rows = q.join(pages(spark, d), "key").withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("views").over(w))
    return rows.filter((F.col("n") == 1) & (F.col("next").isNull() | (F.col("views") >= THE * F.col("next")))).select("query", "page")


def linked_articles(spark, d):
    """The article that the longest run of a query's words names, read MEANT times as often as any other of that name."""
    q = _asked(spark, d).select("query", F.explode(spans(F.col("query"))).alias("s")).select("query", "s.key", "s.n")
    p = pages(spark, d)
    w = Window.partitionBy("key").orderBy(F.desc("views"), "page")
    one = p.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("views").over(w)).filter((F.col("r") == 1) & (F.col("next").isNull() | (F.col("views") >= MEANT * F.col("next"))))
    best = Window.partitionBy("query").orderBy(F.desc("n"), F.desc("views"), "page")
    return q.join(one.select("key", "page", "views"), "key").withColumn("b", F.row_number().over(best)).filter("b = 1").select("query", "page", F.col("n").alias("words"))


def placed_pages(spark, d):
    """Rows of a list of ten: the sites of each candidate list by link score, and FREE pages at most beside them. A page about a listed
    site goes under it, a named one leads, a partial one of PARTIAL_LEAST and more comes after three sites."""
    sites = table(spark, d, "candidate_lists").filter("query_id % 5 = 0").select("query_id", "site_id").distinct()
    names = table(spark, d, "site_signals").filter("site_id is not null").groupBy("site_id").agg(F.max("domain").alias("domain"))
    scores = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "domain")
    s = sites.join(names, "site_id").join(scores, "domain").withColumn("place", F.row_number().over(w)).filter("place <= 10")
    p = popularity(pages(spark, d)).filter("site is not null")
    under = s.join(p.select(F.col("site").alias("domain"), "page", "popularity"), "domain").withColumn("r", F.row_number().over(Window.partitionBy("query_id", "domain").orderBy(F.desc("popularity"), "page"))).filter("r = 1")
    free = under.withColumn("f", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("popularity"), "page"))).filter(F.col("f") <= FREE)
    rows = s.select("query_id", F.col("place").cast("double").alias("at"), F.col("domain").alias("row")).union(free.select("query_id", F.col("place") + 0.5, F.concat(F.lit("page "), F.col("page").cast("string"))))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "row"))).filter("n <= 10").select("query_id", "row", "n")


def language_view(spark, d):
    """Pages that a filter for German lets through: of that language, or of none, by set."""
    lang = F.lower(F.substring_index(F.translate(F.trim("lang"), "_", "-"), "-", 1))
    return pages(spark, d).filter(F.col("lang").isNull() | (F.trim("lang") == "") | (lang == "de")).groupBy("set").agg(F.count("*").alias("pages"))


def obscure_namesakes(spark, d):
    """Pages of a title that another page of the set shares, read a tenth as often and less: they go."""
    w = Window.partitionBy("set", "key")
    return pages(spark, d).withColumn("most", F.max("views").over(w)).filter(F.col("views") * 10 <= F.col("most")).select("page")


def site_pages(spark, d):
    """Pages that site: lets through, ten of each asked site at most, the most read first."""
    asked = table(spark, d, "site_signals").filter("site_id % 10 = 0").select(F.col("domain").alias("site")).distinct()
    w = Window.partitionBy("site").orderBy(F.desc("views"), "page")
    return pages(spark, d).join(asked, "site", "left_semi").withColumn("n", F.row_number().over(w)).filter("n <= 10").select("site", "page", "n")


def paper_windows(spark, d):
    """Documents of each source by windows of ninety days of their fetching; those of the newest window are recent, the rest established."""
    p = table(spark, d, "documents").filter("fetched_at is not null").select(F.coalesce("source", F.lit("none")).alias("source"), F.floor(F.unix_timestamp("fetched_at") / (90 * 86_400)).alias("window"))
    last = p.agg(F.max("window").alias("last"))
    return p.crossJoin(F.broadcast(last)).groupBy("source", "window", (F.col("window") == F.col("last")).alias("recent")).agg(F.count("*").alias("documents"))  # one row


def merged_lists(spark, d):
    """One list of own and network results: of a site in both the own row counts, then by score; ten a query. The ways of finding tell them apart."""
    c = table(spark, d, "candidate_lists").filter("query_id is not null and site_id is not null")
    names = table(spark, d, "site_signals").filter("site_id is not null").groupBy("site_id").agg(F.max("domain").alias("domain"))
    scores = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("score"))
    own = F.min(F.when(F.length("found_by") % 2 == 0, 0).otherwise(1)).alias("network")
    rows = c.groupBy("query_id", "site_id").agg(own).join(names, "site_id").join(scores, "domain")
    rows = rows.withColumn("score", F.round(F.col("score") * F.when(F.col("network") == 1, 0.9).otherwise(1.0), 5))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "network", "domain")
    return rows.withColumn("n", F.row_number().over(w)).filter("n <= 10").select("query_id", "domain", "network", "n")


def lead_ins(spark, d):
    """Lists with the routed sites (here those of the word's own label) first, the others in order behind."""
    top = search.bm25_top(spark, d).select("query", "domain", "place")
    routed = F.arrays_overlap(T.words(F.col("query")), T.words(F.replace(F.substring_index("domain", ".", 1), F.lit("-"), F.lit(" "))))
    w = Window.partitionBy("query").orderBy(F.desc("routed"), "place")
    return top.withColumn("routed", F.coalesce(routed, F.lit(False)).cast("int")).withColumn("n", F.row_number().over(w)).select("query", "domain", "n")


def set_operations(spark, d):
    """Sites of the records, the links and both: union, intersection and difference, in numbers."""
    a = table(spark, d, "site_items").filter("id is not null").select(F.col("id").alias("s")).distinct()
    b = table(spark, d, "anchors").filter("target_domain is not null").select(F.col("target_domain").alias("s")).distinct()
    n = lambda name, df: df.agg(F.count("*").alias("sites")).select(F.lit(name).alias("set"), "sites")
    return n("union", a.union(b).distinct()).union(n("both", a.intersect(b))).union(n("records only", a.exceptAll(b)))


QUERIES = {f.__name__: f for f in (page_popularity, page_names, page_scores, question_pages, the_less, linked_articles, placed_pages, language_view, obscure_namesakes, site_pages, paper_windows, merged_lists, lead_ins, set_operations)}
_Q = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in QUESTIONS) + ")"
_P = f"pg AS (SELECT * FROM (SELECT doc_id AS page, title, array_to_string({T.words_sql('title')}, '') AS key, array_to_string({T.words_sql("array_to_string(string_split(title, ' ')[:2], ' ')")}, '') AS short, coalesce(n_chars, 0) AS views, coalesce(source, 'none') AS \"set\", site, lang FROM documents WHERE doc_id IS NOT NULL AND length(trim(title)) > 0) WHERE key <> ''), pp AS (SELECT *, round(ln(1 + views) / greatest(ln(1 + max(views) OVER (PARTITION BY \"set\")), 1e-9), 5) AS popularity FROM pg)"
_A = "tt AS (SELECT DISTINCT trim(title) AS t FROM pg WHERE page % 20 = 0), aq AS (SELECT DISTINCT unnest([t, t || ' reviews', 'the ' || t, 'where is ' || t || ' now', array_to_string(string_split(t, ' ')[:2], ' ')]) AS query FROM tt)"
_SPANS = f"qw AS (SELECT query, {T.words_sql('query')} AS w FROM aq), qa AS (SELECT *, unnest(range(1, greatest(len(w), 1) + 1)) AS a FROM qw), qb AS (SELECT *, unnest(range(a, greatest(len(w), a) + 1)) AS b FROM qa), sp AS (SELECT DISTINCT query, len(w) AS words, array_to_string(w[a:b], '') AS key, b - a + 1 AS n FROM qb WHERE array_to_string(w[a:b], '') <> '')"
_NAMES = f"nm AS (SELECT page, key, {TITLE}::DOUBLE AS mark FROM pg UNION ALL SELECT page, short, {ALIAS}::DOUBLE FROM pg WHERE short <> key AND short <> ''), np AS (SELECT query, page, round(max(CASE WHEN n = words THEN mark ELSE {PARTIAL}::DOUBLE * mark * n / words END), 5) AS name FROM sp JOIN nm USING (key) GROUP BY 1, 2)"
_SITES = f"{merge._SIGNALS}, {merge._SCORE}, dn AS (SELECT site_id, max(domain) AS domain FROM site_signals WHERE site_id IS NOT NULL GROUP BY 1)"
SQL = {
    "page_popularity": f"WITH {_P} SELECT page, popularity FROM pp",
    "page_names": f"WITH {_P}, {_A}, {_SPANS}, {_NAMES} SELECT * FROM np",
    "page_scores": f"WITH {_P}, {_A}, {_SPANS}, {_NAMES}, z AS (SELECT query, page, \"set\", name, round(name * ({1 - SHARE} + {SHARE} * popularity), 5) AS score FROM np JOIN pp USING (page)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, page) AS place FROM z) WHERE place <= 10",
    "question_pages": f"WITH {_P}, {_A}, qq AS (SELECT DISTINCT query, unnest({T.words_sql('query')}) AS word FROM aq WHERE string_split(lower(query), ' ')[1] IN {_Q}), pw AS (SELECT DISTINCT page, unnest({T.words_sql('title')}) AS word FROM pg), df AS (SELECT word, round(ln(1 + (SELECT count(*) FROM pg) / count(*)::DOUBLE), 5) AS weight FROM pw GROUP BY 1), we AS (SELECT qq.*, weight FROM qq JOIN df USING (word)), to1 AS (SELECT query, sum(weight) AS total FROM we GROUP BY 1), h AS (SELECT query, page, round(sum(weight) / any_value(total), 4) AS coverage FROM we JOIN pw USING (word) JOIN to1 USING (query) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coverage DESC, page) AS place FROM h WHERE coverage >= {QUESTION}) WHERE place <= 3",
    "the_less": f"WITH {_P}, {_A}, q AS (SELECT query, array_to_string({T.words_sql('query[5:]')}, '') AS key FROM aq WHERE query LIKE 'the %'), r AS (SELECT query, page, views, row_number() OVER v AS n, lead(views) OVER v AS nxt FROM q JOIN pg USING (key) WINDOW v AS (PARTITION BY query ORDER BY views DESC, page)) SELECT query, page FROM r WHERE n = 1 AND (nxt IS NULL OR views >= {THE} * nxt)",
    "linked_articles": f"WITH {_P}, {_A}, {_SPANS}, o AS (SELECT * FROM (SELECT key, page, views, row_number() OVER v AS r, lead(views) OVER v AS nxt FROM pg WINDOW v AS (PARTITION BY key ORDER BY views DESC, page)) WHERE r = 1 AND (nxt IS NULL OR views >= {MEANT} * nxt)) SELECT query, page, n AS words FROM (SELECT query, page, n, row_number() OVER (PARTITION BY query ORDER BY n DESC, views DESC, page) AS b FROM sp JOIN o USING (key)) WHERE b = 1",
    "placed_pages": f"WITH {_P}, {_SITES}, c AS (SELECT DISTINCT query_id, site_id FROM candidate_lists WHERE query_id % 5 = 0), st AS (SELECT * FROM (SELECT query_id, domain, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, domain) AS place FROM c JOIN dn USING (site_id) JOIN sc USING (domain)) WHERE place <= 10), un AS (SELECT * FROM (SELECT st.*, page, popularity, row_number() OVER (PARTITION BY query_id, domain ORDER BY popularity DESC, page) AS r FROM st JOIN pp ON pp.site = st.domain) WHERE r = 1), fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY popularity DESC, page) AS f FROM un) WHERE f <= {FREE}), al AS (SELECT query_id, place::DOUBLE AS pos, domain AS row FROM st UNION ALL SELECT query_id, place + 0.5, 'page ' || page FROM fz) SELECT query_id, row, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, row) AS n FROM al) WHERE n <= 10",
    "language_view": f"WITH {_P} SELECT \"set\", count(*) AS pages FROM pg WHERE lang IS NULL OR trim(lang) = '' OR lower(string_split(replace(trim(lang), '_', '-'), '-')[1]) = 'de' GROUP BY 1",
    "obscure_namesakes": f"WITH {_P} SELECT page FROM (SELECT page, views, max(views) OVER (PARTITION BY \"set\", key) AS most FROM pg) WHERE views * 10 <= most",
    "site_pages": f"WITH {_P} SELECT site, page, n FROM (SELECT site, page, row_number() OVER (PARTITION BY site ORDER BY views DESC, page) AS n FROM pg WHERE site IN (SELECT domain FROM site_signals WHERE site_id % 10 = 0)) WHERE n <= 10",
    "paper_windows": "WITH p AS (SELECT coalesce(source, 'none') AS source, floor(epoch(fetched_at))::BIGINT // 7776000 AS w FROM documents WHERE fetched_at IS NOT NULL) SELECT source, w AS \"window\", w = (SELECT max(w) FROM p) AS recent, count(*) AS documents FROM p GROUP BY 1, 2, 3",
    "merged_lists": f"WITH {_SITES}, c AS (SELECT query_id, site_id, min(CASE WHEN length(found_by) % 2 = 0 THEN 0 ELSE 1 END) AS network FROM candidate_lists WHERE query_id IS NOT NULL AND site_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT query_id, domain, network, round(round(score, 5) * CASE WHEN network = 1 THEN 0.9::DOUBLE ELSE 1 END, 5) AS sr FROM c JOIN dn USING (site_id) JOIN sc USING (domain)) SELECT query_id, domain, network, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sr DESC, network, domain) AS n FROM r) WHERE n <= 10",
    "lead_ins": f"WITH b AS ({search.SQL['bm25_top']}), r AS (SELECT query, domain, place, coalesce(list_has_any({T.words_sql('query')}, {T.words_sql("replace(string_split(domain, '.')[1], '-', ' ')")}), false)::INT AS routed FROM b) SELECT query, domain, row_number() OVER (PARTITION BY query ORDER BY routed DESC, place) AS n FROM r",
    "set_operations": "WITH a AS (SELECT DISTINCT id AS s FROM site_items WHERE id IS NOT NULL), b AS (SELECT DISTINCT target_domain AS s FROM anchors WHERE target_domain IS NOT NULL) SELECT 'union' AS \"set\", (SELECT count(*) FROM (SELECT s FROM a UNION SELECT s FROM b)) AS sites UNION ALL SELECT 'both', (SELECT count(*) FROM a WHERE s IN (SELECT s FROM b)) UNION ALL SELECT 'records only', (SELECT count(*) FROM a WHERE s NOT IN (SELECT s FROM b))",
}
