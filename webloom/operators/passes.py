"""Fielded retrieval and the passes over a query's hits, in the order in which they apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import merge, search
from webloom.operators.strings import FUNCTION_WORDS, other_number
from webloom.plans.lineage import keep
from webloom.sources.tables import table

# Boosts of the fields, of a whole query as a name and of a typed domain, share of a word's other number, most repeats of a link text.
BOOSTS = {"label": 4.0, "joined": 4.0, "aliases": 2.5, "title": 2.0, "about": 2.0, "anchors": 1.5, "description": 0.5}
WHOLE, DOMAIN, OTHER, REPEATS = 6.0, 10.0, 0.8, 5.0
NAMES = ("label", "joined", "aliases")
# Weights of the score and limits of the passes.
ALPHA, DESCRIBED, LABEL_BONUS, ALIAS_BONUS, TRUSTED, UNTRUSTED, CANDIDATES = 0.35, 0.5, 0.25, 0.1, 0.2, 0.5, 200
NAMED_FLOOR, DESCRIBED_FLOOR, QUESTION_FLOOR, NAMED_SHARE, KNOWN, COPYCAT = 0.05, 0.04, 0.3, 0.4, 0.5, 0.05
# Words a question starts with, and words at a query's end that are about a site rather than of its name.
QUESTIONS = "how why what whats what's when where which who can could should do does did is are will would".split()
INTENTS = "login|log in|logon|log on|signin|sign in|sign on|account|my account|support|help|help center|customer service|contact|docs|web docs|documentation|official site|official website|website|homepage|home page|download|portal|tracking|check in|careers|investor relations".split("|")
FILLERS = "best official online".split()
#: Postings of a term that one task meets.
BLOCK = 50_000


def field_words(spark, d) -> DataFrame:
    """domain, field, term, tf: the words of a site's fields; a link text counts 1 + ln(uses) times, REPEATS at most."""
    items = merge.site_merge(spark, d).select(F.col("id").alias("domain"), "title", "about")
    label = F.substring_index("domain", ".", 1)
    meta = table(spark, d, "homepage_meta").filter("description is not null and domain is not null").groupBy("domain").agg(F.max(F.struct("fetched_at", "meta_id", "description"))["description"].alias("description"))
    names = table(spark, d, "site_items").filter("id is not null").select(F.col("id").alias("domain"), F.explode("names").alias("name")).distinct()
    bag = lambda field, df, w, n=1: df.select("domain", F.lit(field).alias("field"), F.explode(w).alias("term"), F.lit(n).alias("n"))
    out = bag("label", items, F.array_distinct(F.concat(T.words(F.replace(label, F.lit("-"), F.lit(" "))), F.array(T.joined(label)))))
    out = out.union(bag("joined", items, F.array(T.joined(F.col("title"))))).union(bag("title", items, T.words(F.col("title")))).union(bag("about", items, T.words(F.col("about"))))
    out = out.union(bag("description", meta, T.words(F.col("description")))).union(bag("aliases", names, T.words(F.col("name"))))
    uses = table(spark, d, "anchors").filter("target_domain is not null").groupBy(F.col("target_domain").alias("domain"), T.normalize(F.col("anchor_text")).alias("text")).agg(F.count("*").alias("uses")).join(items.select("domain"), "domain", "left_semi")
    repeats = F.round(F.least(1 + F.log("uses"), F.lit(REPEATS))).cast("int")
    out = out.union(uses.select("domain", F.lit("anchors").alias("field"), F.explode(F.split("text", " ")).alias("term"), repeats.alias("n")))
    return out.filter("term <> ''").groupBy("domain", "field", "term").agg(F.sum("n").alias("tf"))


def clauses(queries: DataFrame, words: Column) -> DataFrame:
    """query, field, term, boost, other: what a query asks of each field. other: the word whose other number the term is, else null.

    Names share their boost among the words; small words after the first, fillers and questions name nothing. Of two clauses
    of one field and term the stronger counts.
    """
    q = queries.select("query", F.array_distinct(words).alias("w")).filter(F.size("w") > 0).withColumn("n", F.size("w"))
    asked = F.get("w", F.lit(0)).isin(*QUESTIONS)
    rows = q.select("query", "n", asked.alias("asked"), F.posexplode("w").alias("i", "word"), F.array_join("w", "").alias("whole"))
    rows = rows.select("*", other_number(F.col("word")).alias("many"))
    small, filler = (F.col("i") > 0) & F.col("word").isin(*FUNCTION_WORDS), (F.col("n") > 1) & F.col("word").isin(*FILLERS)
    named = (F.col("n") == 1) | ~small
    entry = lambda f, term, boost, other, ok: F.when(ok, F.struct(F.lit(f).alias("field"), term.alias("term"), boost.cast("double").alias("boost"), other.alias("other")))
    out, none = [], F.lit(None).cast("string")
    for f, b in BOOSTS.items():
        ok = (named & ~F.col("asked") & ~filler if f in NAMES else F.lit(True)) & (~filler if f in ("title", "anchors") else F.lit(True))
        boost = F.lit(b) / F.col("n") if f in ("label", "joined") else F.lit(b)
        out.append(entry(f, F.col("word"), boost, none, ok))
        if f not in ("label", "joined"):
            out.append(entry(f, F.col("many"), F.lit(b * OTHER), F.col("word"), ok & F.col("many").isNotNull()))
    out += [entry(f, F.col("whole"), F.lit(WHOLE), none, (F.col("i") == 0) & ~F.col("asked")) for f in ("label", "joined")]
    e = rows.select("query", F.explode(F.array_compact(F.array(*out))).alias("e")).select("query", "e.*")
    return e.groupBy("query", "field", "term").agg(F.max("boost").alias("boost"), F.min("other").alias("other"))


def field_scores(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """query, domain, score: boosted BM25 over the fields; postings: domain, field, term, tf; asked: clauses. Lists of more than BLOCK postings are met in blocks."""
    postings = keep(postings)
    n = postings.select("domain").distinct().count()
    lengths = postings.groupBy("domain", "field").agg(F.sum("tf").alias("length"))
    means = lengths.groupBy("field").agg(F.avg("length").alias("mean"))
    df = keep(postings.groupBy("field", "term").agg(F.count("*").alias("df")))
    idf = lambda c: F.log1p((n - F.col(c) + 0.5) / (F.col(c) + 0.5))
    typed = df.select("field", F.col("term").alias("other"), F.col("df").alias("other_df"))
    rarity = F.when(F.col("other").isNull(), 1.0).otherwise(F.least(idf("other_df") / idf("df"), F.lit(1.0)))
    a = asked.join(df, ["field", "term"]).join(typed, ["field", "other"], "left").withColumn("other_df", F.coalesce("other_df", F.lit(0)))
    a = a.select("query", "field", "term", (F.col("boost") * rarity * idf("df")).alias("weight"), F.explode(F.sequence(F.lit(0), F.floor(F.col("df") / BLOCK))).alias("part"))
    p = postings.join(df.select("field", "term", (F.floor(F.col("df") / BLOCK) + 1).alias("parts")), ["field", "term"]).withColumn("part", F.pmod(F.xxhash64("domain"), F.col("parts")))
    hits = p.join(a, ["field", "term", "part"]).join(lengths, ["domain", "field"]).join(F.broadcast(means), "field")  # one row a field
    k1, b = search.K1, search.B
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hits.groupBy("query", "domain").agg(F.sum(part).alias("score"))


def _first(df: DataFrame, k: int, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k)


def bm25f_top(spark, d):
    """The ten best sites of each query over seven boosted fields."""
    scores = field_scores(field_words(spark, d), clauses(search._queries(spark, d), T.words(F.col("query"))))
    return _first(scores.select("query", "domain", F.round("score", 4).alias("score")), 10, F.desc("score"), "domain")


def pool(spark, d) -> DataFrame:
    """The hits the passes work on: query, domain, text (score over the best), link_score, official, title, description, name_words, words, and whether the name is the whole query."""
    scores = field_scores(field_words(spark, d), clauses(search._queries(spark, d), T.words(F.col("query"))))
    top = _first(scores.select("query", "domain", F.round("score", 4).alias("bm25")), CANDIDATES, F.desc("bm25"), "domain")
    w = Window.partitionBy("query")
    sites = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("link_score"), F.coalesce("official_site", F.lit(False)).alias("official"))
    items = merge.site_merge(spark, d).select(F.col("id").alias("domain"), "title", F.col("about").alias("description"))
    rows = top.withColumn("text", F.round(F.col("bm25") / F.max("bm25").over(w), 5)).join(sites, "domain", "left").join(items, "domain")
    rows = rows.select("*", T.words(F.col("query")).alias("w"), T.joined(F.substring_index("domain", ".", 1)).alias("label"), T.joined(F.col("title")).alias("name"))
    words = F.col("w")
    leading = lambda name: F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda k: F.when(F.array_join(F.slice(words, F.lit(1), k), "") == name, k).otherwise(0))), F.lit(0))
    named = F.greatest(leading(F.col("label")), leading(F.col("name")))
    return rows.select("query", "domain", "text", F.coalesce("link_score", F.lit(0.0)).alias("link_score"), F.coalesce("official", F.lit(False)).alias("official"), "title", "description", named.alias("name_words"), F.size(words).alias("words"))


def scored(hits: DataFrame) -> DataFrame:
    """hits with score and tier: alpha x prior + trust x ((1 - alpha) x text + name bonus), the prior faded out below a floor of text."""
    named = F.col("name_words") == F.col("words")
    question = F.get(F.split(F.lower("query"), " "), F.lit(0)).isin(*QUESTIONS)
    alpha = F.when(F.col("name_words") > 0, ALPHA).otherwise(DESCRIBED)
    floor = F.when(question, QUESTION_FLOOR).when(F.col("name_words") > 0, NAMED_FLOOR).otherwise(DESCRIBED_FLOOR)
    prior = F.col("link_score") * F.least(F.col("text") / floor, F.lit(1.0))
    trust = UNTRUSTED + (1 - UNTRUSTED) * F.least(F.col("link_score") / TRUSTED, F.lit(1.0))
    bonus = LABEL_BONUS * F.col("name_words") / F.col("words")
    score = alpha * prior + trust * ((1 - alpha) * F.col("text") + bonus)
    return hits.withColumn("score", F.round(score, 4)).withColumn("tier", F.when(named | (F.col("text") >= 0.2), 1).otherwise(0)).withColumn("named", named)


def weak_capped(hits: DataFrame) -> DataFrame:
    """Scores of the weak tier kept below the last score above it."""
    w = Window.partitionBy("query")
    border = F.min(F.when(F.col("tier") > 0, F.col("score"))).over(w)
    return hits.withColumn("score", F.when((F.col("tier") == 0) & border.isNotNull(), F.least(F.col("score"), F.round(border - 0.0001, 4))).otherwise(F.col("score")))


def named_share_cut(hits: DataFrame) -> DataFrame:
    """Without what lies below NAMED_SHARE of the first score, where the first is a well-known site the query names."""
    w = Window.partitionBy("query").orderBy(F.desc("tier"), F.desc("score"), F.desc("link_score"), "domain")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = hits.select("*", (first("named") & (first("link_score") >= KNOWN)).alias("_known"), first("score").alias("_top"))
    return rows.filter(~F.col("_known") | F.col("named") | (F.col("score") >= NAMED_SHARE * F.col("_top"))).drop("_known", "_top")


def subject(query: Column) -> Column:
    """The query without the intent words it ends with; null where it ends with none or has no others."""
    plain = T.normalize(query)
    cut = F.regexp_replace(plain, rf"(?: (?:{'|'.join(sorted(INTENTS, key=len, reverse=True))}))+$", "")
    return F.when(cut != plain, cut)


def untitled_last(hits: DataFrame) -> DataFrame:
    """Bare sites (no title, unknown, not official, not the query's name) of scores below nine tenths of the first go behind the others."""
    w = Window.partitionBy("query")
    bare = F.col("title").isNull() & (F.col("link_score") < COPYCAT) & ~F.col("official") & (F.col("name_words") == 0)
    return hits.withColumn("late", (bare & (F.col("score") < 0.9 * F.max("score").over(w))).cast("int"))


def without_look_alikes(hits: DataFrame) -> DataFrame:
    """Without little-known sites that borrow the name of a well-known site the query names: its bare label elsewhere, its label
    split by hyphens, or the query's name and intent words as one label."""
    label = F.substring_index("domain", ".", 1)
    plain = F.translate(label, "-_", "")
    brands = hits.filter(F.col("named") & (F.col("link_score") >= KNOWN)).groupBy("query").agg(F.collect_set(label).alias("_brands"))  # the named sites of one query
    rows = hits.join(brands, "query", "left")
    spelled = F.when(subject(F.col("query")).isNotNull(), T.joined(F.col("query")))
    bare = F.col("title").isNull() & F.col("description").isNull()
    like = (bare & F.array_contains("_brands", label)) | ((plain != label) & F.array_contains("_brands", plain)) | F.coalesce(spelled == plain, F.lit(False))
    bad = F.col("_brands").isNotNull() & (F.col("link_score") < KNOWN) & ~F.col("official") & like
    return rows.filter(~F.coalesce(bad, F.lit(False))).drop("_brands")


def without_title_copies(hits: DataFrame) -> DataFrame:
    """Without sites that are not official and carry a better-linked hit's title: those nobody links to, and little-known ones whose
    title is no name of their own and that describe nothing else."""
    title, label = T.normalize(F.col("title")), T.joined(F.substring_index("domain", ".", 1))
    key = F.when(title != "", title)
    joined = T.joined(F.col("title"))
    own = F.coalesce(F.contains(joined, label) | F.contains(label, joined), F.lit(False))
    w = Window.partitionBy("query", key).orderBy(F.desc("link_score"), "domain")
    rows = hits.select("*", key.alias("_k"), own.alias("_own"), F.coalesce(T.normalize(F.col("description")), F.lit("")).alias("_d"), F.first("link_score").over(w).alias("_best"), F.row_number().over(w).alias("_n"))
    same = F.first(F.coalesce(T.normalize(F.col("description")), F.lit(""))).over(w) == F.coalesce(T.normalize(F.col("description")), F.lit(""))
    rows = rows.withColumn("_same", same | (F.col("_d") == ""))
    copy = F.col("_k").isNotNull() & ~F.col("official") & (F.col("_n") > 1) & (((F.col("_best") > F.col("link_score")) & (F.col("link_score") < COPYCAT)) | ((F.col("link_score") < KNOWN) & ~F.col("_own") & F.col("_same")))
    return rows.filter(~copy).select(hits.columns)


def listed(hits: DataFrame, k: int = 10) -> DataFrame:
    """The passes in their order, and the first k of each query."""
    rows = untitled_last(named_share_cut(weak_capped(scored(hits))))
    rows = without_title_copies(without_look_alikes(rows))
    return _first(rows, k, "late", F.desc("tier"), F.desc("score"), F.desc("link_score"), "domain")


def blended_full(spark, d):
    """Fielded retrieval, 200 candidates, the blended score and all passes: ten hits of each query."""
    return listed(pool(spark, d)).select("query", "domain", "score", "place")


def _cases(spark, d) -> DataFrame:
    """Hits of invented queries: each site's own label as the query, the site itself, its name split by a hyphen, its bare label elsewhere, and a copy of its title."""
    sites = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("link_score"), F.coalesce("official_site", F.lit(False)).alias("official"))
    items = merge.site_merge(spark, d).filter("title is not null").select(F.col("id").alias("domain"), "title", F.col("about").alias("description"))
    label = F.substring_index("domain", ".", 1)
    own = sites.join(items, "domain").select(F.when(F.length(label) % 2 == 0, F.concat(label, F.lit(" login"))).otherwise(label).alias("query"), F.col("domain"), label.alias("label"), F.greatest("link_score", F.lit(0.5)).alias("link_score"), "official", "title", "description", F.lit(True).alias("named"))
    case = lambda name, title, score: F.struct(name.alias("domain"), title.alias("title"), F.lit(score).alias("link_score"))
    none = F.lit(None).cast("string")
    split = F.concat(F.substring("label", 1, 2), F.lit("-"), F.expr("substring(label, 3)"), F.lit(".fake"))
    made = own.select("query", F.explode(F.array(case(split, F.lit("Something"), 0.1), case(F.concat("label", F.lit(".bare")), none, 0.1), case(F.concat("label", F.lit("login.fake")), F.lit("Log in"), 0.1), case(F.lit("nobody.copy"), F.col("title"), 0.01), case(F.lit("other.copy"), F.lit("Its own words"), 0.01))).alias("x"))
    made = made.select("query", "x.domain", "x.link_score", F.lit(False).alias("official"), "x.title", none.alias("description"), F.lit(False).alias("named"))
    return own.drop("label").union(made)


def look_alikes(spark, d):
    """Look-alikes among invented hits of known sites."""
    hits = _cases(spark, d)
    return hits.join(without_look_alikes(hits).select("query", "domain"), ["query", "domain"], "left_anti").select("query", "domain")


def title_copies(spark, d):
    """Copies of titles among invented hits of known sites."""
    hits = _cases(spark, d)
    return hits.join(without_title_copies(hits).select("query", "domain"), ["query", "domain"], "left_anti").select("query", "domain")


QUERIES = {f.__name__: f for f in (bm25f_top, blended_full, look_alikes, title_copies)}
_N = "(" + ", ".join(f"'{w}'" for w in FUNCTION_WORDS) + ")"
_F = "(" + ", ".join(f"'{w}'" for w in FILLERS) + ")"
_Q = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in QUESTIONS) + ")"


def _field_sql() -> str:
    from webloom.operators.strings import SAME_IN_BOTH, _singular_sql

    bag = lambda field, source, w: f"SELECT domain, '{field}' AS field, unnest({w}) AS term, 1 AS n FROM {source}"
    label = "string_split(domain, '.')[1]"
    lw = T.words_sql(f"replace({label}, '-', ' ')")
    bags = [bag("label", "it", f"list_distinct(list_append({lw}, array_to_string({T.words_sql(label)}, '')))"), bag("joined", "it", f"[array_to_string({T.words_sql('title')}, '')]"), bag("title", "it", T.words_sql("title")), bag("about", "it", T.words_sql("about")), bag("description", "me", T.words_sql("description")), bag("aliases", "na", T.words_sql("name"))]
    many = "CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN word[:-2] || 'ies' WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' ELSE word || 's' END"
    other = f"CASE WHEN NOT regexp_full_match(word, '[a-z]{{4,}}') OR word IN ({', '.join(repr(w) for w in SAME_IN_BOTH)}) THEN NULL WHEN {_singular_sql('word')} <> word THEN CASE WHEN length({_singular_sql('word')}) > 2 THEN {_singular_sql('word')} END WHEN NOT regexp_matches(word, '(ss|us|is)$') AND {_singular_sql('many')} = word THEN many END"
    parts = []
    for f, b in BOOSTS.items():
        ok = "true"
        if f in NAMES:
            ok = f"(n = 1 OR NOT (i > 1 AND word IN {_N})) AND NOT asked AND NOT (n > 1 AND word IN {_F})"
        elif f in ("title", "anchors"):
            ok = f"NOT (n > 1 AND word IN {_F})"
        boost = f"{b}::DOUBLE / n" if f in ("label", "joined") else f"{b}::DOUBLE"
        parts.append(f"SELECT query, '{f}' AS field, word AS term, {boost} AS boost, NULL AS other FROM qo WHERE {ok}")
        if f not in ("label", "joined"):
            parts.append(f"SELECT query, '{f}', other, {b} * {OTHER}::DOUBLE, word FROM qo WHERE other IS NOT NULL AND {ok}")
    parts += [f"SELECT query, '{f}', whole, {WHOLE}::DOUBLE, NULL FROM qo WHERE i = 1 AND NOT asked" for f in ("label", "joined")]
    k1, b = search.K1, search.B
    return f"""WITH sm AS ({merge.SQL['site_merge']}), it AS (SELECT id AS domain, title, about FROM sm), me AS (SELECT domain, max({{'a': fetched_at, 'b': meta_id, 'c': description}}).c AS description FROM homepage_meta WHERE description IS NOT NULL AND domain IS NOT NULL GROUP BY 1),
na AS (SELECT DISTINCT id AS domain, name FROM (SELECT id, unnest(names) AS name FROM site_items WHERE id IS NOT NULL)), us AS (SELECT target_domain AS domain, array_to_string({T.words_sql('anchor_text')}, ' ') AS text, count(*) AS uses FROM anchors WHERE target_domain IN (SELECT domain FROM it) GROUP BY 1, 2),
bags AS ({' UNION ALL '.join(bags)} UNION ALL SELECT domain, 'anchors', unnest(string_split(text, ' ')), round(least(1 + ln(uses), {REPEATS}))::INT FROM us),
po AS (SELECT domain, field, term, sum(n) AS tf FROM bags WHERE term <> '' GROUP BY 1, 2, 3), le AS (SELECT domain, field, sum(tf) AS length FROM po GROUP BY 1, 2), av AS (SELECT field, avg(length) AS mean FROM le GROUP BY 1), nn AS (SELECT count(DISTINCT domain) AS nd FROM po), df AS (SELECT field, term, count(*) AS df FROM po GROUP BY 1, 2),
qw AS (SELECT query, w, len(w) AS n, w[1] IN {_Q} AS asked, array_to_string(w, '') AS whole FROM (SELECT query, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM (SELECT DISTINCT query, {T.words_sql('query')} AS w FROM candidate_lists WHERE query IS NOT NULL)) WHERE len(w) > 0), qe AS (SELECT *, unnest(range(1, n + 1)) AS i FROM qw), qm AS (SELECT *, w[i] AS word FROM qe), qp AS (SELECT *, {many} AS many FROM qm), qo AS (SELECT *, {other} AS other FROM qp),
cl AS (SELECT query, field, term, max(boost) AS boost, min(other) AS other FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 3),
cw AS (SELECT cl.query, cl.field, cl.term, boost * ln(1 + (nd - d.df + 0.5) / (d.df + 0.5)) * CASE WHEN cl.other IS NULL THEN 1 ELSE least(ln(1 + (nd - coalesce(o.df, 0) + 0.5) / (coalesce(o.df, 0) + 0.5)) / ln(1 + (nd - d.df + 0.5) / (d.df + 0.5)), 1) END AS weight FROM cl JOIN df d ON cl.field = d.field AND cl.term = d.term LEFT JOIN df o ON cl.field = o.field AND cl.other = o.term, nn),
fs AS (SELECT query, domain, sum(weight * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * length / mean))) AS score FROM cw JOIN po USING (field, term) JOIN le USING (domain, field) JOIN av USING (field) GROUP BY 1, 2)"""


def _full_sql() -> str:
    words = T.words_sql("query")
    lead = lambda name: f"list_max(list_transform(range(1, greatest(len(w), 1) + 1), lambda k: CASE WHEN array_to_string(w[:k], '') = {name} THEN k ELSE 0 END))"
    intents = "|".join(sorted(INTENTS, key=len, reverse=True))
    return f"""{_field_sql()}, {merge._SIGNALS}, {merge._SCORE}, tp AS (SELECT * FROM (SELECT query, domain, round(score, 4) AS bm25, row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, domain) AS pl FROM fs) WHERE pl <= {CANDIDATES}),
po1 AS (SELECT tp.query, tp.domain, round(bm25 / max(bm25) OVER (PARTITION BY tp.query), 5) AS text, coalesce(round(sc.score, 5), 0) AS link_score, coalesce(s.o, false) AS official, title, about AS description, {words} AS w FROM tp JOIN it USING (domain) LEFT JOIN sc ON sc.domain = tp.domain LEFT JOIN s ON s.domain = tp.domain),
po2 AS (SELECT *, len(w) AS words, greatest({lead("array_to_string(" + T.words_sql("string_split(domain, '.')[1]") + ", '')")}, {lead("array_to_string(" + T.words_sql('title') + ", '')")}) AS name_words FROM po1),
sd1 AS (SELECT *, name_words = words AS named, CASE WHEN name_words = words OR text >= 0.2 THEN 1 ELSE 0 END AS tier, CASE WHEN name_words > 0 THEN {ALPHA} ELSE {DESCRIBED} END::DOUBLE AS alpha, CASE WHEN string_split(lower(query), ' ')[1] IN {_Q} THEN {QUESTION_FLOOR} WHEN name_words > 0 THEN {NAMED_FLOOR} ELSE {DESCRIBED_FLOOR} END::DOUBLE AS flr FROM po2),
sd2 AS (SELECT *, round(alpha * link_score * least(text / flr, 1) + ({UNTRUSTED} + {1 - UNTRUSTED} * least(link_score / {TRUSTED}, 1)) * ((1 - alpha) * text + {LABEL_BONUS} * name_words / words), 4) AS score0 FROM sd1),
sd3 AS (SELECT *, min(score0) FILTER (tier > 0) OVER (PARTITION BY query) AS border FROM sd2), sd4 AS (SELECT *, CASE WHEN tier = 0 AND border IS NOT NULL THEN least(score0, round(border - 0.0001, 4)) ELSE score0 END AS score FROM sd3),
sd5 AS (SELECT *, first_value(named) OVER v AND first_value(link_score) OVER v >= {KNOWN} AS kn, first_value(score) OVER v AS tops FROM sd4 WINDOW v AS (PARTITION BY query ORDER BY tier DESC, score DESC, link_score DESC, domain)), sd6 AS (SELECT * FROM sd5 WHERE NOT kn OR named OR score >= {NAMED_SHARE} * tops),
hits AS (SELECT *, CASE WHEN title IS NULL AND link_score < {COPYCAT} AND NOT official AND name_words = 0 AND score < 0.9 * max(score) OVER (PARTITION BY query) THEN 1 ELSE 0 END AS late FROM sd6)"""


def _passes_sql() -> str:
    intents = "|".join(sorted(INTENTS, key=len, reverse=True))
    plain = f"array_to_string({T.words_sql('query')}, ' ')"
    label = "string_split(domain, '.')[1]"
    bare = f"replace(replace({label}, '-', ''), '_', '')"
    joined, lj = f"array_to_string({T.words_sql('title')}, '')", f"array_to_string({T.words_sql(label)}, '')"
    desc = f"coalesce(array_to_string({T.words_sql('description')}, ' '), '')"
    return f"""br AS (SELECT query, list(DISTINCT {label}) AS brands FROM hits WHERE named AND link_score >= {KNOWN} GROUP BY 1),
la1 AS (SELECT hits.*, brands, {label} AS lb, {bare} AS pb, CASE WHEN regexp_replace({plain}, '( ({intents}))+$', '') <> {plain} THEN replace({plain}, ' ', '') END AS spelled FROM hits LEFT JOIN br USING (query)),
la2 AS (SELECT *, coalesce(brands IS NOT NULL AND link_score < {KNOWN} AND NOT official AND ((title IS NULL AND description IS NULL AND list_contains(brands, lb)) OR (pb <> lb AND list_contains(brands, pb)) OR coalesce(spelled = pb, false)), false) AS alike FROM la1)"""


def _copies_sql(source: str) -> str:
    label = "string_split(domain, '.')[1]"
    joined, lj = f"array_to_string({T.words_sql('title')}, '')", f"array_to_string({T.words_sql(label)}, '')"
    desc = f"coalesce(array_to_string({T.words_sql('description')}, ' '), '')"
    return f"""tc1 AS (SELECT *, nullif(array_to_string({T.words_sql('title')}, ' '), '') AS tk, coalesce(contains({joined}, {lj}) OR contains({lj}, {joined}), false) AS own, {desc} AS ds FROM {source}),
tc2 AS (SELECT *, first_value(link_score) OVER v AS best, row_number() OVER v AS rn, first_value(ds) OVER v = ds OR ds = '' AS same FROM tc1 WINDOW v AS (PARTITION BY query, tk ORDER BY link_score DESC, domain)),
tc3 AS (SELECT *, coalesce(tk IS NOT NULL AND NOT official AND rn > 1 AND ((best > link_score AND link_score < {COPYCAT}) OR (link_score < {KNOWN} AND NOT own AND same)), false) AS copied FROM tc2)"""


_CASES = f"""{merge._SIGNALS}, {merge._SCORE}, sm AS ({merge.SQL['site_merge']}), ow AS (SELECT sc.domain, string_split(sc.domain, '.')[1] AS label, greatest(round(sc.score, 5), 0.5) AS link_score, coalesce(s.o, false) AS official, title, about AS description FROM sc JOIN s ON s.domain = sc.domain JOIN sm ON sm.id = sc.domain WHERE title IS NOT NULL),
oq AS (SELECT *, CASE WHEN length(label) % 2 = 0 THEN label || ' login' ELSE label END AS query FROM ow),
hits AS (SELECT query, domain, link_score, official, title, description, true AS named FROM oq UNION ALL SELECT query, label[:2] || '-' || label[3:] || '.fake', 0.1, false, 'Something', NULL, false FROM oq UNION ALL SELECT query, label || '.bare', 0.1, false, NULL, NULL, false FROM oq UNION ALL SELECT query, label || 'login.fake', 0.1, false, 'Log in', NULL, false FROM oq UNION ALL SELECT query, 'nobody.copy', 0.01, false, title, NULL, false FROM oq UNION ALL SELECT query, 'other.copy', 0.01, false, 'Its own words', NULL, false FROM oq)"""
SQL = {
    "bm25f_top": f"{_field_sql()}, r AS (SELECT query, domain, round(score, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, domain) AS place FROM fs) SELECT * FROM r WHERE place <= 10",
    "blended_full": f"{_full_sql()}, {_passes_sql()}, la3 AS (SELECT * EXCLUDE (lb, pb, spelled, brands) FROM la2 WHERE NOT alike), {_copies_sql('la3')}, z AS (SELECT query, domain, score, row_number() OVER (PARTITION BY query ORDER BY late, tier DESC, score DESC, link_score DESC, domain) AS place FROM tc3 WHERE NOT copied) SELECT * FROM z WHERE place <= 10",
    "look_alikes": f"WITH {_CASES}, {_passes_sql()} SELECT query, domain FROM la2 WHERE alike",
    "title_copies": f"WITH {_CASES}, {_copies_sql('hits')} SELECT query, domain FROM tc3 WHERE copied",
}
