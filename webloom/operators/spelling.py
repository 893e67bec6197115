"""Spelling: allowed edits, a noisy channel mined from the words themselves, backoff, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators import evaluation, identity, merge
from webloom.operators.strings import other_number
from webloom.plans.lineage import keep
from webloom.sources.tables import table

# Texts from which on a word is known, how often commoner a correction is, least link score of a name's correction,
# how often rarer a mined slip is, and share of a word's own frequency where no pair is known.
KNOWN, COMMONER, NAME_SCORE, RARER, BACKOFF = 20, 20, 0.3, 10, 0.4


def most_edits(word: Column) -> Column:
    """Edits allowed in a word: none up to 3 letters, one up to 7, two beyond."""
    return F.when(F.length(word) <= 3, 0).when(F.length(word) <= 7, 1).otherwise(2)


def _less(w: Column, most: int) -> Column:
    """Hashes of a word and of what it is without one letter, for pairs of one edit, and of what it is without two if it has eight and more and
    `most` allows two edits. Longer words meet others in the latter; in the former, then, only words of eight letters can meet one of seven."""
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    hashes = lambda x, n: F.transform(x, lambda y: F.xxhash64(F.lit(n), y))
    none = F.array().cast("array<bigint>")
    one = F.concat(F.array(w), cut(w))
    if most == 1:
        return F.when(F.length(w) > 3, F.array_distinct(hashes(one, 1))).otherwise(none)
    two = lambda: F.array_distinct(hashes(F.concat(one, F.flatten(F.transform(cut(w), cut))), 2))
    near = F.when(F.length(w).between(4, 8), F.array_distinct(hashes(one, 1))).otherwise(none)
    return F.concat(near, F.when(F.length(w) > 7, two()).otherwise(none))


def near_words(rare: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """word, fix, edits: words of `rare` (word) and of `known` (fix) within the edits that both allow, and within `most` (1 or 2);
    they meet in hashes of what letters less make of them. The join is told to sort: a planner takes exploded words for as small as the words, and would broadcast them."""
    a = rare.select("word", F.explode(_less(F.col("word"), most)).alias("form"))
    b = known.select("fix", F.explode(_less(F.col("fix"), most)).alias("form"))
    least = F.least(most_edits(F.col("word")), most_edits(F.col("fix")), F.lit(most))
    edits = F.levenshtein("word", "fix", 2)  # -1 beyond
    return a.hint("merge").join(b, "form").filter("word <> fix").select("word", "fix", edits.alias("edits")).filter((F.col("edits") >= 0) & (F.col("edits") <= least)).distinct()


def _known(spark, d) -> DataFrame:
    return evaluation.unigrams(spark, d).filter(F.regexp_like("word", F.lit("^[a-z]{4,}$")))


def rare_word_fixes(spark, d):
    """Words of fewer than KNOWN texts with the commonest word near them: of the same first letter, COMMONER times as common, and not their other number."""
    u = keep(_known(spark, d))
    rare = u.filter(F.col("n") < KNOWN).select("word", "n")
    known = u.filter(F.col("n") >= KNOWN).select(F.col("word").alias("fix"), F.col("n").alias("fix_n"))
    near = near_words(rare, known).join(rare, "word").join(known, "fix")
    good = (F.substring("word", 1, 1) == F.substring("fix", 1, 1)) & (F.col("fix_n") >= COMMONER * F.col("n")) & ~F.coalesce(other_number(F.col("word")) == F.col("fix"), F.lit(False))
    w = Window.partitionBy("word").orderBy(F.desc("fix_n"), "fix")
    return near.filter(good).withColumn("place", F.row_number().over(w)).filter("place = 1").select("word", "fix", "n", "fix_n")


def _edit(word: Column, fix: Column) -> Column:
    """The one edit between words of Levenshtein distance 1, as what was typed > what was meant around their common ends."""
    n = F.least(F.length(word), F.length(fix))
    head = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(word, F.lit(1), i) == F.substring(fix, F.lit(1), i))), F.lit(0))
    tail = lambda w: F.substring(w, head + 1, F.length(w))
    rest = n - head
    back = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), rest), lambda i: F.right(tail(word), i) == F.right(tail(fix), i))), F.lit(0))
    core = lambda w: F.substring(tail(w), F.lit(1), F.length(tail(w)) - back)
    return F.concat(core(word), F.lit(">"), core(fix))


def edit_rules(spark, d):
    """How often each edit is seen between a word RARER times rarer than its near word, and its part of all."""
    u = keep(_known(spark, d))
    a = u.select("word", "n")
    b = u.filter(F.col("n") >= RARER).select(F.col("word").alias("fix"), F.col("n").alias("fix_n"))
    pairs = near_words(a, b).filter("edits = 1").join(a, "word").join(b, "fix").filter(F.col("fix_n") >= RARER * F.col("n"))
    rules = pairs.groupBy(_edit(F.col("word"), F.col("fix")).alias("edit")).agg(F.count("*").alias("pairs"), F.sum("n").alias("slips"))
    whole = rules.agg(F.sum("slips").alias("all"))
    return rules.crossJoin(F.broadcast(whole)).select("edit", "pairs", "slips", F.round(F.log((F.col("slips") + 1) / (F.col("all") + 1)), 5).alias("cost"))  # one row


def channel_fixes(spark, d):
    """Fixes of one edit whose channel cost is made up for by how much commoner the fix is; a first letter changed costs two more."""
    u = keep(_known(spark, d))
    rare = u.filter(F.col("n") < KNOWN).select("word", "n")
    known = u.filter(F.col("n") >= KNOWN).select(F.col("word").alias("fix"), F.col("n").alias("fix_n"))
    pairs = near_words(rare, known).filter("edits = 1").join(rare, "word").join(known, "fix").withColumn("edit", _edit(F.col("word"), F.col("fix")))
    cost = edit_rules(spark, d).select("edit", "cost")
    first = F.when(F.substring("word", 1, 1) != F.substring("fix", 1, 1), 2.0).otherwise(0.0)
    gain = F.col("cost") - first + F.log(F.col("fix_n") / F.col("n"))
    return pairs.join(cost, "edit").select("word", "fix", F.round(gain, 4).alias("gain")).filter("gain >= 0")


def pair_chances(spark, d):
    """Chance of a word after another, of the pairs found twice and more: their part of the first word's, else BACKOFF of the word's own part."""
    pairs = identity.word_bigrams(spark, d).filter("n >= 2").select(F.split("bigram", " ")[0].alias("a"), F.split("bigram", " ")[1].alias("b"), "n")
    words = T.words(F.col("description"))
    uses = table(spark, d, "homepage_meta").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    whole = uses.agg(F.sum("uses").alias("all"))
    rows = pairs.join(uses.select(F.col("word").alias("a"), F.col("uses").alias("na")), "a").join(uses.select(F.col("word").alias("b"), F.col("uses").alias("nb")), "b").crossJoin(F.broadcast(whole))  # one row
    return rows.select("a", "b", F.round(F.log(F.col("n") / F.col("na")), 5).alias("pair"), F.round(F.log(BACKOFF * F.col("nb") / F.col("all")), 5).alias("backoff"))


def name_fixes(spark, d):
    """Names typed with a slip (here each site's label without its third letter) and the known site of link score NAME_SCORE and more that is meant, the best linked of several."""
    sites = merge.with_link_score(merge.signals(spark, d)).select(T.joined(F.substring_index("domain", ".", 1)).alias("fix"), "domain", F.round("link_score", 5).alias("score"))
    known = keep(sites.filter((F.col("score") >= NAME_SCORE) & F.regexp_like("fix", F.lit("^[a-z]{5,}$"))))
    typed = known.select(F.concat(F.substring("fix", 1, 2), F.expr("substring(fix, 4)")).alias("word")).distinct()
    typed = typed.join(sites.select(F.col("fix").alias("word")), "word", "left_anti")
    near = near_words(typed, known.select("fix").distinct(), 1).join(known, "fix")  # the name that a slip was made of is one edit away
    w = Window.partitionBy("word").orderBy("edits", F.desc("score"), "domain")
    return near.withColumn("place", F.row_number().over(w)).filter("place = 1").select("word", "domain", "edits")


def domain_fixes(spark, d):
    """Typed hosts with a glued or doubled www, and the host of a site that is meant."""
    sites = merge.signals(spark, d).select("domain")
    typed = sites.select("domain", F.explode(F.array(F.concat(F.lit("www"), "domain"), F.concat(F.lit("www.www."), "domain"), F.concat(F.lit("wwww."), "domain"))).alias("typed"))
    bare = F.regexp_replace("typed", r"^(?:w{3,4}\.?)+", "")
    return typed.withColumn("meant", bare).join(sites.select(F.col("domain").alias("meant")), "meant", "left_semi").select("typed", "meant")


def corrections(spark, d):
    """What is done about each query whose words have a fix: applied if a word is unknown and its fix known, offered if the word is known too, else none."""
    fixes = rare_word_fixes(spark, d).select("word", "fix", "n")
    q = table(spark, d, "audit_cases").filter("query is not null").select("case_id", F.posexplode(T.words(F.col("query"))).alias("at", "word"))
    rows = q.join(fixes, "word", "left")
    one = rows.groupBy("case_id").agg(F.count("fix").alias("fixes"), F.min("n").alias("least"))
    return one.groupBy(F.when(F.col("fixes") == 0, "none").when(F.col("least") <= 1, "applied").otherwise("offered").alias("decision")).agg(F.count("*").alias("cases"))


def spelling_forms(spark, d):
    """Terms that a dictionary scan finds within the allowed edits of the first words of titles."""
    u = keep(_known(spark, d))
    first = table(spark, d, "site_items").select(F.get(T.words(F.col("title")), F.lit(0)).alias("word")).filter(F.regexp_like("word", F.lit("^[a-z]{4,}$"))).distinct()
    return near_words(first, u.select(F.col("word").alias("fix"))).groupBy("word").agg(F.count("*").alias("near"))


QUERIES = {f.__name__: f for f in (rare_word_fixes, edit_rules, channel_fixes, pair_chances, name_fixes, domain_fixes, corrections, spelling_forms)}
_U = f"{evaluation._UNIGRAMS}, k AS (SELECT * FROM u WHERE regexp_full_match(word, '[a-z]{{4,}}'))"
_MOST = lambda w: f"CASE WHEN length({w}) <= 3 THEN 0 WHEN length({w}) <= 7 THEN 1 ELSE 2 END"


def _near_sql(rare: str, known: str) -> str:
    return f"SELECT a.word, b.word AS fix, a.n, b.n AS fix_n, levenshtein(a.word, b.word) AS edits FROM {rare} a JOIN {known} b ON a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 2 WHERE levenshtein(a.word, b.word) <= least({_MOST('a.word')}, {_MOST('b.word')})"


def _other_sql(w: str) -> str:
    from webloom.operators.strings import SAME_IN_BOTH, _singular_sql

    many = f"(CASE WHEN regexp_matches({w}, '[^aeiou]y$') THEN {w}[:-2] || 'ies' WHEN regexp_matches({w}, '(s|x|z|ch|sh)$') THEN {w} || 'es' ELSE {w} || 's' END)"
    return f"(CASE WHEN NOT regexp_full_match({w}, '[a-z]{{4,}}') OR {w} IN ({', '.join(repr(x) for x in SAME_IN_BOTH)}) THEN NULL WHEN {_singular_sql(w)} <> {w} THEN CASE WHEN length({_singular_sql(w)}) > 2 THEN {_singular_sql(w)} END WHEN NOT regexp_matches({w}, '(ss|us|is)$') AND {_singular_sql(many)} = {w} THEN {many} END)"


_HEAD = "list_max(list_filter(range(0, least(length(word), length(fix)) + 1), lambda i: word[:i] = fix[:i]))"
_RULES = f"""rk AS (SELECT * FROM k WHERE n >= {RARER}), ep AS ({_near_sql('k', 'rk')}), e1 AS (SELECT *, {_HEAD} AS hd FROM ep WHERE edits = 1 AND fix_n >= {RARER} * n), e2 AS (SELECT *, word[hd + 1:] AS wt, fix[hd + 1:] AS ft FROM e1), e3 AS (SELECT *, list_max(list_filter(range(0, least(length(wt), length(ft)) + 1), lambda i: right(wt, i) = right(ft, i))) AS bk FROM e2),
ru AS (SELECT left(wt, length(wt) - bk) || '>' || left(ft, length(ft) - bk) AS edit, count(*) AS pairs, sum(n)::BIGINT AS slips FROM e3 GROUP BY 1), rc AS (SELECT edit, pairs, slips, round(ln((slips + 1) / (sum(slips) OVER () + 1)::DOUBLE), 5) AS cost FROM ru)"""
_RARE = f"rr AS (SELECT * FROM k WHERE n < {KNOWN}), kk AS (SELECT * FROM k WHERE n >= {KNOWN})"
_FIXES = f"{_RARE}, nf AS ({_near_sql('rr', 'kk')}), rf AS (SELECT word, fix, n, fix_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY fix_n DESC, fix) AS place FROM nf WHERE word[1] = fix[1] AND fix_n >= {COMMONER} * n AND NOT coalesce({_other_sql('word')} = fix, false)) WHERE place = 1)"
SQL = {
    "rare_word_fixes": f"WITH {_U}, {_FIXES} SELECT * FROM rf",
    "edit_rules": f"WITH {_U}, {_RULES} SELECT * FROM rc",
    "channel_fixes": f"WITH {_U}, {_RULES}, {_RARE}, c1 AS ({_near_sql('rr', 'kk')}), c2 AS (SELECT *, {_HEAD} AS hd FROM c1 WHERE edits = 1), c3 AS (SELECT *, word[hd + 1:] AS wt, fix[hd + 1:] AS ft FROM c2), c4 AS (SELECT *, list_max(list_filter(range(0, least(length(wt), length(ft)) + 1), lambda i: right(wt, i) = right(ft, i))) AS bk FROM c3), c5 AS (SELECT *, left(wt, length(wt) - bk) || '>' || left(ft, length(ft) - bk) AS edit FROM c4), z AS (SELECT word, fix, round(cost - CASE WHEN word[1] <> fix[1] THEN 2 ELSE 0 END + ln(fix_n / n::DOUBLE), 4) AS gain FROM c5 JOIN rc USING (edit)) SELECT * FROM z WHERE gain >= 0",
    "pair_chances": f"WITH b AS ({identity.SQL['word_bigrams']}), w AS (SELECT unnest({T.words_sql('description')}) AS word FROM homepage_meta), uu AS (SELECT word, count(*) AS uses FROM w GROUP BY 1) SELECT string_split(bigram, ' ')[1] AS a, string_split(bigram, ' ')[2] AS b, round(ln(n / x.uses::DOUBLE), 5) AS pair, round(ln({BACKOFF} * y.uses / (SELECT sum(uses) FROM uu)), 5) AS backoff FROM b JOIN uu x ON x.word = string_split(bigram, ' ')[1] JOIN uu y ON y.word = string_split(bigram, ' ')[2] WHERE n >= 2",
    "name_fixes": f"WITH {merge._SIGNALS}, {merge._SCORE}, st AS (SELECT array_to_string({T.words_sql("string_split(domain, '.')[1]")}, '') AS fix, domain, round(score, 5) AS score FROM sc), kn AS (SELECT * FROM st WHERE score >= {NAME_SCORE} AND regexp_full_match(fix, '[a-z]{{5,}}')), ty AS (SELECT DISTINCT fix[:2] || fix[4:] AS word FROM kn WHERE fix[:2] || fix[4:] NOT IN (SELECT fix FROM st)), nr AS (SELECT word, domain, score, levenshtein(word, fix) AS edits FROM ty JOIN kn ON word <> fix AND abs(length(word) - length(fix)) <= 2 WHERE levenshtein(word, fix) <= least({_MOST('word')}, {_MOST('fix')})), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY edits, score DESC, domain) AS place FROM nr) SELECT word, domain, edits FROM r WHERE place = 1",
    "domain_fixes": r"WITH s AS (SELECT DISTINCT domain FROM site_signals WHERE domain IS NOT NULL), t AS (SELECT unnest(['www' || domain, 'www.www.' || domain, 'wwww.' || domain]) AS typed FROM s), m AS (SELECT typed, regexp_replace(typed, '^(w{3,4}\.?)+', '') AS meant FROM t) SELECT * FROM m WHERE meant IN (SELECT domain FROM s)",
    "corrections": f"WITH {_U}, {_FIXES}, q AS (SELECT case_id, unnest({T.words_sql('query')}) AS word FROM audit_cases WHERE query IS NOT NULL), o AS (SELECT case_id, count(fix) AS fixes, min(rf.n) AS lo FROM q LEFT JOIN rf USING (word) GROUP BY 1) SELECT CASE WHEN fixes = 0 THEN 'none' WHEN lo <= 1 THEN 'applied' ELSE 'offered' END AS decision, count(*) AS cases FROM o GROUP BY 1",
    "spelling_forms": f"WITH {_U}, ft AS (SELECT DISTINCT {T.words_sql('title')}[1] AS word, 0 AS n FROM site_items), f2 AS (SELECT * FROM ft WHERE regexp_full_match(word, '[a-z]{{4,}}')), z AS ({_near_sql('f2', 'k')}) SELECT word, count(*) AS near FROM z GROUP BY 1",
}
