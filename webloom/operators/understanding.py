"""What a query asks for: operators, names, intents, questions, identifiers, dates, units and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import merge
from webloom.operators.passes import INTENTS, QUESTIONS, subject
from webloom.operators.strings import collapse, other_number, truncate
from webloom.sources.tables import table

# Longest query in characters; most words and characters of a query that is counted, and digits in a row it may not hold.
LONGEST, PICK_WORDS, PICK_CHARS, PICK_DIGITS = 200, 6, 64, 4
#: Words of topics, of registries and of services.
TOPICS = {"news": "news|headlines|latest", "medical": "symptoms|treatment|dosage|vaccine|clinic", "weather": "weather|forecast|temperature", "gambling": "casino|poker|betting|slots"}
REGISTRIES = {"pypi": "python|pip|pypi", "npm": "npm|node|javascript", "crates": "cargo|rust|crate"}
SERVICES = "youtube|instagram|github|linkedin|facebook"
BANGS = {"g": "https://search.example/?q=", "w": "https://pedia.example/w?search="}
#: Names of relations that a fact may be asked by.
RELATIONS = "capital|population|founder|height|area|price|opening hours|address"


def cleaned(query: Column) -> Column:
    """Blanks collapsed, at most LONGEST characters; null for an empty query."""
    return F.nullif(truncate(collapse(query), LONGEST), F.lit(""))


def operators(query: Column) -> dict[str, Column]:
    """sites, not_sites, phrases, excluded (arrays) and words of a query: site:, -site:, quotes, -word."""
    quoted = F.regexp_extract_all(query, F.lit(r'(?:^|\s)(-?["“”][^"“”]*["“”]?)'), 1)
    plain = F.regexp_replace(query, r'(?:^|\s)-?["“”][^"“”]*["“”]?', " ")
    tokens = F.filter(F.split(F.trim(plain), r"\s+"), lambda x: x != "")
    like = lambda x, p: F.regexp_like(x, F.lit(p))
    site = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"^-?site:(?:\*\.|\.)?(?:https?://)?", ""), "/.*$", "")
    inner = lambda x: T.normalize(F.regexp_replace(x, '^-?["“”]|["“”]$', ""))
    some = lambda a: F.filter(a, lambda x: x != "")
    minus = r"^-[^-\s]\S"
    return {
        "sites": F.transform(F.filter(tokens, lambda x: like(x, r"(?i)^site:\S")), site),
        "not_sites": F.transform(F.filter(tokens, lambda x: like(x, r"(?i)^-site:\S")), site),
        "phrases": some(F.transform(F.filter(quoted, lambda x: ~F.startswith(x, F.lit("-"))), inner)),
        "excluded": some(F.concat(F.transform(F.filter(tokens, lambda x: like(x, minus) & ~like(x, r"(?i)^-site:\S")), lambda x: T.normalize(F.substring(x, F.lit(2), F.length(x)))), F.transform(F.filter(quoted, lambda x: F.startswith(x, F.lit("-"))), inner))),
        "words": F.array_join(F.filter(tokens, lambda x: ~like(x, r"(?i)^-?site:\S") & ~like(x, minus)), " "),
    }


def allowed(host: Column, text: Column, ops: dict[str, Column]) -> Column:
    """Whether a result may be listed: on an asked host and no excluded one, its text with every phrase and no excluded word or its other number."""
    on = lambda s: (host == s) | F.endswith(host, F.concat(F.lit("."), s))
    plain = F.concat(F.lit(" "), T.normalize(F.concat_ws(" ", host, text)), F.lit(" "))
    has = lambda w: F.contains(plain, F.concat(F.lit(" "), w, F.lit(" ")))
    return ((F.size(ops["sites"]) == 0) | F.exists(ops["sites"], on)) & ~F.exists(ops["not_sites"], on) & F.forall(ops["phrases"], has) & ~F.exists(ops["excluded"], lambda w: has(w) | has(F.concat(w, F.lit("s"))) | F.coalesce(has(other_number(w)), F.lit(False)))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "candidate_lists").filter("query is not null").select("query").distinct()


def cleaned_queries(spark, d):
    return table(spark, d, "audit_cases").filter("query is not null").select("case_id", cleaned(F.concat(F.lit(" \t"), "query", F.lit("  "), F.repeat("query", 8))).alias("cleaned"))


def _with_operators(spark, d) -> DataFrame:
    """The queries with operators put to them by a rule."""
    q = _asked(spark, d)
    w = F.split("query", " ")
    return q.select("query", F.concat(F.lit('site:Example -site:.net.example "'), F.get(w, F.lit(0)), F.lit('" -'), F.element_at(w, -1), F.lit(" "), F.col("query"), F.lit(' -"two words"')).alias("typed"))


def parsed_operators(spark, d):
    ops = operators(F.col("typed"))
    join = lambda c: F.array_join(ops[c], "|")
    return _with_operators(spark, d).select("query", join("sites").alias("sites"), join("not_sites").alias("not_sites"), join("phrases").alias("phrases"), join("excluded").alias("excluded"), ops["words"].alias("words"))


def operator_filter(spark, d):
    """Homepages that a query with operators lets through: a word of their site's title demanded, one excluded."""
    items = merge.site_merge(spark, d).filter("title is not null").select(F.col("id").alias("domain"), "title", "about")
    first = F.get(T.words(F.col("title")), F.lit(0))
    typed = F.concat(F.lit("site:example -shop \""), first, F.lit('" -site:co.example'))
    rows = items.select("domain", typed.alias("typed"), F.concat_ws(" ", "title", "about").alias("text"))
    return rows.filter(allowed(F.col("domain"), F.col("text"), operators(F.col("typed")))).select("domain")


def parsed_queries(spark, d):
    """Distinct words, the whole as a name, leading names and a typed domain of each query."""
    w = F.array_distinct(T.words(F.col("query")))
    leads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda k: F.array_join(F.slice(w, F.lit(1), k), ""))
    typed = F.regexp_like(F.trim("query"), F.lit(r"^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+/?$"))
    return _asked(spark, d).select("query", F.size(w).alias("words"), F.array_join(w, "").alias("whole"), F.array_join(leads, "|").alias("leads"), typed.alias("typed_domain"))


def query_intents(spark, d):
    """The subject of a query that ends in words of intent, and whether it is a question; the queries also with such ends put to them."""
    ends = F.explode(F.array(F.lit(""), F.lit(" login"), F.lit(" help center docs"), F.lit(" opening hours"))).alias("end")
    q = _asked(spark, d).select("query", ends).select(F.concat("query", "end").alias("asked"))
    question = F.lower(F.get(F.split(F.trim("asked"), r"\s+"), F.lit(0))).isin(*QUESTIONS)
    return q.select("asked", subject(F.col("asked")).alias("subject"), question.alias("question")).distinct()


def query_topics(spark, d):
    """Cases by the topic their words name, the first of TOPICS that fits."""
    w = T.words(F.col("query"))
    of = F.coalesce(*[F.when(F.arrays_overlap(w, F.array(*[F.lit(x) for x in words.split("|")])), name) for name, words in TOPICS.items()], F.lit("none"))
    return table(spark, d, "audit_cases").filter("query is not null").groupBy(of.alias("topic")).agg(F.count("*").alias("cases"))


def package_queries(spark, d):
    """Package name and registry of an install command or of a query that names a registry."""
    q = _asked(spark, d).select("query", F.explode(F.array(F.concat(F.lit("pip install "), F.get(F.split(F.lower("query"), " "), F.lit(0))), F.concat(F.element_at(F.split(F.lower("query"), " "), -1), F.lit(" npm package")), F.col("query"))).alias("asked"))
    command = F.regexp_extract(F.lower("asked"), r"^\s*(pip|npm|cargo) (?:install|add|i) ([\w.@/-]+)\s*$", 2)
    w = T.words(F.col("asked"))
    named = F.coalesce(*[F.when(F.arrays_overlap(w, F.array(*[F.lit(x) for x in words.split("|")])), r) for r, words in REGISTRIES.items()])
    taken = [x for words in REGISTRIES.values() for x in words.split("|")] + ["install", "package", "library", "version"]
    rest = F.array_join(F.filter(w, lambda x: ~x.isin(*taken)), "-")
    return q.filter(named.isNotNull()).select("asked", named.alias("registry"), F.when(command != "", command).otherwise(rest).alias("package")).distinct()


def dated_queries(spark, d):
    """Bounds of queries with after:, before: and sort: put to them; a year alone is its first day."""
    q = _asked(spark, d).select("query", F.concat("query", F.lit(" after:2020 before:2021-06-30 sort:new")).alias("asked"))
    day = lambda k: F.regexp_extract("asked", rf"\b{k}:(\d{{4}}(?:-\d{{2}}-\d{{2}})?)", 1)
    full = lambda k: F.when(F.length(day(k)) == 4, F.concat(day(k), F.lit("-01-01"))).otherwise(day(k))
    return q.select("query", full("after").alias("after"), full("before").alias("before"), F.regexp_extract("asked", r"\bsort:(\w+)", 1).alias("sort"), F.trim(F.regexp_replace("asked", r"\s*\b(?:after|before|sort):\S+", "")).alias("words"))


def isbn_ok(digits: Column) -> Column:
    """Whether 13 digits have the check digit of a book number."""
    d = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x) % 10 == 0


def record_identifiers(spark, d):
    """Identifiers in queries made of part numbers: RFC, PEP, DOI and book numbers, those with a wrong check digit left out."""
    p = table(spark, d, "part").filter("p_partkey is not null")
    twelve = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    last = F.col("p_partkey") % 10
    q = p.select("p_partkey", F.explode(F.array(F.concat(F.lit("rfc "), "p_partkey"), F.concat(F.lit("PEP-"), F.lpad(F.col("p_partkey").cast("string"), 4, "0")), F.concat(F.lit("isbn "), twelve, last.cast("string")), F.concat(F.lit("doi:10.1000/"), "p_partkey"))).alias("asked"))
    of = lambda pattern: F.regexp_extract(F.lower("asked"), pattern, 1)
    rfc, pep, doi, isbn = of(r"^rfc[ -]?0*(\d{1,6})$"), of(r"^pep[ -]?0*(\d{1,6})$"), of(r"^(?:doi:\s*)?(10\.\d{4,}/\S+)$"), of(r"^isbn[ :]*(\d{13})$")
    kind = F.when(rfc != "", "rfc").when(pep != "", "pep").when(doi != "", "doi").when((isbn != "") & isbn_ok(isbn), "isbn")
    return q.filter(kind.isNotNull()).select("p_partkey", kind.alias("kind"), F.coalesce(F.nullif(rfc, F.lit("")), F.nullif(pep, F.lit("")), F.nullif(doi, F.lit("")), isbn).alias("number"))


def fact_questions(spark, d):
    """Relation and subject of the cases that ask for one: "R of X", "what is the R of X", "X R"."""
    q = T.normalize(F.col("query"))
    part = lambda p, n: F.nullif(F.regexp_extract(q, p, n), F.lit(""))
    lead = rf"(?:^| )({RELATIONS}) (?:of|for) (?:the )?(.+)$"
    tail = rf"^(?:the |official )?(.+?) ({RELATIONS})$"
    rows = table(spark, d, "audit_cases").filter("query is not null").select("case_id", F.coalesce(part(lead, 1), part(tail, 2)).alias("relation"), F.coalesce(part(lead, 2), part(tail, 1)).alias("subject"))
    return rows.filter("relation is not null")


def profile_questions(spark, d):
    """Service and name of queries that ask for a profile."""
    q = _asked(spark, d).select(F.explode(F.array(F.concat("query", F.lit(" youtube")), F.concat(F.lit("instagram "), "query"), F.col("query"))).alias("asked"))
    n = T.normalize(F.col("asked"))
    service = F.regexp_extract(n, rf"(?:^| )({SERVICES})(?: |$)", 1)
    return q.filter(service != "").select("asked", service.alias("service"), F.trim(F.regexp_replace(n, rf"(?:^| )(?:{SERVICES})(?= |$)", "")).alias("name")).distinct()


def place_queries(spark, d):
    """What and where of queries: "what in where", "nearest what where", "what near me", open now."""
    q = _asked(spark, d).select(F.explode(F.array("query", F.concat("query", F.lit(" near me")), F.concat("query", F.lit(" open now")), F.concat(F.lit("bakery in "), F.element_at(F.split("query", " "), -1)))).alias("asked"))
    n = T.normalize(F.col("asked"))
    near, opened = F.regexp_like(n, F.lit("(?:^| )(?:near me|nearby|nearest)(?: |$)")), F.regexp_like(n, F.lit("(?:^| )open now(?: |$)"))
    bare = F.trim(F.regexp_replace(n, "(?:^| )(?:near me|nearby|nearest|open now)(?= |$)", ""))
    where = F.regexp_extract(bare, "^.+? in (.+)$", 1)
    return q.select("asked", F.trim(F.regexp_replace(bare, " in .+$", "")).alias("what"), where.alias("where"), near.alias("near_me"), opened.alias("open_now")).distinct()


def bang_redirects(spark, d):
    """Addresses that queries with a bang lead to."""
    q = _asked(spark, d).select("query", F.explode(F.array(F.concat(F.lit("!g "), "query"), F.concat("query", F.lit(" !w")), F.concat(F.lit("!nope "), "query"))).alias("asked"))
    bang = F.regexp_extract("asked", r"(?:^|\s)!(\w+)(?:\s|$)", 1)
    rest = F.trim(F.regexp_replace("asked", r"(?:^|\s)!\w+(?=\s|$)", " "))
    to = F.coalesce(*[F.when(bang == b, F.lit(a)) for b, a in BANGS.items()])
    return q.filter(to.isNotNull()).select("asked", F.concat(to, F.replace(rest, F.lit(" "), F.lit("+"))).alias("address"))


def pick_queries(spark, d):
    """Queries that are counted: normal, short, without addresses of mail and long numbers."""
    n = T.normalize(F.col("query"))
    good = (F.length(n) > 0) & (F.length(n) <= PICK_CHARS) & (F.size(F.split(n, " ")) <= PICK_WORDS) & ~F.contains("query", F.lit("@")) & ~F.regexp_like(n, F.lit(rf"\d{{{PICK_DIGITS}}}"))
    return table(spark, d, "audit_cases").filter(good).groupBy(n.alias("query")).agg(F.count("*").alias("cases"))


def search_links(spark, d):
    """Addresses of a site's own search for the rest of a query that starts with its name."""
    items = merge.site_merge(spark, d).filter("title is not null").select(F.col("id").alias("domain"), T.joined(F.col("title")).alias("name")).filter("name <> ''")
    q = items.select("domain", "name", F.concat("name", F.lit(" red shoes & hats")).alias("asked"))
    rest = F.trim(F.substring(F.col("asked"), F.length("name") + 1, F.length("asked")))
    return q.select("domain", F.concat(F.lit("https://"), "domain", F.lit("/search?q="), F.url_encode(rest)).alias("link"))


def query_keys(spark, d):
    """Keys that a query is looked up by, longest first: its words and its whole joined."""
    w = T.words(F.col("query"))
    keys = F.array_distinct(F.filter(F.concat(w, F.array(F.array_join(w, ""))), lambda x: F.length(x) >= 2))
    order = F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda x: x["k"])
    return _asked(spark, d).select("query", F.array_join(order, "|").alias("keys"))


QUERIES = {f.__name__: f for f in (cleaned_queries, parsed_operators, operator_filter, parsed_queries, query_intents, query_topics, package_queries, dated_queries, record_identifiers, fact_questions, profile_questions, place_queries, bang_redirects, pick_queries, search_links, query_keys)}


def _n(x: str) -> str:
    return f"array_to_string({T.words_sql(x)}, ' ')"


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_A = "q AS (SELECT DISTINCT query FROM candidate_lists WHERE query IS NOT NULL)"
_INTENTS = "|".join(sorted(INTENTS, key=len, reverse=True))
_NAMED = "CASE " + " ".join(f"WHEN list_has_any(w, {words.split('|')}) THEN '{r}'" for r, words in REGISTRIES.items()) + " END"
_TAKEN = _in([x for words in REGISTRIES.values() for x in words.split("|")] + ["install", "package", "library", "version"])
_LEAD, _TAIL = rf"(?:^| )({RELATIONS}) (?:of|for) (?:the )?(.+)$", rf"^(?:the |official )?(.+?) ({RELATIONS})$"
SQL = {
    "cleaned_queries": r"WITH c AS (SELECT case_id, trim(regexp_replace(chr(32) || chr(9) || query || '  ' || repeat(query, 8), '[\s\x{00a0}]+', ' ', 'g')) AS c FROM audit_cases WHERE query IS NOT NULL) SELECT case_id, nullif(CASE WHEN length(c) > 200 THEN rtrim(c[:200]) ELSE c END, '') AS cleaned FROM c",
    "parsed_operators": f"WITH {_A} SELECT query, 'example' AS sites, 'net.example' AS not_sites, {_n('string_split(query, chr(32))[1]')} AS phrases, array_to_string(list_filter([CASE WHEN length(string_split(query, ' ')[-1]) > 1 THEN {_n('string_split(query, chr(32))[-1]')} ELSE '' END, 'two words'], lambda x: x <> ''), '|') AS excluded, CASE WHEN length(string_split(query, ' ')[-1]) > 1 THEN '' ELSE '-' || string_split(query, ' ')[-1] || ' ' END || trim(regexp_replace(query, '\\s+', ' ', 'g')) AS words FROM q",
    "operator_filter": f"WITH sm AS ({merge.SQL['site_merge']}) SELECT id AS domain FROM sm WHERE title IS NOT NULL AND (id = 'example' OR id LIKE '%.example') AND NOT (id = 'co.example' OR id LIKE '%.co.example') AND NOT regexp_matches(' ' || {_n('concat_ws(chr(32), id, title, about)')} || ' ', ' shops? ')",
    "parsed_queries": f"WITH {_A}, w AS (SELECT query, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM (SELECT query, {T.words_sql('query')} AS w FROM q)) SELECT query, len(w) AS words, array_to_string(w, '') AS whole, array_to_string(list_transform(range(1, greatest(len(w), 1) + 1), lambda k: array_to_string(w[:k], '')), '|') AS leads, regexp_full_match(trim(query), '[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+/?') AS typed_domain FROM w",
    "query_intents": f"WITH {_A}, e AS (SELECT unnest(['', ' login', ' help center docs', ' opening hours']) AS e), a AS (SELECT DISTINCT query || e AS asked FROM q, e) SELECT asked, CASE WHEN regexp_replace({_n('asked')}, '( ({_INTENTS}))+$', '') <> {_n('asked')} THEN regexp_replace({_n('asked')}, '( ({_INTENTS}))+$', '') END AS subject, lower(regexp_split_to_array(trim(asked), '\\s+')[1]) IN {_in(QUESTIONS)} AS question FROM a",
    "query_topics": f"WITH w AS (SELECT {T.words_sql('query')} AS w FROM audit_cases WHERE query IS NOT NULL) SELECT CASE " + " ".join(f"WHEN list_has_any(w, {words.split('|')}) THEN '{t}'" for t, words in TOPICS.items()) + " ELSE 'none' END AS topic, count(*) AS cases FROM w GROUP BY 1",
    "package_queries": f"WITH {_A}, a AS (SELECT DISTINCT unnest(['pip install ' || string_split(lower(query), ' ')[1], string_split(lower(query), ' ')[-1] || ' npm package', query]) AS asked FROM q), w AS (SELECT asked, {T.words_sql('asked')} AS w, regexp_extract(lower(asked), '^\\s*(pip|npm|cargo) (?:install|add|i) ([\\w.@/-]+)\\s*$', 2) AS c FROM a) SELECT asked, {_NAMED} AS registry, CASE WHEN c <> '' THEN c ELSE array_to_string(list_filter(w, lambda x: x NOT IN {_TAKEN}), '-') END AS package FROM w WHERE {_NAMED} IS NOT NULL",
    "dated_queries": f"WITH {_A} SELECT query, '2020-01-01' AS after, '2021-06-30' AS before, 'new' AS sort, trim(query) AS words FROM q",
    "record_identifiers": "WITH t AS (SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 9, '0') || (p_partkey % 10)::VARCHAR AS i FROM part), o AS (SELECT *, list_sum(list_transform(range(1, 14), lambda k: i[k]::INT * CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 AS ok FROM t) SELECT p_partkey, 'rfc' AS kind, p_partkey::VARCHAR AS number FROM part UNION ALL SELECT p_partkey, 'pep', p_partkey::VARCHAR FROM part UNION ALL SELECT p_partkey, 'doi', '10.1000/' || p_partkey FROM part UNION ALL SELECT p_partkey, 'isbn', i FROM o WHERE ok",
    "fact_questions": f"WITH n AS (SELECT case_id, {_n('query')} AS n FROM audit_cases WHERE query IS NOT NULL), r AS (SELECT case_id, coalesce(nullif(regexp_extract(n, '{_LEAD}', 1), ''), nullif(regexp_extract(n, '{_TAIL}', 2), '')) AS relation, coalesce(nullif(regexp_extract(n, '{_LEAD}', 2), ''), nullif(regexp_extract(n, '{_TAIL}', 1), '')) AS subject FROM n) SELECT * FROM r WHERE relation IS NOT NULL",
    "profile_questions": f"WITH {_A}, a AS (SELECT DISTINCT unnest([query || ' youtube', 'instagram ' || query, query]) AS asked FROM q), n AS (SELECT asked, {T.words_sql('asked')} AS w FROM a) SELECT asked, list_filter(w, lambda x: x IN {_in(SERVICES.split('|'))})[1] AS service, array_to_string(list_filter(w, lambda x: x NOT IN {_in(SERVICES.split('|'))}), ' ') AS name FROM n WHERE list_has_any(w, {SERVICES.split('|')})",
    "place_queries": f"WITH {_A}, a AS (SELECT DISTINCT unnest([query, query || ' near me', query || ' open now', 'bakery in ' || string_split(query, ' ')[-1]]) AS asked FROM q), n AS (SELECT asked, ' ' || {_n('asked')} || ' ' AS n FROM a), b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(n, ' near me ', ' ', 'g'), ' open now ', ' ', 'g'), ' (nearby|nearest) ', ' ', 'g')) AS b FROM n) SELECT asked, trim(regexp_replace(b, ' in .+$', '')) AS what, regexp_extract(b, '^.+? in (.+)$', 1) AS \"where\", regexp_matches(n, ' (near me|nearby|nearest) ') AS near_me, contains(n, ' open now ') AS open_now FROM b",
    "bang_redirects": f"WITH {_A} SELECT '!g ' || query AS asked, '{BANGS['g']}' || replace(trim(query), ' ', '+') AS address FROM q UNION ALL SELECT query || ' !w', '{BANGS['w']}' || replace(trim(query), ' ', '+') FROM q",
    "pick_queries": f"WITH n AS (SELECT query AS raw, {_n('query')} AS query FROM audit_cases WHERE query IS NOT NULL) SELECT query, count(*) AS cases FROM n WHERE length(query) BETWEEN 1 AND {PICK_CHARS} AND len(string_split(query, ' ')) <= {PICK_WORDS} AND NOT contains(raw, '@') AND NOT regexp_matches(query, '[0-9]{{{PICK_DIGITS}}}') GROUP BY 1",
    "search_links": f"WITH sm AS ({merge.SQL['site_merge']}) SELECT id AS domain, 'https://' || id || '/search?q=red+shoes+%26+hats' AS link FROM sm WHERE array_to_string({T.words_sql('title')}, '') <> ''",
    "query_keys": f"WITH {_A}, w AS (SELECT query, {T.words_sql('query')} AS w FROM q), k AS (SELECT query, list_distinct(list_filter(list_append(w, array_to_string(w, '')), lambda x: length(x) >= 2)) AS k FROM w) SELECT query, array_to_string(list_transform(list_sort(list_transform(k, lambda x: {{'n': -length(x), 'k': x}})), lambda x: x.k), '|') AS keys FROM k",
}
