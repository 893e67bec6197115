"""Text and address identity: normal forms, keys, copies, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.sources.tables import table

# Link texts that name no site, and the longest link text.
GENERIC = """about|about us|back|back to top|click|click here|click to visit|com|contact|contact us|continue|continue reading|details|download|external link|find out more|full story|go|go to site|go to website|here|home|home page|homepage|http|https|info|learn more|link|links|main page|more|more info|more information|next|official site|official web site|official website|open|previous|read|read more|see more|site|source|this|this link|top|url|view|view more|view site|view website|visit|visit our website|visit site|visit the website|visit website|web|web site|website|www""".split("|")
LONGEST = 100


def normalize_text(spark, d):
    meta = T.composed(table(spark, d, "homepage_meta"), "title")
    return meta.select("meta_id", T.normalize(F.col("title")).alias("normal"), T.joined(F.col("title")).alias("key"))


def word_bigrams(spark, d):
    w = table(spark, d, "homepage_meta").select(T.words(F.col("description")).alias("w")).filter(F.size("w") > 1)
    pairs = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count("*").alias("n"))


def title_parts(spark, d):
    cut = F.split("title", r"\s+[-|–]\s+|:\s+")
    return table(spark, d, "homepage_meta").filter("title is not null").select("meta_id", F.posexplode(cut).alias("part_no", "part"))


def exact_copies(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def useful_anchor(spark, d):
    """Uses of the link texts that say something about their target: no generic one, none that only spells the target's address."""
    a = table(spark, d, "anchors").select("target_domain", T.normalize(F.col("anchor_text")).alias("normal"))
    spelled = [T.normalize(F.concat(F.lit(p), F.col("target_domain"), F.lit(e))) for p, e in (("", ""), ("https://", "/"), ("http://", "/"), ("www.", ""), ("https://www.", "/"))]
    good = a.filter((F.length("normal") > 0) & (F.length("normal") <= LONGEST) & ~F.col("normal").isin(*GENERIC) & ~F.coalesce(F.array_contains(F.array(*spelled), F.col("normal")), F.lit(False)))
    return good.groupBy("target_domain", "normal").agg(F.count("*").alias("uses"))


def host_and_domain(spark, d):
    h = U.host(F.col("url"))
    return table(spark, d, "homepage_meta").select("meta_id", h.alias("host"), U.registrable_domain(h).alias("registrable"), U.path(F.col("url")).alias("path"))


def url_dedupe(spark, d):
    meta = table(spark, d, "homepage_meta").select("meta_id", U.match_key(F.col("url")).alias("match_key"), "fetched_at").filter("match_key is not null")
    return meta.groupBy("match_key").agg(F.max(F.struct("fetched_at", "meta_id"))["meta_id"].alias("kept"), F.count("*").alias("spellings"))


def canonical_urls(spark, d):
    """The canonical form of each page's address, and the hash of its match key."""
    u = F.col("url")
    return table(spark, d, "read_pages").select("page_id", U.canonical_url(u).alias("canonical"), F.sha2(U.match_key(u), 256).alias("url_sha256"))


def spelled_urls(spark, d):
    """Keys of addresses spelled in other ways: capitals, usual and unusual ports, dot segments, percent forms, tracking."""
    u = F.concat(F.lit("HTTP://WWW."), F.upper("domain"), F.lit(":"), F.when(F.col("page_id") % 2 == 0, 80).otherwise(8080).cast("string"), F.lit("/a/./b/../%7e"), F.col("page_id").cast("string"), F.lit("/?utm_source=x&b=2&a=%2f#top"))
    return table(spark, d, "read_pages").filter("domain is not null").select("page_id", U.canonical_url(u).alias("canonical"), U.match_key(u).alias("match_key"))


def homepage_path(spark, d):
    p = F.regexp_replace(U.path(F.col("url")), r"/(?:index|default)\.[a-z]+$", "")
    ok = (p == "") | (p == "/") | F.regexp_like(p, F.lit(r"^(?:/[a-z]{2}(?:[-_][a-z]{2,4})?){1,2}$"))
    return table(spark, d, "read_pages").select("page_id", ok.alias("is_homepage"))


def language_tags(spark, d):
    tag = F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2})(?:[-_].*)?$", 1))
    items = table(spark, d, "site_items").select(F.when(tag != "", tag).otherwise("none").alias("tag"))
    return items.groupBy("tag").agg(F.count("*").alias("items"))


QUERIES = {f.__name__: f for f in (normalize_text, word_bigrams, title_parts, exact_copies, useful_anchor, host_and_domain, url_dedupe, canonical_urls, spelled_urls, homepage_path, language_tags)}
_GENERIC = ", ".join(f"'{g}'" for g in GENERIC)
_SPELLED = ", ".join(f"array_to_string({T.words_sql(x)}, ' ')" for x in ("target_domain", "('https://' || target_domain || '/')", "('http://' || target_domain || '/')", "('www.' || target_domain)", "('https://www.' || target_domain || '/')"))
_WRITTEN = "('HTTP://WWW.' || upper(domain) || ':' || CASE WHEN page_id % 2 = 0 THEN 80 ELSE 8080 END || '/a/./b/../%7e' || page_id || '/?utm_source=x&b=2&a=%2f#top')"
SQL = {
    "normalize_text": f"SELECT meta_id, array_to_string({T.words_sql('nfc_normalize(title)')}, ' ') AS normal, array_to_string({T.words_sql('nfc_normalize(title)')}, '') AS key FROM homepage_meta",
    "word_bigrams": f"WITH w AS (SELECT {T.words_sql('description')} AS w FROM homepage_meta), e AS (SELECT w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1) SELECT w[i] || ' ' || w[i + 1] AS bigram, count(*) AS n FROM e GROUP BY 1",
    "title_parts": r"WITH p AS (SELECT meta_id, regexp_split_to_array(title, '\s+[-|–]\s+|:\s+') AS p FROM homepage_meta WHERE title IS NOT NULL) SELECT meta_id, unnest(range(0, len(p))) AS part_no, unnest(p) AS part FROM p",
    "exact_copies": f"SELECT md5(array_to_string({T.words_sql('text')}, ' ')) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "useful_anchor": f"WITH a AS (SELECT target_domain, array_to_string({T.words_sql('anchor_text')}, ' ') AS normal FROM anchors) SELECT target_domain, normal, count(*) AS uses FROM a WHERE length(normal) > 0 AND length(normal) <= {LONGEST} AND normal NOT IN ({_GENERIC}) AND NOT coalesce(list_contains([{_SPELLED}], normal), false) GROUP BY 1, 2",
    "host_and_domain": f"WITH h AS (SELECT meta_id, url, {U.host_sql('url')} AS host FROM homepage_meta) SELECT meta_id, host, {U.domain_sql('host')} AS registrable, {U.path_sql('url')} AS path FROM h",
    "url_dedupe": f"WITH m AS (SELECT meta_id, fetched_at, {U.match_key_sql('url')} AS match_key FROM homepage_meta), r AS (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY fetched_at DESC NULLS LAST, meta_id DESC) AS rn, count(*) OVER (PARTITION BY match_key) AS n FROM m WHERE match_key IS NOT NULL) SELECT match_key, meta_id AS kept, n AS spellings FROM r WHERE rn = 1",
    "homepage_path": rf"WITH p AS (SELECT page_id, regexp_replace({U.path_sql('url')}, '/(?:index|default)\.[a-z]+$', '') AS p FROM read_pages) SELECT page_id, (p = '' OR p = '/' OR regexp_matches(p, '^(?:/[a-z]{{2}}(?:[-_][a-z]{{2,4}})?){{1,2}}$')) AS is_homepage FROM p",
    "canonical_urls": f"SELECT page_id, {U.canonical_sql('url')} AS canonical, sha256({U.match_key_sql('url')}) AS url_sha256 FROM read_pages",
    "spelled_urls": f"SELECT page_id, {U.canonical_sql(_WRITTEN)} AS canonical, {U.match_key_sql(_WRITTEN)} AS match_key FROM read_pages WHERE domain IS NOT NULL",
    "language_tags": r"WITH t AS (SELECT lower(regexp_extract(lang, '^\s*([A-Za-z]{2})(?:[-_].*)?$', 1)) AS t FROM site_items) SELECT CASE WHEN t <> '' THEN t ELSE 'none' END AS tag, count(*) AS items FROM t GROUP BY 1",
}
