"""Records of sites: cleaning, folding of crawls, redirects and claims, budgets, countries, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import hashes as H
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import merge
from webloom.operators.ranking import count_before
from webloom.plans.lineage import keep
from webloom.sources.tables import table

# Most names and kinds of a site, most items that may claim a host, how often the best known claimant must be named more than the next.
NAMES, KINDS, CLAIMS, DOMINANCE = 16, 6, 5, 3
#: Longest title and description kept, hops of redirects, bytes of a budget, links and hosts that make a subsite.
TITLE, ABOUT, HOPS, BUDGET, SUBSITE_LINKS = 120, 300, 10, 60_000, 5
# Country endings used for anything.
GENERIC_ENDINGS = "io me co ai tv fm".split()
#: Words of levels; a host's or a text's highest counts.
LEVELS = {"explicit": "xxx porn", "suggestive": "lingerie dating casino"}


def union_capped(rows: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """key, values: one spelling (the newest) of each normal form, newest first, at most `most`."""
    form = T.joined(F.col(value))
    one = rows.filter(F.col(key).isNotNull()).withColumn("_f", form).filter("_f <> ''").groupBy(key, "_f").agg(F.max(F.struct(order, value)).alias("x"))
    w = Window.partitionBy(key).orderBy(F.desc(F.col(f"x.{order}")), "_f")
    top = one.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(f"x.{value}").alias("v")))), lambda x: x["v"]).alias("values"))


def site_records(spark, d):
    """Sites merged over all crawls: gaps of title, address, about and language filled from older ones, page fields (site, published)
    of the newest crawl even if null, kinds and names united, the heaviest weight, and the folded ranks."""
    items = table(spark, d, "site_items").filter("id is not null")
    fill = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("rev", c)))[c].alias(c)
    last = F.max(F.struct("rev", "site", "published"))
    one = items.groupBy("id").agg(F.max("rev").alias("crawled"), *[fill(c) for c in ("title", "url", "about", "lang")], last.alias("p"), F.max("weight").alias("weight"))
    kinds = union_capped(items.select("id", "rev", F.explode("labels").alias("v")), "id", "v", "rev", KINDS).select("id", F.array_join("values", "|").alias("kinds"))
    names = union_capped(items.select("id", "rev", F.explode("names").alias("v")), "id", "v", "rev", NAMES).select("id", F.array_join("values", "|").alias("names"))
    ranks = merge.signals(spark, d).select(F.col("domain").alias("id"), "harmonic_rank", "tranco_rank", "official_site")
    return one.select("id", "crawled", "title", "url", "about", "lang", "p.site", "p.published", "weight").join(kinds, "id", "left").join(names, "id", "left").join(ranks, "id", "left")


def shared_records(spark, d):
    """As a crawl another node shares is merged: what it leaves empty keeps what is there."""
    items = table(spark, d, "site_items").filter("id is not null")
    fill = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("rev", c)))[c].alias(c)
    return items.groupBy("id").agg(*[fill(c) for c in ("title", "site", "published", "lang")])


def gone_marked(spark, d):
    """Sites found gone lose all but their ranks: here those whose id has a length divisible by ten and whose newest crawl isn't the newest of all."""
    one = merge.site_merge(spark, d)
    whole = one.agg(F.max("rev").alias("now"))
    gone = (F.length("id") % 10 == 0) & (F.col("rev") < F.col("now"))
    kept = lambda c: F.when(~gone, F.col(c)).alias(c)
    return one.crossJoin(F.broadcast(whole)).select("id", kept("title"), kept("about"), kept("url"), gone.alias("gone"))  # one row


def cleaned_records(spark, d):
    """Titles and descriptions in NFC without control characters, cut; addresses that are none dropped."""
    rows = T.composed(table(spark, d, "site_items").filter("id is not null"), "title", "about")
    clean = lambda c, most: F.nullif(F.trim(F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{Cc}", " "), r"\s+", " ")), 1, most)), F.lit("")).alias(c)
    return rows.select("id", "rev", clean("title", TITLE), clean("about", ABOUT), U.canonical_url(F.col("url")).alias("url"))


def wat_filled(spark, d):
    """Records whose empty title and about are filled from their homepage as archives hold it; what they have stays."""
    meta = table(spark, d, "homepage_meta").filter("domain is not null").groupBy(F.col("domain").alias("id")).agg(F.max(F.struct("fetched_at", "meta_id", "title", "description")).alias("m"))
    full = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), F.nullif(F.trim(b), F.lit("")))
    return merge.site_merge(spark, d).join(meta, "id", "left").select("id", full("title", "m.title").alias("title"), full("about", "m.description").alias("about"))


def official_claims(spark, d):
    """The item that owns each host among those that claim it: hosts of more than CLAIMS claimants have none, nor those whose best
    known claimant isn't DOMINANCE times as well known as the next. Items are here the normal names of the records."""
    items = table(spark, d, "site_items").filter("id is not null").select("id", F.explode("names").alias("name"), F.coalesce("weight", F.lit(0.0)).alias("known"))
    claims = items.select("id", T.joined(F.col("name")).alias("item"), "known").filter("item <> ''").groupBy("id", "item").agg(F.max("known").alias("known"))
    w = Window.partitionBy("id")
    o = w.orderBy(F.desc("known"), "item")
    rows = claims.select("*", F.count("*").over(w).alias("n"), F.row_number().over(o).alias("place"), F.lead("known").over(o).alias("next"))
    good = (F.col("n") <= CLAIMS) & (F.col("next").isNull() | (F.col("known") >= DOMINANCE * F.col("next")))
    return rows.filter((F.col("place") == 1) & good).select("id", "item", "n")


def linked_sites(spark, d):
    """Targets of crawled links: distinct linking sites, their sketch, and whether the target has a record of its own."""
    a = table(spark, d, "anchors").filter("linking_domain is not null and target_domain is not null")
    records = table(spark, d, "site_items").filter("id is not null").select(F.col("id").alias("target_domain"), F.lit(True).alias("r")).distinct()
    out = a.groupBy("target_domain").agg(F.count_distinct("linking_domain").alias("linkers"), F.bit_or("linkers").alias("sketch"))
    return out.join(records, "target_domain", "left").select("target_domain", "linkers", "sketch", F.coalesce("r", F.lit(False)).alias("recorded"))


def redirects(spark, d) -> DataFrame:
    """site, target: sites whose name is another site's with a word before or behind, and that have a record."""
    ids = table(spark, d, "site_items").filter("id is not null").select("id").distinct()
    bare = F.regexp_replace(F.regexp_replace("id", r"^(?:get|my|the)-", ""), r"-(?:shop|online|docs|lab|group)(?=\.)", "")
    return ids.select(F.col("id").alias("site"), bare.alias("target")).filter("site <> target")


def folded(records: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """key, target: where each record's redirects end, itself if it has none; loops stay put after HOPS."""
    ends = records.select(F.col(key), F.col(key).alias("target"))
    step = moves.groupBy("site").agg(F.min("target").alias("to"))
    for _ in range(HOPS):
        more = keep(ends.join(step, ends.target == step.site, "left").select(key, F.coalesce("to", "target").alias("target"), F.col("to").isNotNull().alias("moved")))
        ends = more.drop("moved")
        if more.filter("moved").isEmpty():
            return ends
    loops = ends.join(step.select(F.col("site").alias("target")), "target", "left_semi").select(key).distinct()
    return ends.join(loops.withColumn("l", F.lit(True)), key, "left").select(key, F.when(F.col("l"), F.col(key)).otherwise(F.col("target")).alias("target"))


def redirect_fold(spark, d):
    """Records folded into the sites they lead to, with the names handed over."""
    names = table(spark, d, "site_items").filter("id is not null").select("id", F.explode_outer("names").alias("name"))
    ends = folded(names.select("id").distinct(), redirects(spark, d), "id")
    both = names.join(ends, "id")
    return both.groupBy("target").agg(F.count_distinct("id").alias("sites"), F.count_distinct(T.joined(F.col("name"))).alias("names"))


def subsites(spark, d):
    """Hosts below a site that links point to often enough to be sites of their own."""
    a = table(spark, d, "anchors").filter("linking_domain is not null and target_domain is not null")
    host = F.concat(F.when(F.length("anchor_text") % 3 == 0, F.lit("docs.")).otherwise(""), F.col("target_domain"))
    links = a.select(host.alias("host"), "linking_domain").groupBy("host").agg(F.count_distinct("linking_domain").alias("linkers"))
    site = U.registrable_domain(F.col("host"))
    return links.filter((F.col("host") != site) & (F.col("linkers") >= SUBSITE_LINKS)).select("host", site.alias("site"), "linkers")


def parent_ranks(spark, d):
    """Subsites with the ranks of the sites above them, where they have none."""
    ranks = merge.signals(spark, d).select(F.col("domain").alias("site"), "harmonic_rank", "tranco_rank")
    return subsites(spark, d).join(ranks, "site", "left").select("host", "harmonic_rank", "tranco_rank")


def trimmed(spark, d):
    """The best sites whose texts fit into BUDGET bytes; exact, for any number of sites."""
    sites = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("score"))
    size = F.octet_length(F.concat_ws("", "title", "about", "url")).cast("long")
    rows = merge.site_merge(spark, d).select(F.col("id").alias("domain"), size.alias("bytes")).join(sites, "domain").select("domain", "bytes", F.lit(0).alias("all"), (-F.col("score")).alias("by"))
    placed = count_before(rows, ["all"], ["by", "domain"], "bytes", "before")
    return placed.filter(F.col("before") + F.col("bytes") <= BUDGET).select("domain", "before")


def site_countries(spark, d):
    """Sites by the country of their ending, those used for anything left out."""
    tld = F.regexp_extract("id", r"\.([a-z]{2})$", 1)
    s = table(spark, d, "site_items").filter("id is not null").select("id").distinct()
    return s.groupBy(F.when((tld != "") & ~tld.isin(*GENERIC_ENDINGS), tld).otherwise("none").alias("country")).agg(F.count("*").alias("sites"))


def level(words: Column) -> Column:
    """explicit, suggestive or none: the highest level whose words are among these."""
    return F.coalesce(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(x) for x in w.split()])), name) for name, w in LEVELS.items()], F.lit("none"))


def site_levels(spark, d):
    """Sites by level, of their labels, texts and the words of their host."""
    w = T.words(F.concat_ws(" ", "title", "about", F.array_join(F.coalesce("labels", F.array()), " "), F.translate("id", "-.", "  ")))
    rows = table(spark, d, "site_items").filter("id is not null").select("id", level(w).alias("level"))
    worst = F.max(F.when(F.col("level") == "explicit", 2).when(F.col("level") == "suggestive", 1).otherwise(0)).alias("level")
    return rows.groupBy("id").agg(worst).groupBy("level").agg(F.count("*").alias("sites"))


def retained(spark, d):
    """Sites kept and left by a predicate, here an official flag or a rank."""
    s = merge.signals(spark, d).withColumn("kept", F.coalesce("official_site", F.lit(False)) | F.col("tranco_rank").isNotNull())
    return s.groupBy("kept").agg(F.count("*").alias("sites"))


def record_sizes(spark, d):
    """Exact lower medians, 90th and 99th parts of the records' sizes in bytes."""
    size = F.octet_length(F.concat_ws("", "title", "about", "url"))
    rows = table(spark, d, "site_items").select(size.alias("b"))
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by b)")
    return rows.agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("b").alias("largest"))


def dead_sites(spark, d):
    """Records without a homepage fetched since their newest crawl, by whether links still point to them."""
    fetched = table(spark, d, "homepage_meta").filter("domain is not null and url is not null").select(F.col("domain").alias("id")).distinct()
    linked = table(spark, d, "anchors").select(F.col("target_domain").alias("id"), F.lit(True).alias("l")).distinct()
    dead = merge.site_merge(spark, d).select("id").join(fetched, "id", "left_anti").join(linked, "id", "left")
    return dead.groupBy(F.coalesce("l", F.lit(False)).alias("linked")).agg(F.count("*").alias("sites"))


def grading_order(spark, d):
    """The hundred sites to grade next: most often in lists, then best linked, then by name."""
    uses = table(spark, d, "candidate_lists").filter("site_id is not null").groupBy("site_id").agg(F.count_distinct("query_id").alias("lists"))
    names = table(spark, d, "site_signals").filter("site_id is not null").groupBy("site_id").agg(F.max("domain").alias("domain"))
    scores = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("score"))
    return names.join(uses, "site_id", "left").join(scores, "domain").select("domain", F.coalesce("lists", F.lit(0)).alias("lists"), "score").orderBy(F.desc("lists"), F.desc("score"), "domain").limit(100)


def embedding_texts(spark, d):
    """What is embedded of each site: title, about and names in order, each once whatever its case, and the hash that tells stale vectors."""
    items = T.composed(merge.site_merge(spark, d), "title", "about")
    parts = F.filter(F.array("title", "about", F.regexp_replace(F.substring_index("id", ".", 1), "-", " ")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    once = F.filter(parts, lambda x, i: F.array_position(F.transform(parts, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    text = F.array_join(once, ". ")
    words = F.split(text, r"\s+")
    cut = F.array_join(F.slice(words, 1, 40), " ")
    return items.select("id", F.sha2(cut, 256).alias("hash"), F.least(F.size(words), F.lit(40)).alias("words"))


def sites_to_embed(spark, d):
    """Sites whose text has no current vector: here those without a vector of kind site since their newest crawl."""
    have = table(spark, d, "site_vectors").filter("embedded_of = 'site' and vec is not null").select(F.col("domain").alias("id")).distinct()
    return embedding_texts(spark, d).join(have, "id", "left_anti").select("id", "hash")


QUERIES = {f.__name__: f for f in (site_records, shared_records, gone_marked, cleaned_records, wat_filled, official_claims, linked_sites, redirect_fold, subsites, parent_ranks, trimmed, site_countries, site_levels, retained, record_sizes, dead_sites, grading_order, embedding_texts, sites_to_embed)}


def _union_sql(column: str, most: int, alias: str) -> str:
    return f"""{alias}1 AS (SELECT id, rev, unnest({column}) AS v FROM site_items WHERE id IS NOT NULL), {alias}2 AS (SELECT id, array_to_string({T.words_sql('v')}, '') AS f, max({{'rev': rev, 'v': v}}) AS x FROM {alias}1 GROUP BY 1, 2), {alias}3 AS (SELECT id, x.v AS v, row_number() OVER (PARTITION BY id ORDER BY x.rev DESC, f) AS n FROM {alias}2 WHERE f <> ''), {alias} AS (SELECT id, string_agg(v, '|' ORDER BY n) AS {column} FROM {alias}3 WHERE n <= {most} GROUP BY 1)"""


_SM = f"sm AS ({merge.SQL['site_merge']})"
_SUB = f"h AS (SELECT CASE WHEN length(anchor_text) % 3 = 0 THEN 'docs.' ELSE '' END || target_domain AS host, linking_domain FROM anchors WHERE linking_domain IS NOT NULL AND target_domain IS NOT NULL), l AS (SELECT host, count(DISTINCT linking_domain) AS linkers FROM h GROUP BY 1), sub AS (SELECT host, {U.domain_sql('host')} AS site, linkers FROM l WHERE host <> {U.domain_sql('host')} AND linkers >= {SUBSITE_LINKS})"
_fill = lambda c: f"max(CASE WHEN {c} IS NOT NULL THEN {{'rev': rev, 'v': {c}}} END).v AS {c}"
_clean = lambda c, n: f"nullif(trim(trim(regexp_replace(regexp_replace(nfc_normalize({c}), '\\p{{Cc}}', ' ', 'g'), '\\s+', ' ', 'g'))[:{n}]), '') AS {c}"
_EMBED = f"t AS (SELECT id, list_filter([nfc_normalize(title), nfc_normalize(about), replace(string_split(id, '.')[1], '-', ' ')], lambda x: x IS NOT NULL AND trim(x) <> '') AS p FROM sm), o AS (SELECT id, regexp_split_to_array(array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i), '. '), '\\s+') AS w FROM t), emb AS (SELECT id, sha256(array_to_string(w[:40], ' ')) AS hash, least(len(w), 40) AS words FROM o)"
SQL = {
    "site_records": f"WITH o AS (SELECT id, max(rev) AS crawled, {', '.join(_fill(c) for c in ('title', 'url', 'about', 'lang'))}, first({{'site': site, 'published': published}} ORDER BY rev DESC NULLS LAST, site DESC NULLS LAST, published DESC NULLS LAST) AS p, max(weight) AS weight FROM site_items WHERE id IS NOT NULL GROUP BY 1), {_union_sql('labels', KINDS, 'kd')}, {_union_sql('names', NAMES, 'nm')}, {merge._SIGNALS} SELECT o.id, crawled, title, url, about, lang, o.p.site AS site, o.p.published AS published, o.weight, kd.labels AS kinds, nm.names AS names, h AS harmonic_rank, t AS tranco_rank, s.o AS official_site FROM o LEFT JOIN kd ON kd.id = o.id LEFT JOIN nm ON nm.id = o.id LEFT JOIN s ON s.domain = o.id",
    "shared_records": f"SELECT id, {', '.join(_fill(c) for c in ('title', 'site', 'published', 'lang'))} FROM site_items WHERE id IS NOT NULL GROUP BY 1",
    "gone_marked": f"WITH {_SM}, g AS (SELECT *, length(id) % 10 = 0 AND rev < (SELECT max(rev) FROM sm) AS gone FROM sm) SELECT id, CASE WHEN NOT gone THEN title END AS title, CASE WHEN NOT gone THEN about END AS about, CASE WHEN NOT gone THEN url END AS url, gone FROM g",
    "cleaned_records": f"SELECT id, rev, {_clean('title', TITLE)}, {_clean('about', ABOUT)}, {U.canonical_sql('url')} AS url FROM site_items WHERE id IS NOT NULL",
    "wat_filled": f"WITH {_SM}, m AS (SELECT domain AS id, max({{'a': fetched_at, 'b': meta_id, 'title': title, 'description': description}}) AS m FROM homepage_meta WHERE domain IS NOT NULL GROUP BY 1) SELECT sm.id, coalesce(nullif(trim(title), ''), nullif(trim(m.m.title), '')) AS title, coalesce(nullif(trim(about), ''), nullif(trim(m.m.description), '')) AS about FROM sm LEFT JOIN m ON m.id = sm.id",
    "official_claims": f"WITH i AS (SELECT id, unnest(names) AS name, coalesce(weight, 0) AS known FROM site_items WHERE id IS NOT NULL), c AS (SELECT id, array_to_string({T.words_sql('name')}, '') AS item, max(known) AS known FROM i GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER v AS place, lead(known) OVER v AS next FROM c WHERE item <> '' WINDOW v AS (PARTITION BY id ORDER BY known DESC, item)) SELECT id, item, n FROM r WHERE place = 1 AND n <= {CLAIMS} AND (next IS NULL OR known >= {DOMINANCE} * next)",
    "linked_sites": "WITH a AS (SELECT target_domain, count(DISTINCT linking_domain) AS linkers, bit_or(linkers) AS sketch FROM anchors WHERE linking_domain IS NOT NULL AND target_domain IS NOT NULL GROUP BY 1) SELECT *, target_domain IN (SELECT id FROM site_items WHERE id IS NOT NULL) AS recorded FROM a",
    "redirect_fold": rf"WITH RECURSIVE n AS (SELECT id, unnest(CASE WHEN len(names) > 0 THEN names ELSE [NULL] END) AS name FROM site_items WHERE id IS NOT NULL), b AS (SELECT DISTINCT id AS site, regexp_replace(regexp_replace(id, '^(get|my|the)-', ''), '-(shop|online|docs|lab|group)\.', '.') AS target FROM n), m AS (SELECT * FROM b WHERE site <> target), e AS (SELECT site AS id, site AS target, 0 AS i FROM b UNION ALL SELECT e.id, m.target, i + 1 FROM e JOIN m ON e.target = m.site WHERE i < {HOPS}), l AS (SELECT id, max_by(target, i) AS target FROM e GROUP BY 1) SELECT target, count(DISTINCT id) AS sites, count(DISTINCT array_to_string({T.words_sql('name')}, '')) AS names FROM n JOIN l USING (id) GROUP BY 1",
    "subsites": f"WITH {_SUB} SELECT * FROM sub",
    "parent_ranks": f"WITH {_SUB}, {merge._SIGNALS} SELECT host, s.h AS harmonic_rank, s.t AS tranco_rank FROM sub LEFT JOIN s ON s.domain = sub.site",
    "trimmed": f"WITH {_SM}, {merge._SIGNALS}, {merge._SCORE}, b AS (SELECT sm.id AS domain, octet_length(encode(concat_ws('', title, about, url)))::BIGINT AS bytes, round(score, 5) AS score FROM sm JOIN sc ON sc.domain = sm.id), c AS (SELECT domain, bytes, coalesce(sum(bytes) OVER (ORDER BY score DESC, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b) SELECT domain, before FROM c WHERE before + bytes <= {BUDGET}",
    "site_countries": rf"WITH s AS (SELECT DISTINCT id, regexp_extract(id, '\.([a-z]{{2}})$', 1) AS t FROM site_items WHERE id IS NOT NULL) SELECT CASE WHEN t <> '' AND t NOT IN ({', '.join(repr(g) for g in GENERIC_ENDINGS)}) THEN t ELSE 'none' END AS country, count(*) AS sites FROM s GROUP BY 1",
    "site_levels": f"WITH w AS (SELECT id, {T.words_sql('t')} AS w FROM (SELECT id, concat_ws(' ', title, about, coalesce(array_to_string(labels, ' '), ''), replace(replace(id, '-', ' '), '.', ' ')) AS t FROM site_items WHERE id IS NOT NULL)), l AS (SELECT id, max(CASE WHEN list_has_any(w, {LEVELS['explicit'].split()}) THEN 2 WHEN list_has_any(w, {LEVELS['suggestive'].split()}) THEN 1 ELSE 0 END) AS level FROM w GROUP BY 1) SELECT level, count(*) AS sites FROM l GROUP BY 1",
    "retained": f"WITH {merge._SIGNALS} SELECT coalesce(o, false) OR t IS NOT NULL AS kept, count(*) AS sites FROM s GROUP BY 1",
    "record_sizes": "WITH b AS (SELECT octet_length(encode(concat_ws('', title, about, url))) AS b FROM site_items) SELECT quantile_disc(b, 0.5) AS p50, quantile_disc(b, 0.9) AS p90, quantile_disc(b, 0.99) AS p99, max(b) AS largest FROM b",
    "dead_sites": f"WITH {_SM} SELECT id IN (SELECT target_domain FROM anchors WHERE target_domain IS NOT NULL) AS linked, count(*) AS sites FROM sm WHERE id NOT IN (SELECT domain FROM homepage_meta WHERE domain IS NOT NULL AND url IS NOT NULL) GROUP BY 1",
    "grading_order": f"WITH {merge._SIGNALS}, {merge._SCORE}, u AS (SELECT site_id, count(DISTINCT query_id) AS lists FROM candidate_lists WHERE site_id IS NOT NULL GROUP BY 1), n AS (SELECT site_id, max(domain) AS domain FROM site_signals WHERE site_id IS NOT NULL GROUP BY 1) SELECT domain, coalesce(lists, 0) AS lists, round(score, 5) AS score FROM n LEFT JOIN u USING (site_id) JOIN sc USING (domain) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 100",
    "embedding_texts": f"WITH {_SM}, {_EMBED} SELECT * FROM emb",
    "sites_to_embed": f"WITH {_SM}, {_EMBED} SELECT id, hash FROM emb WHERE id NOT IN (SELECT domain FROM site_vectors WHERE embedded_of = 'site' AND vec IS NOT NULL AND domain IS NOT NULL)",
}
