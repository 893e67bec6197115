"""Queries that write tables in a format and read them again: exact round trips of readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import merge, search
from webloom.plans.lineage import shared_dir
from webloom.sources import readers as R
from webloom.sources import writers as W
from webloom.sources.tables import table

_PLAIN = ["id", "rev", "title", "url", "about", "lang", "weight"]


def _at(spark, name: str) -> str:
    return f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"


def _text(lines: DataFrame, name: str, compression: str = "none") -> str:
    path = _at(lines.sparkSession, name)
    lines.write.option("compression", compression).text(path)
    return path


def items_scan(spark, d):
    path = W.write_jsonl(table(spark, d, "site_items"), _at(spark, "items"))
    return R.read_items(spark, path).select(*_PLAIN, F.size("names").alias("names"))


def item_heads(spark, d):
    return R.read_heads(spark, W.write_jsonl(table(spark, d, "site_items"), _at(spark, "heads")))


def gzip_lines(spark, d):
    """Lines of a compressed text by length; those over a mebibyte are skipped."""
    lines = table(spark, d, "documents").filter("text is not null").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    return R.read_lines(spark, _text(lines, "gz", "gzip")).groupBy(F.length("value").alias("length")).agg(F.count("*").alias("lines"))


def rank_list_scan(spark, d):
    s = table(spark, d, "site_signals").filter("domain is not null and tranco_rank > 0").select("tranco_rank", "domain")
    path = _at(spark, "ranks")
    s.write.csv(path)
    return R.read_rank_list(spark, path)


def domain_ranks_scan(spark, d):
    s = merge.signals(spark, d).filter("harmonic_rank is not null and pagerank_rank is not null")
    turned = F.array_join(F.reverse(F.split("domain", r"\.")), ".")
    lines = s.select(F.concat_ws("\t", "harmonic_rank", F.lit("1.5E3"), "pagerank_rank", F.lit("0.5"), turned, F.lit("7")).alias("value"))
    head = spark.createDataFrame([("#harmonicc_pos\t#harmonicc_val\t#pr_pos\t#pr_val\t#host_rev\t#n_hosts",)], "value string")
    return R.read_domain_ranks(spark, _text(head.union(lines), "domain-ranks"))


def _wat_lines(spark, d) -> DataFrame:
    meta = table(spark, d, "homepage_meta").filter("url is not null and domain is not null")
    links = F.array(F.struct(F.lit("A@/href").alias("path"), F.concat(F.lit("https://"), "domain", F.lit("/in")).alias("url"), F.lit("in").alias("text")), F.struct(F.lit("A@/href").alias("path"), F.lit("https://hub.example/x").alias("url"), F.coalesce("site_name", F.lit("none")).alias("text")))
    metas = F.array(F.struct(F.lit("description").alias("name"), F.lit(None).cast("string").alias("property"), F.col("description").alias("content")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("og:site_name").alias("property"), F.col("site_name").alias("content")))
    html = F.struct(F.struct(F.col("title").alias("Title"), metas.alias("Metas")).alias("Head"), links.alias("Links"))
    status = F.when(F.col("meta_id") % 7 == 0, "404").otherwise("200")
    body = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(status.alias("Status")).alias("Response-Message"), html.alias("HTML-Metadata")).alias("HTTP-Response-Metadata")).alias("Payload-Metadata")).alias("Envelope")))
    return meta.select(F.concat(F.lit("WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Target-URI: https://"), "domain", F.lit("/"), "meta_id", F.lit("\r\nContent-Type: application/json\r\n\r\n"), body, F.lit("\r\n\r\n")).alias("value"))


def wat_homepages(spark, d):
    home, _ = R.wat_extract(R.read_wat(spark, _text(_wat_lines(spark, d), "wat")))
    return home.select("domain", "title", "description", "site_name")


def wat_links(spark, d):
    _, links = R.wat_extract(R.read_wat(spark, _text(_wat_lines(spark, d), "wat", "gzip")))
    return links.groupBy("target_domain", "anchor_text").agg(F.count("*").alias("links"))


def wet_pages(spark, d):
    pages = table(spark, d, "read_pages").filter("length(trim(text)) > 0 and url is not null")
    lines = pages.select(F.concat(F.lit("WARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: https://p.example/"), "page_id", F.lit("\nContent-Type: text/plain\n\n"), F.rtrim("text"), F.lit("\n\n")).alias("value"))
    return R.read_wet(spark, _text(lines, "wet")).select("url", F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text"))


def official_sites_scan(spark, d):
    s = table(spark, d, "site_signals").filter("official_site and domain is not null").select("site_id", "domain").distinct()
    item = F.concat(F.when(F.col("site_id") % 2 == 0, "http://data.example/entity/Q").otherwise("Q"), "site_id")
    lines = s.select(F.concat_ws("\t", item, F.lit("a label"), F.concat(F.lit("https://"), "domain", F.lit("/"))).alias("value"))
    path = _at(spark, "official")
    lines.select(F.split("value", "\t").alias("x")).select(F.col("x")[0].alias("item"), F.col("x")[1].alias("label"), F.col("x")[2].alias("website")).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return R.read_official_sites(spark, path).select("item", U.host(F.col("website")).alias("domain"))


def facts_attached(spark, d):
    """Official sites with the facts and the first sentence that two tables hold for their items."""
    s = table(spark, d, "site_signals").filter("official_site and site_id is not null").select("site_id", "domain").distinct()
    facts = R.read_by_item(spark, _text(s.filter("site_id % 3 = 0").select(F.concat_ws("\t", F.concat(F.lit("Q"), "site_id"), F.lit("founded"), F.lit("1950")).alias("value")), "facts"), ["fact", "value"])
    intros = R.read_by_item(spark, _text(s.filter("site_id % 5 = 0").select(F.concat_ws("\t", F.concat(F.lit("Q"), "site_id"), F.concat("domain", F.lit(" is a site."))).alias("value")), "intros"), ["intro"])
    own = s.select(F.concat(F.lit("Q"), "site_id").alias("item"), "domain")
    return own.join(facts, "item", "left").join(intros, "item", "left").select("item", "fact", "value", "intro")


def articles_scan(spark, d):
    docs = table(spark, d, "documents").filter("doc_id is not null and length(trim(title)) > 0")
    one = F.regexp_replace("title", r"\s+", " ")
    line = F.concat(F.concat_ws("\t", F.coalesce("n_chars", F.lit(0)), one, F.lit("about it"), F.concat(F.lit("Q"), "doc_id"), F.coalesce("site", F.lit("")), F.concat(one, F.lit("|other"))), F.when(F.col("doc_id") % 2 == 0, F.lit("\nprofiles\tx\ty")).otherwise(""))
    got = R.read_articles(spark, _text(docs.select(line.alias("value")), "articles", "gzip"))
    return got.select("item", "views", F.trim("title").alias("title"), F.size("aliases").alias("aliases"), F.size("profiles").alias("profiles"))


def places_scan(spark, d):
    c = table(spark, d, "customer").select(F.concat_ws("\t", "c_name", F.lit("town"), (F.col("c_custkey") % 200 - 95).cast("double"), (F.col("c_nationkey") * 3.5), F.floor("c_acctbal"), F.lit("3")).alias("value"))
    return R.read_places(spark, _text(c, "places")).select("name", "lat", "lon", "population")


def sql_dump_rows(spark, d):
    quoted = F.concat(F.lit("'"), F.replace(F.replace("p_name", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    tuples = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("g"), F.concat(F.lit("("), "p_partkey", F.lit(","), quoted, F.lit(",NULL,'it''s; (ok)')")).alias("t"))
    lines = tuples.groupBy("g").agg(F.array_join(F.collect_list("t"), ",").alias("t")).select(F.concat(F.lit("INSERT INTO `part` VALUES "), "t", F.lit(";")).alias("value"))  # fiftieths
    rows = R.read_sql_dump(spark, _text(lines, "dump"), "part")
    return rows.select(F.col("row")[0].cast("long").alias("p_partkey"), F.col("row")[1].alias("p_name"), F.col("row")[2].alias("nothing"), F.col("row")[3].alias("note"))


def set_items(spark, d):
    """Items written as a set in parts and read again by its manifest: the newest revision of each."""
    items = table(spark, d, "site_items").filter("id is not null").dropDuplicates(["id", "rev"])
    return R.read_set(spark, W.write_set(items, 400, _at(spark, "set"))).select("id", "rev")


def set_parts(spark, d):
    """Lines and least weight of each part of a set."""
    items = table(spark, d, "site_items").filter("id is not null").dropDuplicates(["id", "rev"])
    manifest = W.write_set(items, 400, _at(spark, "set"))
    folder = manifest.rsplit("/", 1)[0]
    if not R.set_parts(spark, manifest):
        return spark.createDataFrame([], "part int, lines long, lightest double")
    rows = spark.read.text(f"{folder}/parts").select("part", F.get_json_object("value", "$.weight").cast("double").alias("w"))
    return rows.groupBy("part").agg(F.count("*").alias("lines"), F.min(F.coalesce("w", F.lit(0.0))).alias("lightest"))


def batch_lines(spark, d):
    """Lines of the batches of each day that hold what they claim and are neither too old nor ahead."""
    e = table(spark, d, "events").select(F.floor(F.unix_timestamp("ts") / 86400).alias("epoch"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("peer"), F.col("event_id").cast("string").alias("line"))
    b = e.groupBy("peer", "epoch").agg(F.array_sort(F.collect_list("line")).alias("lines")).withColumn("count", F.size("lines") + F.when(F.col("epoch") % 5 == 0, 1).otherwise(0))
    got = R.read_batches(spark, W.write_jsonl(b, _at(spark, "batches")), 19740)
    return got.groupBy("peer", "epoch").agg(F.count("*").alias("lines"))


def queries_file(spark, d):
    c = table(spark, d, "candidate_lists").filter("query is not null").groupBy("query").agg(F.array_sort(F.collect_set(F.col("site_id").cast("string"))).alias("s"))  # the sites of one list
    lines = c.select(F.concat(F.trim("query"), F.lit("\t"), F.array_join("s", ", "), F.lit(",a%2Cb")).alias("value"))
    head = spark.createDataFrame([("﻿# a comment",), ("",)], "value string")
    return R.read_queries(spark, _text(head.union(lines), "queries")).select("query", F.size("expected").alias("answers"), F.element_at("expected", -1).alias("last"))


def contracts_scan(spark, d):
    path = W.write_jsonl(table(spark, d, "audit_cases"), _at(spark, "contracts"))
    return R.read_contracts(spark, path).groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("cases"))


def host_list(spark, d):
    s = table(spark, d, "site_signals").filter("domain is not null").select("domain", "site_id").distinct()
    form = F.when(F.col("site_id") % 3 == 0, F.concat(F.lit("0.0.0.0 "), "domain")).when(F.col("site_id") % 3 == 1, F.concat("domain", F.lit("  # a note"))).otherwise(F.concat(F.lit("deep.below."), "domain"))
    return R.read_host_list(spark, _text(s.select(form.alias("value")), "hosts"))


def feed_entries(spark, d):
    """Entries of feeds of the last week before a day, by feed day."""
    e = table(spark, d, "events").filter("event_type = 'signup'")
    item = F.concat(F.lit("<item><title>Post "), "event_id", F.lit("</title><link>https://f.example/"), "event_id", F.lit("</link><pubDate>"), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit("</pubDate></item>"))
    feeds = e.select((F.col("user_id") % 8).alias("feed"), item.alias("item")).groupBy("feed").agg(F.array_join(F.collect_list("item"), "").alias("items"))  # eighths
    path = _at(spark, "feeds")
    feeds.select("feed", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")).repartition("feed").write.partitionBy("feed").text(path)
    got = R.read_feeds(spark, path)
    recent = got.filter(F.col("published").between(F.lit("2024-01-15").cast("timestamp"), F.lit("2024-01-22").cast("timestamp")))
    return recent.groupBy(F.date_format("published", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("entries"))


def compacted(spark, d):
    """Records with their journal folded in, read again."""
    items = table(spark, d, "site_items").filter("id is not null").select("id", "rev", "weight")
    base, journal = items.filter("rev % 2 = 0"), items.filter("rev % 2 = 1 or rev is null")
    return R.read_heads(spark, W.compact(base, journal, "id", "rev", _at(spark, "compacted"))).select("id", "rev")


def bucketed_keys(spark, d):
    """Sites kept under each key of the buckets, and the best of them."""
    sites = merge.with_link_score(merge.signals(spark, d)).select("domain", F.round("link_score", 5).alias("score"))
    titled = merge.site_merge(spark, d).select(F.col("id").alias("domain"), "title").join(sites, "domain")
    got = spark.read.schema("domain string, score double, key string, place int, bucket int").parquet(W.write_buckets(titled, 32, _at(spark, "buckets")))
    return got.groupBy("key", "bucket").agg(F.count("*").alias("sites"), F.min_by("domain", "place").alias("best"))


def index_tables(spark, d):
    """Terms of a written index that a scan finds by ranges, with df and largest tf."""
    path = W.write_index(search.postings(spark, d), search.doc_lengths(spark, d), _at(spark, "index"))
    hits = spark.read.parquet(f"{path}/postings").filter("term >= 'm' and term < 'n'").groupBy("term").agg(F.count("*").alias("postings"))
    return hits.join(spark.read.parquet(f"{path}/terms"), "term").select("term", "postings", "df", "most")


def report_lines(spark, d):
    """Lines of a written report by part."""
    from webloom.operators import evaluation

    path = W.write_report({"run": 1}, evaluation.ndcg10(spark, d), evaluation.mrr_by_suite(spark, d), _at(spark, "report"))
    return spark.read.text(f"{path}/*").groupBy(F.regexp_extract(F.input_file_name(), r"/(\d-[a-z]+)/", 1).alias("part")).agg(F.count("*").alias("lines"))


def feature_rows(spark, d):
    """Features of graded rows, written as JSON lines and read again: place, score and grade sums of each case."""
    from webloom.operators import evaluation

    path = W.write_jsonl(evaluation.graded(spark, d).select("case_id", "domain", "grade", "place", "score"), _at(spark, "features"))
    rows = spark.read.schema("case_id long, domain string, grade int, place int, score double").json(path)
    return rows.groupBy("case_id").agg(F.count("*").alias("rows"), F.sum("grade").alias("grades"), F.sum("place").alias("places"))


QUERIES = {f.__name__: f for f in (items_scan, item_heads, gzip_lines, rank_list_scan, domain_ranks_scan, wat_homepages, wat_links, wet_pages, official_sites_scan, facts_attached, articles_scan, places_scan, sql_dump_rows, set_items, set_parts, batch_lines, queries_file, contracts_scan, host_list, feed_entries, compacted, bucketed_keys, index_tables, report_lines, feature_rows)}
_U = "u AS (SELECT DISTINCT ON (id, rev) id, rev, weight FROM site_items WHERE id IS NOT NULL)"
SQL = {
    "items_scan": "SELECT id, rev, title, url, about, lang, weight, len(names) AS names FROM site_items WHERE id IS NOT NULL",
    "item_heads": "SELECT id, rev, weight FROM site_items WHERE id IS NOT NULL",
    "gzip_lines": r"SELECT length(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS length, count(*) AS lines FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "rank_list_scan": f"SELECT coalesce({U.domain_sql('lower(domain)')}, lower(domain)) AS domain, min(tranco_rank) AS rank FROM site_signals WHERE domain IS NOT NULL AND tranco_rank > 0 GROUP BY 1",
    "domain_ranks_scan": f"WITH {merge._SIGNALS} SELECT domain, h AS harmonic_rank, p AS pagerank_rank, 7 AS hosts FROM s WHERE h IS NOT NULL AND p IS NOT NULL",
    "wat_homepages": r"SELECT regexp_replace(domain, '^www\.', '') AS domain, title, description, site_name FROM homepage_meta WHERE url IS NOT NULL AND domain IS NOT NULL AND meta_id % 7 <> 0",
    "wat_links": "SELECT 'hub.example' AS target_domain, trim(coalesce(site_name, 'none')) AS anchor_text, count(*) AS links FROM homepage_meta WHERE url IS NOT NULL AND domain IS NOT NULL AND meta_id % 7 <> 0 GROUP BY 1, 2",
    "wet_pages": r"SELECT 'https://p.example/' || page_id AS url, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM read_pages WHERE length(trim(text)) > 0 AND url IS NOT NULL",
    "official_sites_scan": r"SELECT DISTINCT 'Q' || site_id AS item, regexp_replace(domain, '^www\.', '') AS domain FROM site_signals WHERE official_site AND domain IS NOT NULL",
    "facts_attached": "SELECT DISTINCT 'Q' || site_id AS item, CASE WHEN site_id % 3 = 0 THEN 'founded' END AS fact, CASE WHEN site_id % 3 = 0 THEN '1950' END AS value, CASE WHEN site_id % 5 = 0 THEN domain || ' is a site.' END AS intro FROM site_signals WHERE official_site AND site_id IS NOT NULL",
    "articles_scan": r"SELECT 'Q' || doc_id AS item, coalesce(n_chars, 0) AS views, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, 2 AS aliases, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS profiles FROM documents WHERE doc_id IS NOT NULL AND length(trim(title)) > 0",
    "places_scan": "SELECT c_name AS name, (c_custkey % 200 - 95)::DOUBLE AS lat, c_nationkey * 3.5::DOUBLE AS lon, floor(c_acctbal)::BIGINT AS population FROM customer WHERE c_custkey % 200 - 95 BETWEEN -90 AND 90",
    "sql_dump_rows": "SELECT p_partkey, p_name, NULL::VARCHAR AS nothing, 'it''s; (ok)' AS note FROM part",
    "set_items": "SELECT id, max(rev) AS rev FROM site_items WHERE id IS NOT NULL GROUP BY 1",
    "set_parts": f"WITH {_U}, r AS (SELECT *, row_number() OVER (ORDER BY coalesce(weight, 0) DESC, id, rev NULLS FIRST) - 1 AS n FROM u) SELECT (n // 400)::INT AS part, count(*) AS lines, min(coalesce(weight, 0)) AS lightest FROM r GROUP BY 1",
    "batch_lines": "SELECT 'u' || (user_id % 40) AS peer, floor(floor(epoch(ts)) / 86400)::BIGINT AS epoch, count(*) AS lines FROM events WHERE floor(floor(epoch(ts)) / 86400) BETWEEN 19733 AND 19741 AND floor(floor(epoch(ts)) / 86400)::BIGINT % 5 <> 0 GROUP BY 1, 2",
    "queries_file": "SELECT trim(query) AS query, count(DISTINCT site_id) + 1 AS answers, 'a,b' AS last FROM candidate_lists WHERE query IS NOT NULL GROUP BY query",
    "contracts_scan": "SELECT coalesce(split, 'none') AS split, count(*) AS cases FROM audit_cases WHERE length(id) > 0 AND length(query) > 0 AND len(relevant) > 0 AND len(list_filter(relevant, lambda r: r.grade BETWEEN 0 AND 3)) = len(relevant) GROUP BY 1",
    "host_list": rf"SELECT DISTINCT regexp_replace(lower(domain), '^www\.', '') AS domain FROM site_signals WHERE domain IS NOT NULL AND site_id % 3 <> 2 AND {U.domain_sql('lower(domain)')} = lower(domain)",
    "feed_entries": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS entries FROM events WHERE event_type = 'signup' AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-22' GROUP BY 1",
    "compacted": "SELECT id, max(rev) AS rev FROM site_items WHERE id IS NOT NULL GROUP BY 1",
    "bucketed_keys": None,
    "index_tables": None,
    "report_lines": "SELECT '0-manifest' AS part, 1 AS lines UNION ALL SELECT '1-cases', (SELECT count(DISTINCT case_id) FROM audit_cases WHERE len(relevant) > 0) UNION ALL SELECT '2-summary', (SELECT count(DISTINCT coalesce(suite, 'none')) FROM audit_cases WHERE case_id IS NOT NULL AND len(relevant) > 0)",
    "feature_rows": None,
}
_KEYS = f"WITH m AS ({merge.SQL['site_merge']}), {merge._SIGNALS}, {merge._SCORE}, t AS (SELECT id AS domain, {T.words_sql('title')} AS w, round(score, 5) AS score FROM m JOIN sc ON sc.domain = m.id), k AS (SELECT DISTINCT domain, score, unnest(list_append(w, array_to_string(w, ''))) AS key FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, domain) AS place FROM k WHERE length(key) >= 2)"
SQL["bucketed_keys"] = f"{_KEYS} SELECT key, {W.H.prefix_mod_sql(chr(39) + W.H.BUCKET_SALT + chr(39) + ' || chr(0) || key', W.H.BUCKETS)} AS bucket, count(*) AS sites, min_by(domain, place) AS best FROM r WHERE place <= 32 GROUP BY 1, 2"
SQL["index_tables"] = f"WITH {search._BASE} SELECT term, count(*) AS postings, count(*) AS df, max(tf) AS most FROM tf WHERE term >= 'm' AND term < 'n' GROUP BY 1"


def _graded_sql() -> str:
    from webloom.operators import evaluation

    return f"WITH {evaluation._GRADED} SELECT case_id, count(*) AS rows, sum(grade)::BIGINT AS grades, sum(place)::BIGINT AS places FROM g GROUP BY 1"


SQL["feature_rows"] = _graded_sql()
