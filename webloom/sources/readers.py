"""Readers of the formats a web corpus comes in. All are lazy scans: splits, compression and pruning are left to the sources."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls as U

# Longest line that counts, and the columns of an item.
LONGEST_LINE = 1 << 20
ITEM = "id string, kind string, rev long, title string, url string, site string, names array<string>, about string, lang string, weight double, labels array<string>, published string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of plain or compressed text, without those over LONGEST_LINE."""
    return spark.read.text(path).filter(F.length("value") <= LONGEST_LINE)


def read_items(spark: SparkSession, path: str, schema: str = ITEM) -> DataFrame:
    """Items, one JSON object a line; a line that is none gives no row. Records of the older layout name the id domain."""
    lines = read_lines(spark, path).select(F.from_json("value", schema).alias("x"), F.get_json_object("value", "$.domain").alias("domain"))
    old = F.coalesce(F.col("x.id"), F.col("domain"))
    return lines.filter(old.isNotNull()).select(old.alias("id"), *[f"x.{f.split()[0]}" for f in schema.split(", ")[1:]])


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """id, rev, weight of each item, without parsing the rest of its line."""
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return read_lines(spark, path).select(F.coalesce(get("id"), get("domain")).alias("id"), get("rev").cast("long").alias("rev"), get("weight").cast("double").alias("weight")).filter("id is not null")


def read_rank_list(spark: SparkSession, path: str) -> DataFrame:
    """domain, rank: a rank,domain CSV without header, by registrable domain; the best rank of each."""
    rows = spark.read.schema("rank int, name string").csv(path)
    return rows.select(F.coalesce(U.registrable_domain(F.lower("name")), F.lower("name")).alias("domain"), "rank").filter("rank > 0 and domain is not null").groupBy("domain").agg(F.min("rank").alias("rank"))


def read_domain_ranks(spark: SparkSession, path: str) -> DataFrame:
    """domain, harmonic_rank, pagerank_rank, hosts: a tab-separated rank table with reversed hosts and # headers."""
    rows = spark.read.option("sep", "\t").option("comment", "#").schema("harmonic_rank long, h double, pagerank_rank long, p double, turned string, hosts long").csv(path)
    return rows.filter("turned is not null").select(F.array_join(F.reverse(F.split(F.trim("turned"), r"\.")), ".").alias("domain"), "harmonic_rank", "pagerank_rank", "hosts")


def _warc(spark: SparkSession, path: str) -> DataFrame:
    """type, uri, body: the records of a WARC archive; each is one line of a scan that ends lines where records start."""
    raw = spark.read.option("lineSep", "WARC/1.0").text(path).filter(F.trim("value") != "")
    header = lambda k: F.regexp_extract("value", rf"(?im)^{k}:\s*(.*?)\s*$", 1)
    body = F.regexp_extract("value", r"(?s)^.*?\r?\n\r?\n(.*)$", 1)
    return raw.select(header("WARC-Type").alias("type"), header("WARC-Target-URI").alias("uri"), F.regexp_replace(body, r"\s+$", "").alias("body"))


def read_wat(spark: SparkSession, path: str) -> DataFrame:
    """url, status, title, metas, links of the responses of a WAT archive."""
    schema = "struct<Envelope:struct<`Payload-Metadata`:struct<`HTTP-Response-Metadata`:struct<`Response-Message`:struct<Status:string>,`HTML-Metadata`:struct<Head:struct<Title:string,Metas:array<struct<name:string,property:string,content:string>>>,Links:array<struct<path:string,url:string,text:string>>>>>>>"
    rows = _warc(spark, path).filter("type = 'metadata'").select("uri", F.from_json("body", schema)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"].alias("r")).filter("r is not null")
    html = "r.`HTML-Metadata`."
    return rows.select(F.col("uri").alias("url"), F.col("r.`Response-Message`.Status").cast("int").alias("status"), F.col(html + "Head.Title").alias("title"), F.col(html + "Head.Metas").alias("metas"), F.col(html + "Links").alias("links"))


def wat_extract(wat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Homepages (domain, url, title, description, site_name) of a WAT scan that answered 200, and links between sites (linking_domain, target_domain, anchor_text)."""
    ok = wat.filter("status = 200")
    meta = lambda field, value: F.get(F.filter("metas", lambda m: F.lower(m[field]) == value), F.lit(0))["content"]
    home = ok.select(U.host(F.col("url")).alias("domain"), "url", "title", meta("name", "description").alias("description"), meta("property", "og:site_name").alias("site_name"))
    links = ok.select(U.host(F.col("url")).alias("linking_domain"), F.explode("links").alias("l")).filter("l.path = 'A@/href'")
    out = links.select("linking_domain", U.host(F.col("l.url")).alias("target_domain"), F.trim("l.text").alias("anchor_text")).filter("target_domain is not null and target_domain <> linking_domain")
    return home, out


def read_wet(spark: SparkSession, path: str) -> DataFrame:
    """url, text: the page texts of a WET archive."""
    return _warc(spark, path).filter("type = 'conversion'").select(F.col("uri").alias("url"), F.col("body").alias("text"))


def read_official_sites(spark: SparkSession, path: str) -> DataFrame:
    """item, label, website: tab-separated, with a header; items as bare ids or as addresses that end in one."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("item string, label string, website string").csv(path)
    return rows.select(F.regexp_extract("item", r"(Q\d+)$", 1).alias("item"), "label", "website").filter("item <> '' and website is not null")


def read_by_item(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """item and the named columns of a tab-separated table without header; the first row of an item counts by its values."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema(", ".join(["item string", *[f"{n} string" for n in names]])).csv(path)
    one = rows.filter("item is not null").groupBy("item").agg(F.min(F.struct(*names)).alias("x"))
    return one.select("item", "x.*")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """views, title, description, item, site, aliases, profiles: tab-separated, most read first; a row may be followed by a line of profiles.

    A line stays with the row before it, so files must not be split: compressed ones aren't.
    """

    def glued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def out(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["views", "title", "description", "item", "site", "aliases", "profiles"])

        for pdf in batches:
            rows = held
            held = []
            for line in pdf["value"]:
                parts = line.split("\t")
                if parts[0] == "profiles" and rows:
                    rows[-1][6] = parts[1:]
                elif parts[0].isdigit():
                    parts += [""] * (6 - len(parts))
                    rows.append([int(parts[0]), *[p or None for p in parts[1:5]], [a for a in parts[5].split("|") if a], []])
            if rows:
                held = [rows[-1]]
                yield out(rows[:-1])
        yield out(held)

    return read_lines(spark, path).mapInPandas(glued, "views long, title string, description string, item string, site string, aliases array<string>, profiles array<string>")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """name, kind, lat, lon, population, tags of a tab-separated table of places."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("name string, kind string, lat double, lon double, population long, tags int").csv(path)
    return rows.filter("name is not null and lat between -90 and 90 and lon between -180 and 180")


def read_sql_dump(spark: SparkSession, path: str, name: str) -> DataFrame:
    """row (array of strings, null for NULL): the tuples of a table's INSERT statements in a dump."""
    value = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,()'\s]+))\s*([,)])")
    start = re.compile(rf"^INSERT INTO `?{re.escape(name)}`?(?: \([^)]*\))? VALUES\s*")
    escapes = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for line in pdf["value"]:
                if not (m := start.match(line)):
                    continue
                at = m.end()
                while at < len(line) and (at := line.find("(", at)) >= 0:
                    row, at, end = [], at + 1, ","
                    while end == "," and (v := value.match(line, at)):
                        text, bare, end = v.groups()
                        row.append(re.sub(r"\\(.)|''", lambda e: escapes.get(e[1], e[1]) if e[1] else "'", text) if text is not None else None if bare.upper() == "NULL" else bare)
                        at = v.end()
                    if end != ")":
                        break
                    out.append(row)
            yield pd.DataFrame({"row": out})

    return spark.read.text(path).mapInPandas(rows, "row array<string>")


def set_parts(spark: SparkSession, manifest: str) -> list[str]:
    """The parts that a set's manifest names."""
    read = spark.read.schema("version int, parts array<struct<name:string,lines:long>>").option("multiLine", True).json(manifest)
    return [r.name for r in read.select(F.explode("parts").alias("p")).select("p.name").collect()]


def read_set(spark: SparkSession, manifest: str) -> DataFrame:
    """Items of a set: the parts its manifest (JSON: parts, each with name and lines) names, without tombstones; of an item's revisions the newest."""
    folder = manifest.rsplit("/", 1)[0]
    parts = set_parts(spark, manifest)
    if not parts:
        return spark.createDataFrame([], ITEM)
    rows = read_items(spark, [f"{folder}/{p}" for p in parts], ITEM + ", gone boolean")
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct("rev", F.coalesce("gone", F.lit(False)))).alias("x"))
    return newest.filter("not coalesce(x.gone, false)").select("id", "x.*").drop("gone")


def read_batches(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """peer, epoch, line of batches (JSON: peer, epoch, count, lines) that hold what they claim and aren't older than seven epochs or more than one ahead."""
    rows = spark.read.schema("peer string, epoch long, count int, lines array<string>").json(path)
    good = rows.filter((F.size("lines") == F.col("count")) & F.col("epoch").between(epoch - 7, epoch + 1))
    return good.select("peer", "epoch", F.explode("lines").alias("line"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query, expected: query, tab, answers with commas between (a comma in one is %2C); # starts a comment."""
    rows = spark.read.text(path).select(F.regexp_replace("value", "^\\ufeff", "").alias("v")).filter(~F.startswith(F.ltrim("v"), F.lit("#")) & F.contains("v", F.lit("\t")))
    answers = F.filter(F.transform(F.split(F.get(F.split("v", "\t"), F.lit(1)), ","), lambda a: F.trim(F.replace(a, F.lit("%2C"), F.lit(",")))), lambda a: a != "")
    return rows.select(F.trim(F.get(F.split("v", "\t"), F.lit(0))).alias("query"), answers.alias("expected")).filter("query <> ''")


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Acceptance cases, one JSON object a line; those without id, query or answers, or of grades outside 0 to 3, are left out."""
    rows = spark.read.schema("id string, family string, category string, query string, split string, label_status string, relevant array<struct<identity:string,grade:int>>, negatives array<struct<identity:string,max_rank:int>>").json(path)
    return rows.filter((F.length("id") > 0) & (F.length("query") > 0) & (F.size("relevant") > 0) & F.forall("relevant", lambda r: r["grade"].between(0, 3)))


def read_host_list(spark: SparkSession, path: str) -> DataFrame:
    """domain: the whole sites of a hosts file (address, host) or a plain list; hosts below a site are left out."""
    host = F.lower(F.regexp_extract("value", r"^\s*(?:[0-9.:]+\s+)?([A-Za-z0-9.-]+\.[A-Za-z0-9-]+)\s*(?:#.*)?$", 1))
    return spark.read.text(path).select(F.regexp_replace(host, r"^www\.", "").alias("domain")).filter((F.col("domain") != "") & (F.col("domain") == U.registrable_domain(F.col("domain")))).distinct()


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """feed, title, link, published: the entries of RSS files, one feed a file."""
    rows = spark.read.option("rowTag", "item").schema("title string, link string, pubDate string").format("xml").load(path).select(F.input_file_name().alias("feed"), F.trim("title").alias("title"), F.trim("link").alias("link"), F.to_timestamp("pubDate", "dd MMM yyyy HH:mm:ss").alias("published"))
    return rows.filter("title <> '' and link <> ''")
