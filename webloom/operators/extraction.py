"""What pages say of themselves: HTML read into fields, blocks and links, charsets, checks of what was fetched."""

from __future__ import annotations

import codecs
import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators.passes import INTENTS
from webloom.plans.lineage import keep
from webloom.sources.tables import table

# Words of a page's body, links and key pages kept, and hops that links are followed.
BODY_WORDS, LINKS, KEY_PAGES, HOPS = 100, 500, 6, 3
#: Titles of pages that stand in for a site's own, and of sign-in pages.
CHECKS = r"^(?:just a moment|attention required|access denied|are you a robot|checking your browser|domain for sale|this domain is parked|account suspended|[0-9]{3} (?:forbidden|not found)|page not found|not found|forbidden|unauthorized)"
SIGN_IN = r"\b(?:sign in|log in|login|anmelden|connexion|iniciar sesión)\b"
META = "title string, description string, lang string, site_name string, headings array<string>, body string, links array<struct<href:string,text:string>>, ld_names array<string>"


class _Page(HTMLParser):
    """One pass over a page's tags; unclosed ones end with the page."""

    VOID = frozenset("br hr img meta link input".split())

    def __init__(self, html: str):
        super().__init__()
        self.out = {"title": "", "description": None, "lang": None, "site_name": None, "headings": [], "links": [], "ld": []}
        self.body, self.into, self.buffer, self.skip = [], None, [], None
        self.feed(html)
        self.close()
        self._end()

    def _end(self):
        text = " ".join("".join(self.buffer).split())
        if self.into == "title" and not self.out["title"]:
            self.out["title"] = text
        elif self.into in ("h1", "h2", "h3") and text:
            self.out["headings"].append(text)
        elif self.into == "a" and self.out["links"]:
            self.out["links"][-1]["text"] = text
        elif self.into == "ld":
            try:
                found = json.loads("".join(self.buffer))
                for x in found if isinstance(found, list) else [found]:
                    if isinstance(x, dict) and x.get("@type") in ("WebSite", "Organization") and isinstance(x.get("name"), str):
                        self.out["ld"].append(x["name"])
            except ValueError:
                pass
        self.into, self.buffer = None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html" and a.get("lang"):
            self.out["lang"] = a["lang"]
        elif tag == "meta" and a.get("content") is not None:
            if (a.get("name") or "").lower() == "description":
                self.out["description"] = a["content"]
            elif a.get("property") == "og:site_name":
                self.out["site_name"] = a["content"]
        elif tag in ("title", "h1", "h2", "h3", "a"):
            self._end()
            self.into = tag
            if tag == "a":
                self.out["links"].append({"href": a.get("href"), "text": ""})
        elif tag == "script" and a.get("type") == "application/ld+json":
            self._end()
            self.into = "ld"
        elif tag in ("script", "style"):
            self.skip = tag

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        if tag == self.into or (tag == "script" and self.into == "ld"):
            self._end()

    def handle_data(self, data):
        if self.skip:
            return
        if self.into:
            self.buffer.append(data)
        if self.into not in ("title", "ld"):
            self.body.append(data)


def _read(batches):
    for pdf in batches:
        rows = []
        for i, html in zip(pdf["id"], pdf["html"]):
            p = _Page(html or "")
            o = p.out
            words = " ".join(p.body).split()
            rows.append((i, o["title"] or None, o["description"], o["lang"], o["site_name"], o["headings"], " ".join(words[:BODY_WORDS]), [x for x in o["links"] if x["href"]][:LINKS], o["ld"]))
        yield pd.DataFrame(rows, columns=["id", "title", "description", "lang", "site_name", "headings", "body", "links", "ld_names"])


def page_meta(pages: DataFrame) -> DataFrame:
    """id and META of pages (id, html): title, description, language, names, headings, the first BODY_WORDS words, LINKS links. A null page has empty fields."""
    return pages.select("id", "html").mapInPandas(_read, f"id {pages.schema['id'].dataType.simpleString()}, {META}")


def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _pages(spark, d) -> DataFrame:
    """Homepages written as HTML: fields in the head, headings, a script, a menu, unclosed tags."""
    m = table(spark, d, "homepage_meta").filter("meta_id is not null and title is not null and description is not null")
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Organization").alias("@type"), F.col("domain").alias("name"))), F.lit("</script>"))
    html = F.concat(F.lit('<html lang="de"><head><title> '), _escaped("title"), F.lit('</title><meta name="description" content="'), _escaped("description"), F.lit('">'), ld, F.lit("<style>p {}</style></head><body><h1>"), F.col("domain"), F.lit('</h1><script>var x = "<p>no</p>";</script><nav><a href="/in">In</a> <a href="https://hub.example/">Hub</a></nav><p>One <b>two</b><li>three'))
    return m.select(F.col("meta_id").alias("id"), html.alias("html"))


def extracted_meta(spark, d):
    m = page_meta(_pages(spark, d))
    return m.select(F.col("id").alias("meta_id"), "title", "description", "lang", F.get("headings", F.lit(0)).alias("heading"), F.get("ld_names", F.lit(0)).alias("name"), F.size("links").alias("links"), F.get("links", F.lit(1))["href"].alias("second"))


@F.pandas_udf(StringType())
def decoded(raw: pd.Series, declared: pd.Series) -> pd.Series:
    """Text of bytes: by their byte order mark, else as UTF-8 if valid, else as declared, else as windows-1252."""

    def one(b, name):
        if b is None:
            return None
        for mark, enc in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
            if b.startswith(mark):
                return b.decode(enc, "replace")
        for enc in ("utf-8", name):
            try:
                if enc:
                    return b.decode(enc)
            except (UnicodeDecodeError, LookupError):
                pass
        return b.decode("cp1252", "replace")

    return pd.Series([one(b, n) for b, n in zip(raw, declared)])


def decoded_titles(spark, d):
    """Titles as bytes of four charsets, declared or not, read again."""
    m = table(spark, d, "homepage_meta").filter("title is not null").select("meta_id", "title")
    latin = F.regexp_like("title", F.lit("^[\\x00-\\x7fà-öø-ÿ]*$"))
    kind = F.when(latin & (F.col("meta_id") % 3 == 0), "ISO-8859-1").when(F.col("meta_id") % 3 == 1, "UTF-16").otherwise("UTF-8")
    raw = F.when(kind == "ISO-8859-1", F.encode("title", "ISO-8859-1")).when(kind == "UTF-16", F.encode("title", "UTF-16")).otherwise(F.encode("title", "UTF-8"))
    return m.select("meta_id", decoded(raw, F.when(kind == "ISO-8859-1", "latin-1")).alias("title"))


def stand_ins(spark, d):
    """Homepages whose title is that of a check, a parked domain or an error, or that is a sign-in page, and the others."""
    t = F.lower(F.trim("title"))
    kind = F.when(F.regexp_like(t, F.lit(CHECKS)), "stand-in").when(F.regexp_like(t, F.lit(SIGN_IN)) | F.regexp_like(F.lower("url"), F.lit("/(?:login|signin|sign-in)(?:/|$)")), "sign-in").otherwise("page")
    return table(spark, d, "homepage_meta").filter("title is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("homepages"))


def key_pages(spark, d):
    """Links of a site to itself whose text is an intent, by site and intent: the address named most often; KEY_PAGES a site."""
    l = table(spark, d, "read_pages").select("domain", F.explode("links").alias("l"))  # noqa: E741
    own = l.select("domain", T.normalize(F.col("l.text")).alias("intent"), U.match_key(F.col("l.href")).alias("page"), U.host(F.col("l.href")).alias("host"))
    own = own.filter((F.col("host") == F.col("domain")) & F.col("intent").isin(*INTENTS))
    n = own.groupBy("domain", "intent", "page").agg(F.count("*").alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("domain", "intent").orderBy(F.desc("n"), "page"))).filter("r = 1")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "intent"))).filter(F.col("place") <= KEY_PAGES).select("domain", "intent", "page", "place")


def followed_links(spark, d):
    """Sites reached from the seeds of id divisible by 50 within HOPS links whose text has a word of two letters and more, with the fewest hops."""
    a = table(spark, d, "anchors").filter(F.regexp_like("anchor_text", F.lit(r"\p{L}{2}")) & F.col("linking_domain").isNotNull() & F.col("target_domain").isNotNull())
    e = keep(a.select(F.col("linking_domain").alias("src"), F.col("target_domain").alias("dst")).distinct())
    seen = keep(table(spark, d, "site_signals").filter("site_id % 50 = 0 and domain is not null").select(F.col("domain").alias("site")).distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, HOPS + 1):
        more = front.select(F.col("site").alias("src")).join(e, "src").select(F.col("dst").alias("site")).distinct().join(seen.select("site"), "site", "left_anti")
        front = keep(more.withColumn("hops", F.lit(hop)))
        seen = seen.union(front)
    return seen


def sections(spark, d):
    """Sections of pages by their headings in Markdown: place, anchor and number of words."""
    lines = table(spark, d, "read_pages").filter("page_id is not null and text is not null").select("page_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    w = Window.partitionBy("page_id").orderBy("at")  # as long as one page
    s = lines.withColumn("section", F.sum(F.regexp_like("line", F.lit("^#+ ")).cast("int")).over(w))
    anchor = F.max(F.when(F.regexp_like("line", F.lit("^#+ ")), F.replace(T.normalize(F.col("line")), F.lit(" "), F.lit("-"))))
    words = F.sum(F.when(F.regexp_like("line", F.lit("^#+ ")), 0).otherwise(F.size(T.words(F.col("line")))))
    return s.groupBy("page_id", "section").agg(F.coalesce(anchor, F.lit("")).alias("anchor"), words.alias("words"))


QUERIES = {f.__name__: f for f in (extracted_meta, decoded_titles, stand_ins, key_pages, followed_links, sections)}
_INT = "(" + ", ".join(f"'{w}'" for w in INTENTS) + ")"
_T = "lower(trim(title))"
SQL = {
    "extracted_meta": r"SELECT meta_id, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS title, description, 'de' AS lang, domain AS heading, domain AS name, 2 AS links, 'https://hub.example/' AS second FROM homepage_meta WHERE meta_id IS NOT NULL AND title IS NOT NULL AND description IS NOT NULL",
    "decoded_titles": "SELECT meta_id, title FROM homepage_meta WHERE title IS NOT NULL",
    "stand_ins": f"SELECT CASE WHEN regexp_matches({_T}, '{CHECKS}') THEN 'stand-in' WHEN regexp_matches({_T}, '{SIGN_IN}') OR regexp_matches(lower(url), '/(login|signin|sign-in)(/|$)') THEN 'sign-in' ELSE 'page' END AS kind, count(*) AS homepages FROM homepage_meta WHERE title IS NOT NULL GROUP BY 1",
    "key_pages": f"WITH l AS (SELECT domain, unnest(links) AS l FROM read_pages), o AS (SELECT domain, array_to_string({T.words_sql('l.text')}, ' ') AS intent, {U.match_key_sql('l.href')} AS page, {U.host_sql('l.href')} AS host FROM l), n AS (SELECT domain, intent, page, count(*) AS n FROM o WHERE host = domain AND intent IN {_INT} GROUP BY 1, 2, 3), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, intent ORDER BY n DESC, page) AS r FROM n) WHERE r = 1) SELECT domain, intent, page, place FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, intent) AS place FROM b) WHERE place <= {KEY_PAGES}",
    "followed_links": f"WITH RECURSIVE e AS (SELECT DISTINCT linking_domain AS src, target_domain AS dst FROM anchors WHERE regexp_matches(anchor_text, '\\p{{L}}{{2}}') AND linking_domain IS NOT NULL AND target_domain IS NOT NULL), r AS (SELECT DISTINCT domain AS site, 0 AS hops FROM site_signals WHERE site_id % 50 = 0 AND domain IS NOT NULL UNION SELECT dst, hops + 1 FROM r JOIN e ON r.site = e.src WHERE hops < {HOPS}) SELECT site, min(hops) AS hops FROM r GROUP BY 1",
    "sections": f"WITH l AS (SELECT page_id, string_split(text, chr(10)) AS l FROM read_pages WHERE page_id IS NOT NULL AND text IS NOT NULL), x AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM l), s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#+ ') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM x) SELECT page_id, section, coalesce(max(CASE WHEN regexp_matches(line, '^#+ ') THEN replace(array_to_string({T.words_sql('line')}, ' '), ' ', '-') END), '') AS anchor, sum(CASE WHEN regexp_matches(line, '^#+ ') THEN 0 ELSE len({T.words_sql('line')}) END)::BIGINT AS words FROM s GROUP BY 1, 2",
}
