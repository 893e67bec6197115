"""Main text of pages: templates deduced from tokens that share their occurrence vectors across a host's pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.residue import page_residue
from webloom.plans.lineage import keep
from webloom.sources.tables import table

#: Least part of its host's template pages on which a line of the template is found.
SUPPORT = 0.4
#: Least number of hosts that share a line which no host's own pages prove.
HOSTS = 3
#: Least part of such a line's occurrences that are loose, that is, not straight after a sentence of a page's body with more of it to come.
LOOSE = 0.45
#: Least number of pages of an equivalence class of several forms.
REPEATS = 3
#: Greatest expected number of pairs of forms that share an occurrence vector by chance.
CHANCE = 0.05

_SCHEMA = "page_id long, domain string, page long, line_no long, form long, shape long, head long, sentence boolean, kept boolean, crumbs array<long>"


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode()) - 2**63


def line_form(line: str, host: str) -> tuple[str, str]:
    """A line with numbers and the words of the host's own name masked; and with names inside it masked too."""
    words = re.sub(r"\d+(?:[.,:/-]\d+)*", "#", line).split()
    for i, w in enumerate(words):
        letters = re.sub("[^a-z]", "", w.lower())
        if len(letters) >= 4 and letters in host:
            words[i] = re.sub("[A-Za-z]+", "~", w)
    form = " ".join(words).replace("~ ~", "~")
    shape = form if form.isupper() else " ".join(re.sub(r"^[^\W\d_]+", "X", w) if i and w[0].isupper() else w for i, w in enumerate(form.split()))
    return form.lower(), shape.replace("X X", "X").lower()


def _line_rows(phrases: list[str]):
    wanted = [re.sub(r"\d+(?:[.,:/-]\d+)*", "#", p).lower() for p in phrases]

    def run(batches):
        for pdf in batches:
            out = []
            for page_id, domain, page, text in zip(pdf["page_id"], pdf["domain"], pdf["page"], pdf["text"]):
                host = re.sub("[^a-z]", "", (domain or "").lower())
                for no, line in enumerate(text.split("\n"), 1):
                    if not line.strip():
                        continue
                    form, shape = line_form(line, host)
                    head = re.sub(r"^#+\s*", "", line.strip()).lower()
                    sentence = bool(re.search(r"[.!?。][\"'»”)]?$", line.strip())) and (len(line.split()) >= 5 or bool(re.search(r"[぀-ヿ一-鿿]{8}", line)))
                    plain = re.sub(r"^[*-]\s+", "", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", line.strip())).lower()
                    parts = [p.strip() for p in re.split(r"\s+(?:/|»|>|›|\||·|-|–|,)\s+", plain)]
                    links = re.findall(r"\[([^\]]+)\]\([^)]*\)", line.lower())
                    crumbs = [_hash(p) for p in (parts if len(parts) > 1 else links or parts) if p] if not sentence else []
                    out.append((page_id, domain, page, no, _hash(form), _hash(shape), _hash(head), sentence, any(p in form for p in wanted if p), crumbs))
            yield pd.DataFrame(out, columns=["page_id", "domain", "page", "line_no", "form", "shape", "head", "sentence", "kept", "crumbs"])

    return run


def template_classes(lines: DataFrame) -> DataFrame:
    """domain, form: the members of each host's valid equivalence classes of two or more forms.

    lines: page_id, domain, page, line_no, form. Forms share a class where they are found equally often on exactly the same pages
    (kept as count and sum of hashes, so a host may have any number of pages). A class is valid where it is on REPEATS pages
    or more, too many for chance (CHANCE), its members come in the same order on each page, and it nests: all of it lies
    in one slot between the members of the host's widest class, the same one on each page. One reading of each page counts.
    """
    once = lines.join(lines.groupBy("domain", "page").agg(F.min("page_id").alias("page_id")), ["domain", "page", "page_id"], "left_semi")
    places = keep(once.groupBy("domain", "page", "form").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("times")))
    tokens = places.groupBy("domain", "form").agg(F.count("*").alias("s"), F.sum((F.xxhash64("page", "times") / 2**20).cast("long")).alias("vector"))
    classes = tokens.groupBy("domain", "vector", "s").agg(F.count("*").alias("size"))
    widest = classes.groupBy("domain").agg(F.max(F.struct("s", "size", "vector")).alias("w"))
    # m forms on s of n pages give m (m - 1) / 2 pairs, each alike by chance once in (n over s) >= (n / s)^s
    rivals = tokens.groupBy("domain", "s").agg(F.count("*").alias("m")).join(places.groupBy("domain").agg(F.countDistinct("page").alias("n")), "domain")
    chance = F.col("m") * (F.col("m") - 1) / 2 * F.exp(F.col("s") * F.log(F.col("s") / F.col("n")))
    asked = classes.join(rivals, ["domain", "s"]).join(widest, "domain").withColumn("root", (F.col("vector") == F.col("w.vector")) & (F.col("s") == F.col("w.s")))
    asked = asked.filter((F.col("size") > 1) & (F.col("s") >= REPEATS) & (F.col("root") | (chance <= CHANCE))).select("domain", "vector", "s", "root")
    # as long as one page: the places of the widest class, and the members of each class in order
    frame = places.join(tokens.join(widest, "domain").filter("vector = w.vector and s = w.s").select("domain", "form"), ["domain", "form"])
    frame = frame.groupBy("domain", "page").agg(F.collect_list("first").alias("frame"))
    member = places.join(tokens, ["domain", "form"]).join(asked, ["domain", "vector", "s"])
    runs = member.groupBy("domain", "vector", "s", "root", "page").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("first", "form"))), lambda x: x.form)).alias("order"))
    runs = runs.join(frame, ["domain", "page"], "left")
    before = lambda at: F.size(F.filter("frame", lambda x: x < F.col(at)))
    slot, end = before("first"), before("last")
    runs = runs.groupBy("domain", "vector", "s", "root").agg(F.countDistinct("order").alias("orders"), F.countDistinct(F.when(F.col("frame").isNotNull(), slot)).alias("slots"), F.max(F.coalesce(slot != end, F.lit(False))).alias("split"))
    nested = runs.filter((F.col("orders") == 1) & (F.col("root") | (F.col("slots") <= 1) & ~F.col("split"))).select("domain", "vector", "s")
    return tokens.join(nested, ["domain", "vector", "s"], "left_semi").select("domain", "form")


def main_lines(pages: DataFrame, phrases: list[str] = []) -> DataFrame:
    """page_id, line_no, main: each line of text that isn't blank, and whether it is the page's own content.

    Lines become tokens: forms with numbers and the host's name masked. (1) For each host, forms found equally often on exactly
    the same pages (equal occurrence vectors) make an equivalence class; those of several forms are valid by order and nesting,
    whatever part of the pages they are on (see template_classes). A form on at least SUPPORT of the pages of the host's
    widest class is of the template too, be it alone in its class. Where hosts share a form, their votes are summed. (2) The slots that remain are
    searched for lines that fill slots of many templates alike: forms short of a sentence, shared by HOSTS hosts, that
    are no headings (some page's title), and of whose occurrences on all pages LOOSE and more lie outside the body's slot or
    beside its text: before or after the sentences that no template has, or not straight after one. A page's short facts and list items
    stand within its body, menus and side boxes anywhere. (3) Paths, all of whose steps but the last are
    entries of templates' menus, go too. The rest is main. phrases: content known to the caller, kept whatever its form; the queries name none.
    Repeated readings of a page (equal host and address, or equal host and text) vote once. Pages of null id or text give
    nothing; a null host counts as one host.
    """
    ids = pages.filter("page_id is not null and text is not null").select("page_id", F.coalesce("domain", F.lit("")).alias("domain"), F.xxhash64("url").alias("u"), F.xxhash64("text").alias("t"), "title", "text")
    same = ids.groupBy("domain", "t").agg(F.min("u").alias("page"))
    lines = keep(ids.join(same, ["domain", "t"]).select("page_id", "domain", "page", "text").mapInPandas(_line_rows(phrases), _SCHEMA))
    # headings: titles without the site's name
    titles = ids.select("domain", F.explode(F.split(F.lower("title"), r"\s+[-|–]\s+")).alias("x"))
    titles = titles.filter("x <> ''").groupBy("x").agg(F.countDistinct("domain").alias("hosts")).filter(F.col("hosts") >= HOSTS)
    heads = keep(titles.mapInPandas(_title_hash, "head long"))
    seen = lines.select("domain", "page", "form", "shape", "head", "sentence", "kept").distinct()
    body = seen.filter("not kept").join(heads, "head", "left_anti")
    per_host = keep(body.groupBy("domain", "form", "shape", "sentence").agg(F.countDistinct("page").alias("s"), F.sum((F.xxhash64("page") / 2**20).cast("long")).alias("vector")))
    root = per_host.groupBy("domain").agg(F.max("s").alias("n"))
    pages_n = lines.groupBy("domain").agg(F.countDistinct("page").alias("pages"))
    root = root.join(pages_n, "domain").select("domain", F.greatest("n", F.ceil(F.col("pages") / 2)).alias("n"))
    votes = per_host.join(root, "domain")
    valid = votes.groupBy("form").agg((F.sum("s") / F.sum("n")).alias("share"), F.sum("s").alias("s")).filter((F.col("share") >= SUPPORT) & (F.col("s") >= 2)).select("form")
    own = votes.filter(~F.col("sentence") & (F.col("s") >= 3) & (F.col("s") / F.col("n") >= 0.5)).select("domain", "form")
    own = own.union(template_classes(lines.filter("not kept").join(heads, "head", "left_anti"))).distinct()
    valid, own = keep(valid), keep(own)
    marked = lines.join(heads.withColumn("_h", F.lit(True)), "head", "left").join(valid.withColumn("_v", F.lit(True)), "form", "left").join(own.withColumn("_o", F.lit(True)), ["domain", "form"], "left")
    marked = marked.withColumn("free", ~F.col("kept") & F.col("_h").isNull()).withColumn("fixed", F.col("free") & (F.col("_v").isNotNull() | F.col("_o").isNotNull()))
    body = F.when(F.col("sentence") & ~F.col("fixed"), F.col("line_no"))
    page = Window.partitionBy("page_id")  # as long as one page
    inside = (F.max(body).over(page) > F.col("line_no")) & F.lag(body).over(page.orderBy("line_no")).isNotNull()
    marked = keep(marked.select("page_id", "domain", "line_no", "shape", "sentence", "crumbs", "free", "fixed", (F.col("free") & F.col("_v").isNotNull()).alias("voted"), (F.col("fixed") | ~F.coalesce(inside, F.lit(False))).alias("loose")))
    shared = marked.filter("free and not sentence").groupBy("shape").agg(F.countDistinct("domain").alias("hosts"), F.avg(F.col("loose").cast("int")).alias("part"))
    shared = shared.filter(F.col("hosts") >= HOSTS).select("shape", (F.col("part") >= LOOSE).alias("_s"))
    flagged = marked.filter("free").join(shared, "shape", "left")
    # what stands within the body on all hosts' pages is no template of the one host that repeats it
    template = F.col("voted") | F.when(F.col("sentence"), F.col("fixed")).otherwise(F.coalesce("_s", "fixed"))
    flagged = keep(flagged.select("page_id", "domain", "line_no", "crumbs", template.alias("template")))
    menu = flagged.filter("template").select("domain", F.explode("crumbs").alias("crumb")).groupBy("crumb").agg(F.countDistinct("domain").alias("hosts")).filter(F.col("hosts") >= HOSTS).select("crumb")
    paths = flagged.filter(~F.col("template") & (F.size("crumbs") > 1)).select("page_id", "line_no", F.explode(F.slice("crumbs", F.lit(1), F.size("crumbs") - 1)).alias("crumb"))
    paths = paths.join(menu.withColumn("_m", F.lit(1)), "crumb", "left").groupBy("page_id", "line_no").agg(F.count("*").alias("all"), F.count("_m").alias("known")).filter("all = known")
    bad = flagged.filter("template").select("page_id", "line_no").union(paths.select("page_id", "line_no")).distinct().withColumn("_b", F.lit(True))
    return lines.join(bad, ["page_id", "line_no"], "left").select("page_id", "domain", "line_no", F.col("_b").isNull().alias("main"))


def _title_hash(batches):
    for pdf in batches:
        yield pd.DataFrame({"head": pd.Series([_hash(x) for x in pdf["x"]], dtype="int64")})


def p4_found(spark, d):
    """Lines of read_pages.text that aren't main content; pages that are residue are left out."""
    pages = table(spark, d, "read_pages")
    lines = main_lines(pages)
    residue = page_residue(pages).select(F.col("rec_id").alias("page_id"))
    return lines.filter("not main").join(residue, "page_id", "left_anti").select("page_id", "line_no")


class _Blocks(HTMLParser):
    """Lines of a page's blocks, links in Markdown; which of them lie in closed menus, side boxes and buttons."""

    INLINE = frozenset("a abbr b bdi cite code em font i kbd mark q s small span strong sub sup time u wbr img".split())
    CHROME = frozenset("nav aside footer button form".split())
    SKIP = frozenset("script style template head".split())

    def __init__(self, html: str):
        super().__init__()
        count = lambda tag: (len(re.findall(rf"<{tag}\b", html, re.I)), len(re.findall(rf"</{tag}\b", html, re.I)))
        self.closed = {t for t in self.CHROME | self.SKIP if count(t)[0] <= count(t)[1]}  # one left open would take in the rest
        self.lines, self.text, self.open, self.href = [], [], [], None
        self.feed(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html))
        self.close()
        self._end()

    def _end(self):
        if line := " ".join("".join(self.text).split()):
            self.lines.append((line, any(t in self.CHROME for t in self.open)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href = dict(attrs).get("href")
            self.text.append("[" if self.href else "")
        elif tag not in self.INLINE:
            self._end()
            self.text.append("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "* " if tag == "li" else "")
            if tag in self.closed:
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag == "a" and self.href:
            self.text.append(f"]({self.href})")
            self.href = None
        elif tag not in self.INLINE:
            self._end()
            if tag in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        if not any(t in self.SKIP for t in self.open):
            self.text.append(data.replace("\n", " "))


def html_lines(html: str) -> list[tuple[str, bool]]:
    """Each line of text of an HTML page, and whether its tags alone tell that it isn't main text."""
    return [(line, chrome) for line, chrome in _Blocks(html).lines if re.search(r"\w", line)]


def _read(batches):
    for pdf in batches:
        out = []
        for id_, url, html in zip(pdf["id"], pdf["url"], pdf["html"]):
            lines = html_lines(html)
            host = re.sub(r"^\w+://|[/:?#].*$", "", url or "")
            out.append((id_, url, host, "\n".join(x for x, _ in lines), [i for i, (_, chrome) in enumerate(lines, 1) if chrome]))
        yield pd.DataFrame(out, columns=["id", "url", "domain", "text", "chrome"])


def _main_text(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """texts with main_text: their lines that are main, in order."""
    numbers = lines.groupBy("page_id").agg(F.array_sort(F.collect_list("line_no")).alias("nos"))  # as long as one text
    text = F.array_join(F.transform("nos", lambda n: F.element_at(F.split("text", "\n"), n.cast("int"))), "\n")
    return texts.join(numbers, "page_id").withColumn("main_text", text)


def fixture_text(pages: DataFrame, fixtures: DataFrame) -> DataFrame:
    """id, main_text of fixtures (id, url, html), whose lines are judged together with those of pages."""
    read = fixtures.filter("id is not null and html is not null").select("id", "url", "html")
    read = keep(read.mapInPandas(_read, "id string, url string, domain string, text string, chrome array<int>").withColumn("page_id", F.xxhash64("id")).withColumn("title", F.lit(None).cast("string")))
    names = ["page_id", "domain", "url", "title", "text"]
    lines = main_lines(pages.select(*names).union(read.select(*names))).filter("main").select("page_id", "line_no")
    lines = lines.join(read.select("page_id", "chrome"), "page_id").filter("not array_contains(chrome, cast(line_no as int))")
    return _main_text(read, lines).select("id", "main_text")


def p4_main_text(spark, d):
    """The main text of each page (page_id) and of each HTML fixture (fixture_id)."""
    pages = table(spark, d, "read_pages")
    read = _main_text(pages, main_lines(pages).filter("main").select("page_id", "line_no")).select("page_id", F.lit(None).cast("string").alias("fixture_id"), "main_text")
    fixtures = fixture_text(pages, table(spark, d, "boilerplate_fixtures"))
    return read.union(fixtures.select(F.lit(None).cast("long"), "id", "main_text"))


def p4_fixtures(spark, d):
    """Of each HTML fixture: phrases that its main text must hold and those held, phrases that it must not hold and those gone."""
    fixtures = table(spark, d, "boilerplate_fixtures")
    text = fixture_text(table(spark, d, "read_pages"), fixtures)
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("main_text", F.lit("")), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\s+", " "))
    rows = fixtures.filter("id is not null").select("id", "must_keep", "must_drop").join(text, "id", "left").withColumn("plain", plain)
    held = lambda c: F.size(F.filter(c, lambda p: F.contains("plain", F.lower(p))))
    return rows.select("id", F.size("must_keep").alias("keep"), held("must_keep").alias("kept"), F.size("must_drop").alias("drop"), (F.size("must_drop") - held("must_drop")).alias("dropped"))


QUERIES = {"p4_found": p4_found, "p4_main_text": p4_main_text, "p4_fixtures": p4_fixtures}
SQL: dict[str, str] = {}
