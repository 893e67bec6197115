"""Template residue, filler text, error messages and script notices in place of content."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webloom.plans.lineage import keep
from webloom.sources.tables import table

#: Least number of sources (hosts) of a widely recurring message.
WIDE = 3

# Forms of an unfilled placeholder.
_ID = r"[\p{L}_][\p{L}\d_.]*"
PLACEHOLDER = "|".join([
    r"\{\{\s*" + _ID + r"\s*\}\}", r"\{%\s*" + _ID + r"\s*%\}", r"<%=?\s*" + _ID + r"\s*%>", r"[$#]\{\s*" + _ID + r"\s*\}", r"\{\$?" + _ID + r"\}", r"\[\[\s*" + _ID + r"\s*\]\]",
    r"%%" + _ID + r"%%", r"@@" + _ID + r"@@", r"\b__\p{L}[\p{L}\d_.]*?__(?![\p{L}\d])", r"%" + _ID + r"%", r"&lt;" + _ID + r"&gt;", r"<(?![bi]>|/|p>|br>|em>|hr>|li>|ul>|ol>)" + _ID + r">", r"\[" + _ID + r"\](?!\()",
])

# Words of a text about placeholders rather than with one.
MENTION = r"templates?|placeholders?|platzhaltern?|brackets?|braces|syntax|marcadores?|plantillas?|gabarits?|crochets|accolades|segnaposto|parentesi|symbole zastępcze|шаблон\w*|プレースホルダ"

# Phrases of messages that stand where content should.
_SCRIPT = r"(?:java ?)?script(?:s|ing)?|skript\w*|skrypt\w*|скрипт\w*|スクリプト"
PHRASES = [
    rf"(?:(?:please|bitte|you must|you need to|necesita|veuillez|por favor|proszę) )?(?:enable|activate|turn on|switch on|allow|activar|activez|activer|active|aktivieren sie|aktiviere|attivare|attiva|ative|włącz|schakel|включите)\b[^.;:!?|]{{0,30}}?(?:{_SCRIPT})(?: in your browser(?: settings)?|,? um diese seite zu nutzen| en su navegador| (?:na|dans|nel|w) \w+ \w+)?",
    rf"(?:{_SCRIPT}|cookies)[^.;:!?|]{{0,12}} ?(?:is|are|ist|sind|est|está|wurde) (?:turned off|switched off|disabled|blocked|required|needed|ausgeschaltet|deaktiviert|désactivé\w*|desactivad\w*)(?: in your browser)?",
    rf"this (?:app|application|site|page|shop|website) (?:relies on|requires|needs|only works with) (?:{_SCRIPT})(?: switched on| to run)?", r"your browser has it switched off", rf"(?:voor deze \w+ )?moet (?:{_SCRIPT}) aanstaan", r"loading[.…]*", r"if nothing happens", rf"cette page ne s'affiche qu'avec (?:{_SCRIPT})", r"noscript",
    r"checking your browser(?: before you continue)?", r"this needs cookies and scripts", r"just a moment(?: while we verify you are human)?", r"verify (?:that )?you are human", r"nothing can be shown (?:without it|until they are allowed)", r"the content is loaded by a script",
    r"(?:http |error |erreur |fehler )*# (?:-|–|:|\||not found|forbidden|unauthorized|bad gateway|server error|service unavailable)", r"(?:http|error|erreur|fehler|código|code) +#", r"#? ?(?:page |seite )?not +found", r"forbidden", r"unauthori[sz]ed", r"bad gateway", r"(?:#|http #)? ?gateway problem", r"upstream \S+ did not answer", r"upstream did not reply within # seconds", r"(?:internal )?server +error", r"(?:the )?service (?:is )?(?:not available right now|(?:temporarily )?unavailable)",
    r"access (?:to this resource is )?denied", r"zugriff (?:nicht erlaubt|verweigert)", r"accès (?:refusé|interdit)", r"acceso denegado", r"(?:diese )?seite (?:fehlt|nicht gefunden|existiert leider nicht mehr)", r"page (?:absente|introuvable|missing|does not exist)", r"p[áa]gina no encontrada", r"página não encontrada", r"pagina non trovata", r"pagina niet gevonden", r"nie znaleziono strony", r"strona nie istnieje", r"страница не найдена", r"ページが見つかりません", r"contenido no disponible", r"errore interno del server", r"ошибка +сервера", r"erreur (?:interne )?du serveur", r"interner serverfehler", r"nothing here", r"gone", r"(?:connection|request)(?: to \S+)? timed out(?: after # \w+)?", r"(?:the )?(?:page|file) or directory you are after is gone", r"the file or directory you are after is gone",
    r"the requested (?:address|url|page)(?: \S+)? was not found(?: on this server)?", r"(?:oops|sorry)[!,. ]+", r"something went wrong(?: on our side)?", r"\(?code #\)?", r"domain \S+ has expired(?: and is awaiting renewal)?", r"this account has been suspended", r"contact your hosting company", r"your session has timed out", r"sign in again", r"too many requests(?:, slow down and retry in # seconds)?", r"request blocked", r"reference number [#.]+", r"error establishing a connection to the data(?: ?store|base)", r"sqlstate\[[^\]]*\]", r"no such table(?:: ?\S+)?", r"traceback(?:: key \S+ missing while rendering view #)?", r"(?:php )?(?:fatal error|warning|notice): (?:undefined|uncaught|call to)[^|]*?(?: on line #|$)", r"fatal error(?:[:,] [^|.]*)?", r"index of /\S*", r"we'll be back soon", r"(?:maintenance in progress|under maintenance|under construction|coming soon)",
    r"lorem|ipsum|dolor|sit amet|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|enim|minim|veniam|quis|nostrud|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|velit|esse|cillum|fugiat|nulla|pariatur|sint|dolore",
    r"hier steht ein blindtext(?: als platzhalter)?", r"(?:sample|example|dummy|filler|placeholder) text", r"replace this with your own words", r"texte à remplacer", r"texto de ejemplo", r"testo segnaposto", r"text(?: text){2,}", r"test(?: test)+(?: #)?", r"(?:asdf|qwer|asdf qwer)(?: (?:asdf|qwer))*", r"x{3,}(?: x{2,})*", r"untitled(?: document| page)?", r"undefined", r"null", r"nan", r"\[object object\]", r"heading #", r"new page(?: \(#\))?", r"company name", r"slogan", r"votre slogan ici", r"ihr firmenname", r"tu título aquí", r"escriba aquí una descripción", r"(?:add )?your (?:title|tagline|slogan|text|company name|description)(?: goes)? here", r"add your (?:title|text|tagline|description) here", r"insert (?:company )?(?:description|title|text|name) here", r"enter a (?:short )?(?:summary|description|title)(?: of this page)?", r"description of the page", r"\(?max\.? # characters\)?", r"write something about us", r"welcome to your new (?:website|site|blog)", r"click edit to change this text", r"just another (?:site|blog)(?: made with the builder)?", r"default web page of the server", r"it is working", r"it works!?",
]

# What may accompany such a message, saying nothing by itself.
TAILS = [
    r"welcome to", r"(?:to|and) (?:continue|reload(?: the page)?|use ~?|see this page)", r"so that we can check your browser", r"to use", r"for ~", r"para continuar", r"pour continuer", r"um fortzufahren", r"per continuare", r"om verder te gaan", r"aby kontynuować", r"чтобы продолжить", r"and reload(?: the page)?", r"request id \S+", r"reference [#~]", r"\(?nginx-like server\)?", r"go back to the start page", r"if this keeps happening, write to the administrator", r"try again in a few minutes", r"the address may be mistyped or the page has moved", r"https?", r"~",
]

# Words of notices and legal lines, which are no content of a page.
LEGAL = r"cookies?|©|copyright|all rights|prices include tax|inkl\. mwst|plus shipping|and (?:our|its)(?: #)? partners|identifiers?|einwilligung|zustimmung|consent\w*|consentement|privacy|datenschutz\w*|privacidad|small files|your choices|measure visits|store\w* .*computer"


def _words(text: Column) -> Column:
    """Number of words; a run of ideographs or kana counts as its length over 2."""
    kana = F.length(F.regexp_replace(text, r"[^぀-ヿ一-鿿]", "")) / 2
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}&&[^぀-ヿ一-鿿]]{2,}")) + F.ceil(kana)


# Literals of which every placeholder, and one of which every phrase above that BARE doesn't find, holds at least one.
LITERALS = """{ [ < % __ @@ lt; gone timed script skript skrypt скрипт スクリプト browser cookies human without until loading nothing error http fehler erreur código code not&found forbidden unauthori gateway upstream server service available denied
zugriff accès acceso seite page página pagina strony strona страница ページ contenido errore ошибка file directory requested oops sorry wrong expired suspended hosting session sign&in many&requests blocked reference connection sqlstate no&such
traceback fatal warning notice index&of back&soon maintenance construction coming&soon lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore magna aliqua enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure velit esse cillum fugiat nulla pariatur sint
text test moment replace asdf qwer xxx untitled undefined null nan object heading new&page company slogan firmenname título titulo descripción descripcion your&title your&tagline your&text your&description insert enter description characters something new&website new&site new&blog edit another default working works""".split()


# What phrases without a literal hold: a status code before a dash, colon or bar; short words of filler.
BARE = re.compile(r"\d\s+[-–:|]|(?<![^\W_])(?:sed|esse)(?![^\W_])")


# What messages of systems rather than of sites speak of: for forms that recur in WIDE sources, where half a form's words are enough.
CUES = """access account address admin administrator administration anmelden application back browser cache code connection connexion content cookies database denied device disabled down empty enable error erreur errore exception expired failed failure fehler file gone host invalid javascript load loading login maintenance missing mode moved not null offline out page página pagina password please plugin redirect redirected redirecting refresh reload request resource response retry script scripts seite server service session site strona suspended system template temporarily test timed timeout try unable unavailable unsupported update upgrade url user verify version wait website страница ошибка сервер""".split()


def literals():
    """An automaton that finds LITERALS."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for w in LITERALS:
        words.add_word(w.replace("&", " "), True)
    words.make_automaton()
    return words


def may_match(text: str, words) -> bool:
    """Whether a text may hold a placeholder or a phrase. words: the automaton of literals."""
    plain = " ".join(text.lower().split())
    return next(words.iter(plain), None) is not None or BARE.search(plain) is not None


def masked(text: str, source: str) -> str:
    """Normal form of a message: lower case, placeholders, addresses, dates and numbers masked, words of the host's own name as ~."""
    t = _PLACEHOLDER.sub(" ¤ ", text.replace("’", "'").replace("\xa0", " ")).lower()
    t = re.sub(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+", "@", t)
    t = re.sub(r"\d+(?:[./:-]\d+)*", "#", t)
    words = t.split()
    for i, w in enumerate(words):
        letters = re.sub("[^a-z]", "", w)
        if len(letters) >= 4 and letters in source:
            words[i] = re.sub("[a-z]+", "~", w)
    return " ".join(words).replace("~ ~", "~")


_PLACEHOLDER = re.compile(PLACEHOLDER.replace(r"\p{L}\d_.", r"\w.").replace(r"[\p{L}_]", r"[^\W\d]").replace(r"\p{L}", r"[^\W\d_]").replace(r"[[^\W\d_]\d]", r"[^\W_]"))


@F.pandas_udf(StringType())
def _masked(texts: pd.Series, sources: pd.Series) -> pd.Series:
    """The masked form of a text that may match, else null."""
    words = literals()
    out = []
    for text, source in zip(texts, sources):
        hint = isinstance(text, str) and may_match(text, words)
        out.append(masked(text, re.sub("[^a-z]", "", (source or "").lower())) if hint else None)
    return pd.Series(out, dtype=object)


def _plain_form(text: Column) -> Column:
    """Lower case, with addresses, dates and numbers masked."""
    plain = F.regexp_replace(F.lower(F.translate(text, "’\xa0", "' ")), r"(?:https?://|www\.)\S+|\S+@\S+\.\S+", "@")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\d+(?:[./:-]\d+)*", "#"), r"\s+", " "))


def recurring(units: DataFrame, text: str, source: str) -> DataFrame:
    """The units whose masked form recurs in at least WIDE sources that it doesn't name, and holds CUES in half of its words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 2)
    cues = F.size(F.filter("w", lambda w: w.isin(*CUES)))
    rows = units.withColumn("w", words).filter((cues > 0) & (2 * cues >= F.size("w")))
    host = F.regexp_replace(F.lower(F.coalesce(F.col(source), F.lit(""))), "[^a-z]", "")
    rows = keep(rows.withColumn("named", F.exists("w", lambda w: (F.length(w) >= 4) & F.contains(host, w))).withColumn("f", _plain_form(F.col(text))))
    wide = rows.filter("not named").groupBy("f").agg(F.countDistinct(source).alias("n")).filter(F.col("n") >= WIDE).select("f")
    return rows.join(wide, "f", "left_semi").select(units.columns)


def messages(units: DataFrame, text: str, source: str, whole: bool = False) -> DataFrame:
    """The units that are open (hold an unfilled placeholder) or residue (are a message, not content), with these two columns.

    Units are masked and grouped by the exact hash of the masked form over all sources. A form is residue where
    known phrases, filler words and placeholders make up nearly all of it, or half of it if the form recurs
    in at least WIDE sources; if units are whole fields, also where it recurs so widely and speaks mostly of systems (see
    recurring), in whatever wording. A placeholder in a text that speaks of placeholders isn't unfilled. A null or blank text is
    neither. No unit is skipped: those without any of LITERALS and BARE can match no phrase.
    """
    t = F.col(text)
    edge = lambda p: rf"(?<![\p{{L}}\d])(?:{p})(?![\p{{L}}\d])"
    out = units.withColumn("_form", _masked(t, F.col(source))).filter("_form is not null")
    out = out.withColumn("open", F.regexp_like(t, F.lit(PLACEHOLDER)) & ~F.regexp_like(F.lower(t), F.lit(edge(MENTION))))
    out = out.withColumn("_cut", F.regexp_replace("_form", "|".join([edge("|".join(PHRASES)), "¤"]), " ‡ "))
    out = keep(out.filter(F.contains("_cut", F.lit("‡"))).withColumn("_hash", F.xxhash64("_form")))
    forms = out.groupBy("_hash").agg(F.first("_form").alias("f"), F.first("_cut").alias("c"), F.countDistinct(source).alias("sources"))
    rest = _words(F.regexp_replace("c", edge("|".join(TAILS)), " "))
    share = rest / F.greatest(_words(F.col("f")), F.lit(1))
    bad = (rest <= 1) | (share <= 0.2) | ((F.col("sources") >= WIDE) & (share <= 0.5))
    flagged = forms.filter(bad).select("_hash", F.lit(True).alias("_bad"))
    joined = out.join(flagged, "_hash", "left")
    found = joined.select(*units.columns, "open", F.coalesce("_bad", F.lit(False)).alias("residue")).filter("open or residue")
    if not whole:
        return found
    more = recurring(units, text, source).select(*units.columns, F.lit(False).alias("open"), F.lit(True).alias("residue"))
    return found.union(more).groupBy(*units.columns).agg(F.bool_or("open").alias("open"), F.bool_or("residue").alias("residue"))


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, domain, url, line_no, line: the lines of each text that aren't blank, counted from 1."""
    cut = pages.filter("page_id is not null and text is not null").select("page_id", "domain", "url", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return cut.filter(F.regexp_like("line", F.lit(r"\S"))).select("page_id", "domain", "url", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def homepage_residue(meta: DataFrame) -> DataFrame:
    """src, rec_id, field of the affected titles and descriptions; each field is one message. Rows of a null meta_id are left out."""
    field = lambda name: F.struct(F.lit(name).alias("field"), F.col(name).alias("text"))
    units = meta.filter("meta_id is not null").select("meta_id", "domain", F.explode(F.array(field("title"), field("description"))).alias("x")).select("meta_id", "domain", "x.field", "x.text")
    return messages(units, "text", "domain", whole=True).select(F.lit("homepage_meta").alias("src"), F.col("meta_id").alias("rec_id"), "field").distinct()


def page_residue(pages: DataFrame) -> DataFrame:
    """src, rec_id, field of the affected pages: one with an unfilled placeholder, or with messages and no content beside them.

    Content is a sentence that isn't a message, a legal notice or a line that the host repeats on other addresses.
    """
    lines = page_lines(pages)
    bad = keep(messages(lines, "line", "domain").select("page_id", "domain", "line_no", "open"))
    opened = bad.filter("open").select("page_id").distinct()
    asked = bad.select("page_id", "domain").distinct().join(opened, "page_id", "left_anti")
    inside = page_lines(pages.join(asked.select("domain").distinct(), "domain", "left_semi"))
    inside = inside.filter(F.regexp_like("line", F.lit(r"[.!?。]['\"»”)]?\s*$"))).filter((_words(F.col("line")) >= 5) & ~F.regexp_like(F.lower("line"), F.lit(rf"(?<![\p{{L}}\d])(?:{LEGAL})(?![\p{{L}}\d])")))
    sentences = inside.join(bad.select("page_id", "line_no"), ["page_id", "line_no"], "left_anti").select("page_id", "domain", "url", F.xxhash64(F.trim(F.regexp_replace("line", r"\d+", "#"))).alias("form"))
    repeated = sentences.groupBy("domain", "form").agg(F.countDistinct("url").alias("n")).filter("n > 1").select("domain", "form")
    content = sentences.join(asked.select("page_id"), "page_id", "left_semi").join(repeated, ["domain", "form"], "left_anti").select("page_id").distinct()
    found = opened.union(asked.select("page_id").join(content, "page_id", "left_anti")).distinct()
    return found.select(F.lit("read_pages").alias("src"), F.col("page_id").alias("rec_id"), F.lit("text").alias("field"))


def p3_found(spark, d):
    """Fields of homepage_meta and read_pages that are residue or hold unfilled placeholders."""
    return homepage_residue(table(spark, d, "homepage_meta")).union(page_residue(table(spark, d, "read_pages")))


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
