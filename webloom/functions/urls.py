"""Web addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track visits, and public suffixes of two labels in the crawled data.
TRACKING = r"utm_[^=&]*|fbclid|gclid|dclid|gbraid|wbraid|msclkid|mc_cid|mc_eid|yclid|igshid|ref_src"
SUFFIXES = ("co.example", "org.example", "net.example", "co.uk", "com.au", "co.jp")


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a leading www.; null where there is none."""
    raw = F.lower(F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(raw != "", F.regexp_replace(raw, r"^www\.", ""))


def registrable_domain(host_name: Column) -> Column:
    """The last two labels, or three under a suffix of two labels; null for null or a single label."""
    two, three = F.substring_index(host_name, ".", -2), F.substring_index(host_name, ".", -3)
    return F.when(F.contains(host_name, F.lit(".")), F.when(two.isin(*SUFFIXES), three).otherwise(two))


def path(url: Column) -> Column:
    """Path without a closing slash (the root keeps it)."""
    p = F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    bare = F.regexp_replace(p, r"/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


# Characters whose percent form stands for themselves.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def _regular_percent(text: Column) -> Column:
    """Percent forms of unreserved characters as these characters, others in capitals."""
    parts = F.split(text, "%")
    code = lambda x: F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
    good = lambda x: F.regexp_like(x, F.lit("^[0-9A-Fa-f]{2}"))
    plain = lambda x: F.when(F.contains(F.lit(UNRESERVED), F.char(code(x))), F.char(code(x))).otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2))))
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.when(good(x), F.concat(plain(x), x.substr(F.lit(3), F.length(x)))).otherwise(F.concat(F.lit("%"), x)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def _flat_path(p: Column) -> Column:
    """A path without dot segments; / for the empty one."""
    steps = F.split(p, "/")
    last = F.element_at(steps, -1).isin(".", "..")
    none = F.array().cast("array<string>")
    walk = F.aggregate(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))), none, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    flat = F.concat(F.lit("/"), F.array_join(walk, "/"))
    return F.when(last & (flat != "/"), F.concat(flat, F.lit("/"))).otherwise(flat)


def _parts(url: Column) -> dict[str, Column]:
    u = F.trim(url)
    of = lambda n: F.regexp_extract(u, r"(?i)^(https?)://([^/?#@:\s]+)(?::([0-9]*))?((?:/[^?#]*)?)(\?[^#]*)?(?:#.*)?$", n)
    scheme, port = F.lower(of(1)), of(3)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    query = _regular_percent(of(5).substr(F.lit(2), F.length(u)))
    return {"scheme": scheme, "host": F.lower(of(2)), "port": F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), "path": _flat_path(_regular_percent(of(4))), "query": query}


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no usual port, fragment, empty query or dot segments, regular percent forms; null for other
    schemes, without a host or with user info. Hosts are not turned into Punycode."""
    p = _parts(url)
    return F.when(p["host"] != "", F.concat(p["scheme"], F.lit("://"), p["host"], p["port"], p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")))


def match_key(url: Column) -> Column:
    """What two spellings of one address share: host without www., an unusual port, path without closing slash, sorted parameters without tracking."""
    p = _parts(url)
    kept = F.array_sort(F.filter(F.split(p["query"], "&"), lambda x: (x != "") & ~F.regexp_like(x, F.lit(rf"^(?:{TRACKING})(?:=|$)"))))
    short = F.when(p["path"] == "/", "/").otherwise(F.regexp_replace(p["path"], "/$", ""))
    params = F.array_join(kept, "&")
    return F.when(p["host"] != "", F.concat(F.regexp_replace(p["host"], r"^www\.", ""), p["port"], short, F.when(params != "", F.concat(F.lit("?"), params)).otherwise("")))


def host_sql(url: str) -> str:
    raw = f"lower(regexp_extract(trim({url}), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
    return f"(CASE WHEN {raw} <> '' THEN regexp_replace({raw}, '^www\\.', '') END)"


def domain_sql(host_name: str) -> str:
    parts = f"string_split({host_name}, '.')"
    suffixes = ", ".join(f"'{s}'" for s in SUFFIXES)
    two, three = f"array_to_string({parts}[-2:], '.')", f"array_to_string({parts}[-3:], '.')"
    return f"(CASE WHEN contains({host_name}, '.') THEN CASE WHEN {two} IN ({suffixes}) THEN {three} ELSE {two} END END)"


def path_sql(url: str) -> str:
    bare = f"regexp_replace(regexp_extract(trim({url}), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return f"(CASE WHEN {bare} = '' THEN '/' ELSE {bare} END)"


def _parts_sql(url: str) -> dict[str, str]:
    of = lambda n: f"regexp_extract(trim({url}), '(?i)^(https?)://([^/?#@:\\s]+)(?::([0-9]*))?((?:/[^?#]*)?)(\\?[^#]*)?(?:#.*)?$', {n})"
    percent = lambda t: f"list_reduce(list_prepend('', string_split({t}, '%')), lambda a, x, i: CASE WHEN i = 2 THEN x WHEN regexp_matches(x, '^[0-9A-Fa-f]{{2}}') THEN a || CASE WHEN contains('{UNRESERVED}', chr(('0x' || x[1:2])::INT)) THEN chr(('0x' || x[1:2])::INT) ELSE '%' || upper(x[1:2]) END || x[3:] ELSE a || '%' || x END)"
    steps = f"string_split({percent(of(4))}, '/')"
    flat = f"'/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform({steps}[2:], lambda x: [x])), lambda a, x: CASE WHEN x[1] = '..' THEN a[:-2] WHEN x[1] = '.' THEN a ELSE a || x END), '/')"
    path = f"(CASE WHEN {steps}[-1] IN ('.', '..') AND {flat} <> '/' THEN {flat} || '/' ELSE {flat} END)"
    port = f"(CASE WHEN {of(3)} = '' OR (lower({of(1)}) = 'http' AND {of(3)} = '80') OR (lower({of(1)}) = 'https' AND {of(3)} = '443') THEN '' ELSE ':' || {of(3)} END)"
    return {"scheme": f"lower({of(1)})", "host": f"lower({of(2)})", "port": port, "path": path, "query": percent(f"({of(5)})[2:]")}


def canonical_sql(url: str) -> str:
    p = _parts_sql(url)
    return f"(CASE WHEN {p['host']} <> '' THEN {p['scheme']} || '://' || {p['host']} || {p['port']} || {p['path']} || CASE WHEN {p['query']} <> '' THEN '?' || {p['query']} ELSE '' END END)"


def match_key_sql(url: str) -> str:
    p = _parts_sql(url)
    kept = f"array_to_string(list_sort(list_filter(string_split({p['query']}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:{TRACKING})(?:=|$)'))), '&')"
    return f"(CASE WHEN {p['host']} <> '' THEN regexp_replace({p['host']}, '^www\\.', '') || {p['port']} || CASE WHEN {p['path']} = '/' THEN '/' ELSE regexp_replace({p['path']}, '/$', '') END || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END)"
