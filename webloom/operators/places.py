"""Places: ranks, cells, neighbourhoods, names, doubles. The tables' customers and suppliers stand for places on a grid made of their keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.spelling import near_words
from webloom.sources.tables import table

# Kilometres of the earth's radius, least degrees of a cell, tiers of kinds, size of a tier, and kilometres of doubles.
RADIUS, CELL, TIER, SAME_KM = 6371.0088, 0.1, 1_000_000, 0.3
TIERS = {"city": 9, "town": 8, "landmark": 7, "suburb": 5, "shop": 4, "village": 3, "quarter": 2}
KINDS = list(TIERS)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), F.lit(2))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def place_rank(kind: Column, population: Column, tags: Column) -> Column:
    """Tier of the kind, then the logarithm of people (towns), or ten thousand a tag, below the next tier."""
    tier = F.coalesce(*[F.when(kind == k, t) for k, t in TIERS.items()], F.lit(1))
    inner = F.when(kind.isin("city", "town", "village") & (population > 0), F.log1p(population) * 10_000).otherwise(tags * 10_000)
    return (tier * TIER + F.least(F.floor(inner), F.lit(TIER - 1))).cast("long")


def _bands(km: float) -> tuple[float, float, list[int]]:
    """For circles of so many kilometres (a metre more, as distances are rounded): their radius in degrees, the height of bands of latitude,
    and the columns of each band from south to north. Band and column are as wide as the radius or wider, so that a circle meets nine cells at most
    (a few more next to the poles, where a band is one column)."""
    reach = math.degrees((km + 0.001) / RADIUS)
    high = max(reach, CELL)

    def columns(j: int) -> int:
        edge = max(abs(j * high - 90), abs((j + 1) * high - 90))
        return 1 if edge + high >= 90 else int(360 // math.degrees(math.asin(math.sin(math.radians(high)) / math.cos(math.radians(edge)))))

    return reach, high, [columns(j) for j in range(math.ceil(180 / high))]


def _row(lat: Column, high: float, columns: list[int]) -> Column:
    return F.least(F.greatest(F.floor((lat + 90) / high), F.lit(0)), F.lit(len(columns) - 1)).cast("int")


def _turns(lon: Column, n: Column) -> Column:
    """Number of the column, of n around the earth; beyond 180 degrees it goes on."""
    return F.floor((lon + 180) * n / 360)


def cell_of(lat: Column, lon: Column, km: float) -> Column:
    """The cell (y, x) of a place, among those for circles of so many kilometres."""
    _, high, columns = _bands(km)
    y = _row(lat, high, columns)
    n = F.get(F.lit(columns), y)
    return F.struct(y.alias("y"), F.pmod(_turns(lon, n), n).alias("x"))


def cells_around(lat: Column, lon: Column, km: float) -> Column:
    """Cells (y, x) that cover a circle, wrapping at 180 degrees; all of a band whose pole the circle reaches."""
    reach, high, columns = _bands(km)
    spare = 1e-9  # degrees, for what is rounded
    width = F.when(F.abs(lat) + reach >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(math.sin(math.radians(min(reach, 90.0))) / F.cos(F.radians(lat)), F.lit(1.0))))) + spare

    def across(y: Column) -> Column:
        n = F.get(F.lit(columns), y)
        first = _turns(lon - width, n)
        return F.transform(F.sequence(first, F.least(_turns(lon + width, n), first + n - 1)), lambda x: F.struct(y.alias("y"), F.pmod(x, n).alias("x")))

    return F.flatten(F.transform(F.sequence(_row(lat - reach - spare, high, columns), _row(lat + reach + spare, high, columns)), across))


def places(spark, d) -> DataFrame:
    """place, name, kind, lat, lon, population, tags: the customers, on a grid of their keys."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % len(KINDS) + 1).cast("int"))
    return table(spark, d, "customer").filter("c_custkey is not null").select(k.alias("place"), F.concat(F.lit("place "), F.floor(k / 3).cast("string")).alias("name"), kind.alias("kind"), ((k * 37 % 16000) / 100 - 80).alias("lat"), ((k * 71 % 36000) / 100 - 180).alias("lon"), F.floor(F.abs("c_acctbal") * 100).alias("population"), (k % 9).cast("int").alias("tags"))


def around(points: DataFrame, rows: DataFrame, km: float) -> DataFrame:
    """point, place, km: rows within so many kilometres of each point (point, lat, lon), met through the cells that cover the circle.
    The join is told to sort: a planner takes the exploded points for as small as the points, and would broadcast them."""
    cut = points.select("point", F.col("lat").alias("la"), F.col("lon").alias("lo"), F.explode(cells_around(F.col("lat"), F.col("lon"), km)).alias("c")).select("point", "la", "lo", F.col("c.y").alias("y"), F.col("c.x").alias("x"))
    held = rows.withColumn("c", cell_of(F.col("lat"), F.col("lon"), km)).select("place", "lat", "lon", F.col("c.y").alias("y"), F.col("c.x").alias("x"))
    near = cut.hint("merge").join(held, ["y", "x"]).withColumn("km", F.round(distance_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 3))
    return near.filter(F.col("km") <= km).select("point", "place", "km")


def place_ranks(spark, d):
    return places(spark, d).select("place", place_rank(F.col("kind"), F.col("population"), F.col("tags")).alias("rank"))


def _points(spark, d) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").filter("s_suppkey is not null").select(s.alias("point"), ((s * 37 % 16000) / 100 - 80).alias("lat"), ((s * 71 % 36000) / 100 - 179.97).alias("lon"))


def places_around(spark, d):
    """Places within 60 km of each supplier, nearest first, ten at most."""
    w = Window.partitionBy("point").orderBy("km", "place")
    return around(_points(spark, d), places(spark, d), 60.0).withColumn("n", F.row_number().over(w)).filter("n <= 10")


def same_places(spark, d):
    """Doubles within SAME_KM that share their name: places put beside each on purpose, and the one that stays."""
    p = places(spark, d)
    beside = p.filter("place % 5 = 0").select((F.col("place") + 10_000_000).alias("place"), "name", "kind", (F.col("lat") + 0.001).alias("lat"), (F.col("lon") + F.when(F.col("place") % 2 == 0, 0.001).otherwise(0.02)).alias("lon"), "population", "tags")
    both = p.union(beside)
    near = around(both.select(F.col("place").alias("point"), "lat", "lon"), both, SAME_KM).filter("point < place")
    name = both.select("place", "name")
    return near.join(name, "place").join(name.select(F.col("place").alias("point"), F.col("name").alias("other")), "point").filter("name = other").select(F.col("point").alias("kept"), F.col("place").alias("double"))


def resolved_places(spark, d):
    """The place that each name means: the best ranked one, unless the next is within 15 % of it (then it's ambiguous)."""
    p = places(spark, d).withColumn("rank", place_rank(F.col("kind"), F.col("population"), F.col("tags")))
    w = Window.partitionBy("name").orderBy(F.desc("rank"), "place")
    rows = p.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("rank").over(w))
    return rows.filter("n = 1").select("name", "place", (F.col("next") >= 0.85 * F.col("rank")).alias("ambiguous"))


def mistyped_places(spark, d):
    """Names of sites, as towns', typed without their second letter, and what is meant."""
    n = table(spark, d, "site_items").select(F.lower("title").alias("fix")).filter(F.regexp_like("fix", F.lit("^[a-z]{5,}$"))).distinct()
    typed = n.select(F.concat(F.substring("fix", 1, 1), F.expr("substring(fix, 3)")).alias("word")).distinct()
    near = near_words(typed, n, 1)  # the name that a slip was made of is one edit away
    w = Window.partitionBy("word").orderBy("edits", "fix")
    return near.withColumn("n", F.row_number().over(w)).filter("n = 1").select("word", "fix")


def filled_towns(spark, d):
    """The nearest town or city within 80 km of each shop and landmark."""
    p = places(spark, d)
    towns = p.filter("kind in ('city', 'town')")
    asked = p.filter("kind in ('shop', 'landmark')").select(F.col("place").alias("point"), "lat", "lon")
    w = Window.partitionBy("point").orderBy("km", "place")
    return around(asked, towns, 80.0).withColumn("n", F.row_number().over(w)).filter("n = 1").select("point", F.col("place").alias("town"), "km")


def local_first(spark, d):
    """Suppliers listed with those that have a shop within 60 km first, by name after."""
    near = around(_points(spark, d), places(spark, d).filter("kind = 'shop'"), 60.0).select("point").distinct().withColumn("l", F.lit(1))
    rows = _points(spark, d).join(near, "point", "left").select("point", F.coalesce("l", F.lit(0)).alias("local"))
    return rows.orderBy(F.desc("local"), "point").limit(50)


QUERIES = {f.__name__: f for f in (place_ranks, places_around, same_places, resolved_places, mistyped_places, filled_towns, local_first)}
_P = f"p AS (SELECT c_custkey AS place, 'place ' || (c_custkey // 3) AS name, {KINDS}[c_custkey % {len(KINDS)} + 1] AS kind, (c_custkey * 37 % 16000) / 100.0::DOUBLE - 80 AS lat, (c_custkey * 71 % 36000) / 100.0::DOUBLE - 180 AS lon, floor(abs(c_acctbal) * 100)::BIGINT AS population, (c_custkey % 9)::INT AS tags FROM customer WHERE c_custkey IS NOT NULL)"
_S = "sp AS (SELECT s_suppkey AS point, (s_suppkey * 37 % 16000) / 100.0::DOUBLE - 80 AS lat, (s_suppkey * 71 % 36000) / 100.0::DOUBLE - 179.97::DOUBLE AS lon FROM supplier WHERE s_suppkey IS NOT NULL)"
_RANK = f"(CASE kind {' '.join(f'WHEN {k!r} THEN {t}' for k, t in TIERS.items())} ELSE 1 END * {TIER} + least(floor(CASE WHEN kind IN ('city', 'town', 'village') AND population > 0 THEN ln(1 + population) * 10000 ELSE tags * 10000 END), {TIER - 1}))::BIGINT"
_KM = lambda a, b: f"round(2 * {RADIUS} * asin(sqrt(least(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2), 1))), 3)"
SQL = {
    "place_ranks": f"WITH {_P} SELECT place, {_RANK} AS rank FROM p",
    "places_around": f"WITH {_P}, {_S}, a AS (SELECT point, place, {_KM('sp', 'p')} AS km FROM sp, p WHERE abs(sp.lat - p.lat) < 1 AND {_KM('sp', 'p')} <= 60) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, place) AS n FROM a) WHERE n <= 10",
    "same_places": f"WITH {_P}, b AS (SELECT place, name, lat, lon FROM p UNION ALL SELECT place + 10000000, name, lat + 0.001::DOUBLE, lon + CASE WHEN place % 2 = 0 THEN 0.001::DOUBLE ELSE 0.02::DOUBLE END FROM p WHERE place % 5 = 0) SELECT x.place AS kept, y.place AS double FROM b x JOIN b y ON x.name = y.name AND x.place < y.place WHERE {_KM('x', 'y')} <= {SAME_KM}",
    "resolved_places": f"WITH {_P}, r AS (SELECT *, {_RANK} AS rank FROM p), w AS (SELECT *, row_number() OVER v AS n, lead(rank) OVER v AS nxt FROM r WINDOW v AS (PARTITION BY name ORDER BY rank DESC, place)) SELECT name, place, nxt >= 0.85::DOUBLE * rank AS ambiguous FROM w WHERE n = 1",
    "mistyped_places": "WITH n AS (SELECT DISTINCT lower(title) AS fix FROM site_items WHERE regexp_full_match(lower(title), '[a-z]{5,}')), t AS (SELECT DISTINCT fix[1] || fix[3:] AS word FROM n), x AS (SELECT word, n.fix, levenshtein(word, n.fix) AS e FROM t, n WHERE word <> n.fix AND levenshtein(word, n.fix) <= least(CASE WHEN length(word) <= 3 THEN 0 WHEN length(word) <= 7 THEN 1 ELSE 2 END, CASE WHEN length(n.fix) <= 7 THEN 1 ELSE 2 END)) SELECT word, fix FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY e, fix) AS n FROM x) WHERE n = 1",
    "filled_towns": f"WITH {_P}, a AS (SELECT x.place AS point, y.place AS town, {_KM('x', 'y')} AS km FROM p x, p y WHERE x.kind IN ('shop', 'landmark') AND y.kind IN ('city', 'town') AND abs(x.lat - y.lat) < 1 AND {_KM('x', 'y')} <= 80) SELECT point, town, km FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, town) AS n FROM a) WHERE n = 1",
    "local_first": f"WITH {_P}, {_S}, l AS (SELECT DISTINCT point FROM sp, p WHERE kind = 'shop' AND abs(sp.lat - p.lat) < 1 AND {_KM('sp', 'p')} <= 60) SELECT point, CASE WHEN point IN (SELECT point FROM l) THEN 1 ELSE 0 END AS local FROM sp ORDER BY 2 DESC, 1 LIMIT 50",
}
