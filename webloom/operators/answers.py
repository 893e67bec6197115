"""Instant answers over a column of queries: sums, units, money, zones, holidays, weather codes, the first that fits."""

from __future__ import annotations

import ast
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from webloom.operators.strings import grouped_number
from webloom.sources.tables import table

# Longest query answered, units in metres, kilograms, litres and seconds, and codes of weather in words.
LONGEST = 120
UNITS = {"m": ("length", 1.0), "km": ("length", 1000.0), "cm": ("length", 0.01), "in": ("length", 0.0254), "ft": ("length", 0.3048), "mi": ("length", 1609.344), "kg": ("mass", 1.0), "g": ("mass", 0.001), "lb": ("mass", 0.45359237), "oz": ("mass", 0.028349523125), "l": ("volume", 1.0), "ml": ("volume", 0.001), "min": ("time", 60.0), "h": ("time", 3600.0), "s": ("time", 1.0)}
WEATHER = {0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 51: "light drizzle", 61: "light rain", 63: "rain", 65: "heavy rain", 71: "light snow", 80: "rain showers", 95: "thunderstorm"}
#: Rates to one unit of the first currency, in use until a table of rates is given.
RATES = {"eur": 1.0, "usd": 1.25, "gbp": 0.8, "jpy": 160.0}
#: Phrases after which help lines come first.
HELP = "i want to die|kill myself|end my life"

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}
_CALLS = {"sqrt": math.sqrt, "ln": math.log, "log": math.log10, "sin": math.sin, "cos": math.cos, "abs": abs, "factorial": math.factorial}


def calculated(text: str) -> float | None:
    """The value of a sum: + - * / ^ %, brackets, factorials, a few functions, and words for signs; None for anything else, or beyond size."""
    t = text.lower().replace(",", "").replace("×", "*").replace("÷", "/").replace("^", "**")
    for word, sign in (("plus", "+"), ("minus", "-"), ("times", "*"), ("divided by", "/")):
        t = t.replace(word, sign)
    t = re.sub(r"(\d+(?:\.\d+)?)\s*%\s*of\s+", r"\1/100*", t)
    t = re.sub(r"(\d+)!", r"factorial(\1)", t)
    if not re.search(r"[-+*/(]", t) or len(t) > LONGEST:
        return None

    def value(n):
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return n.value
        if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            a, b = value(n.left), value(n.right)
            if isinstance(n.op, ast.Pow) and (abs(b) > 1000 or abs(a) > 1e6):
                raise ValueError
            return _OPS[type(n.op)](a, b)
        if isinstance(n, ast.UnaryOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](value(n.operand))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and len(n.args) == 1:
            x = value(n.args[0])
            if n.func.id == "factorial" and not 0 <= x <= 170:
                raise ValueError
            return _CALLS[n.func.id](x)
        raise ValueError

    try:
        out = float(value(ast.parse(t.strip(), mode="eval").body))
        return out if math.isfinite(out) else None
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


@F.pandas_udf(DoubleType())
def calculator(texts: pd.Series) -> pd.Series:
    return pd.Series([calculated(t) if isinstance(t, str) else None for t in texts], dtype="float64")


def converted(query: Column) -> Column:
    """The number of "N unit in unit" in the other unit, of one dimension; temperatures c and f too; else null."""
    part = lambda n: F.regexp_extract(F.lower(query), r"^\s*(-?[0-9.]+)\s*([a-z]+) (?:in|to) ([a-z]+)\s*$", n)
    n, a, b = F.expr("1.0") * F.nullif(part(1), F.lit("")).cast("double"), part(2), part(3)
    of = lambda u, i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[i])]), u)
    size, kind = (lambda u: of(u, 1)), (lambda u: of(u, 0))
    return F.when(kind(a) == kind(b), n * size(a) / size(b)).when((a == "c") & (b == "f"), n * 9 / 5 + 32).when((a == "f") & (b == "c"), (n - 32) * 5 / 9)


def exchanged(query: Column) -> Column:
    """The amount of "N cur in cur" at the rates; else null."""
    part = lambda n: F.regexp_extract(F.lower(query), r"^\s*([0-9.]+)\s*([a-z]{3}) (?:in|to) ([a-z]{3})\s*$", n)
    rate = lambda u: F.try_element_at(F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv]), u)
    return F.nullif(part(1), F.lit("")).cast("double") * rate(part(3)) / rate(part(2))


def easter(year: Column) -> dict[str, Column]:
    """month and day of Easter Sunday by the Gregorian rule."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    rest = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    s = h + rest - 7 * div(a + 11 * h + 22 * rest, 451) + 114
    return {"month": div(s, 31), "day": s % 31 + 1}


def _numbers(spark, d) -> DataFrame:
    return table(spark, d, "part").filter("p_partkey is not null").select("p_partkey", "p_size", "p_retailprice")


def sums(spark, d):
    """Sums written in signs and in words over the parts' sizes."""
    q = _numbers(spark, d).select("p_partkey", F.explode(F.array(F.concat("p_size", F.lit(" + 2 * ("), "p_partkey", F.lit(" - 1)"))
        , F.concat(F.lit("15% of "), "p_size"), F.concat("p_size", F.lit(" times 3 minus 1")), F.concat("p_size", F.lit("^2 / 4")), F.lit("import os"), F.concat("p_size", F.lit(" / 0")))).alias("asked"))
    return q.select("p_partkey", "asked", F.round(calculator("asked"), 6).alias("value"))


def unit_conversions(spark, d):
    """Sizes of the parts in other units; units of another dimension give nothing."""
    q = _numbers(spark, d).select("p_partkey", F.explode(F.array(*[F.concat(F.col("p_size").cast("string"), F.lit(x)) for x in (" in to cm", " lb in kg", " mi to km", " c to f", " kg to m")])).alias("asked"))
    return q.select("p_partkey", "asked", F.round(converted(F.col("asked")), 6).alias("value")).filter("value is not null")


def exchanges(spark, d):
    q = _numbers(spark, d).select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" usd in gbp")).alias("asked"))
    return q.select("p_partkey", F.round(exchanged(F.col("asked")), 6).alias("value"))


def zone_times(spark, d):
    """The time of each order in two other zones."""
    t = F.col("o_orderdate").cast("timestamp")
    at = lambda z: F.date_format(F.from_utc_timestamp(t, z), "yyyy-MM-dd HH:mm")
    return table(spark, d, "orders").select("o_orderkey", at("Asia/Tokyo").alias("tokyo"), at("America/New_York").alias("new_york"))


def holiday_dates(spark, d):
    """Fixed, nth-weekday and Easter holidays of the years of the orders."""
    y = table(spark, d, "orders").filter("o_orderdate is not null").select(F.year("o_orderdate").alias("year")).distinct()
    e = easter(F.col("year"))
    sunday = F.make_date("year", e["month"].cast("int"), e["day"].cast("int"))
    nth = lambda month, weekday, n: F.date_add(F.next_day(F.date_sub(F.make_date("year", F.lit(month), F.lit(1)), 1), weekday), 7 * (n - 1))
    days = {"new year": F.make_date("year", F.lit(1), F.lit(1)), "good friday": F.date_sub(sunday, 2), "easter monday": F.date_add(sunday, 1), "labour day": nth(9, "Mon", 1), "thanksgiving": nth(11, "Thu", 4), "christmas": F.make_date("year", F.lit(12), F.lit(25))}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("holiday"), F.date_format(v, "yyyy-MM-dd").alias("date")) for k, v in days.items()])).alias("x")
    return y.select("year", rows).select("year", "x.holiday", "x.date")


def weather_words(spark, d):
    """Parts by the weather that their size's code stands for."""
    word = F.coalesce(*[F.when(F.col("p_size") == k, v) for k, v in WEATHER.items()], F.lit("unknown"))
    return _numbers(spark, d).groupBy(word.alias("weather")).agg(F.count("*").alias("parts"))


def first_answers(spark, d):
    """The first answer that fits each query: help, units, currency, sums; none for longer ones."""
    q = _numbers(spark, d).select("p_partkey", F.element_at(F.array(F.lit("I want to die"), F.concat("p_size", F.lit(" in to cm")), F.concat("p_size", F.lit(" eur to jpy")), F.concat("p_size", F.lit(" * 7")), F.concat(F.lit("part "), "p_partkey"), F.repeat(F.lit("1+"), 80)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("asked"))
    unit, money = converted(F.col("asked")), exchanged(F.col("asked"))
    rows = q.select("p_partkey", "asked", unit.alias("u"), money.alias("m"), calculator("asked").alias("c"))
    kind = F.when(F.length("asked") > LONGEST, "none").when(F.regexp_like(F.lower("asked"), F.lit(HELP)), "help").when(F.col("u").isNotNull(), "unit").when(F.col("m").isNotNull(), "currency").when(F.col("c").isNotNull(), "sum").otherwise("none")
    rows = rows.select("p_partkey", kind.alias("kind"), F.round(F.coalesce("u", "m", "c"), 6).alias("x"))
    return rows.select("p_partkey", "kind", F.when(F.col("kind").isin("unit", "currency", "sum"), grouped_number(F.col("x"), 8)).alias("value"))


QUERIES = {f.__name__: f for f in (sums, unit_conversions, exchanges, zone_times, holiday_dates, weather_words, first_answers)}


def _shown_sql(x: str) -> str:
    from webloom.operators.strings import _number_sql

    return _number_sql(x, 8)


SQL = {
    "sums": "SELECT p_partkey, p_size || ' + 2 * (' || p_partkey || ' - 1)' AS asked, round(p_size + 2 * (p_partkey - 1), 6)::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, '15% of ' || p_size, round(0.15::DOUBLE * p_size, 6) FROM part UNION ALL SELECT p_partkey, p_size || ' times 3 minus 1', p_size * 3 - 1 FROM part UNION ALL SELECT p_partkey, p_size || '^2 / 4', round(p_size * p_size / 4::DOUBLE, 6) FROM part UNION ALL SELECT p_partkey, 'import os', NULL FROM part UNION ALL SELECT p_partkey, p_size || ' / 0', NULL FROM part",
    "unit_conversions": "SELECT p_partkey, p_size || ' in to cm' AS asked, round(p_size * 0.0254::DOUBLE / 0.01::DOUBLE, 6) AS value FROM part UNION ALL SELECT p_partkey, p_size || ' lb in kg', round(p_size * 0.45359237::DOUBLE, 6) FROM part UNION ALL SELECT p_partkey, p_size || ' mi to km', round(p_size * 1609.344::DOUBLE / 1000, 6) FROM part UNION ALL SELECT p_partkey, p_size || ' c to f', round(p_size * 9 / 5::DOUBLE + 32, 6) FROM part",
    "exchanges": "SELECT p_partkey, round(p_size * 0.8::DOUBLE / 1.25::DOUBLE, 6) AS value FROM part",
    "zone_times": "SELECT o_orderkey, strftime(timezone('Asia/Tokyo', timezone('UTC', o_orderdate)), '%Y-%m-%d %H:%M') AS tokyo, strftime(timezone('America/New_York', timezone('UTC', o_orderdate)), '%Y-%m-%d %H:%M') AS new_york FROM orders",
    "holiday_dates": """WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders WHERE o_orderdate IS NOT NULL), a AS (SELECT year, year % 19 AS a, year // 100 AS b, year % 100 AS c FROM y), h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h), s AS (SELECT year, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS s FROM l), e AS (SELECT year, make_date(year, (s // 31)::INT, (s % 31 + 1)::INT) AS e FROM s),
f AS (SELECT year, e, make_date(year, 9, 1) AS sep, make_date(year, 11, 1) AS nov FROM e) SELECT year, 'new year' AS holiday, year || '-01-01' AS date FROM f UNION ALL SELECT year, 'good friday', strftime(e - 2, '%Y-%m-%d') FROM f UNION ALL SELECT year, 'easter monday', strftime(e + 1, '%Y-%m-%d') FROM f UNION ALL SELECT year, 'labour day', strftime(sep + ((8 - isodow(sep)) % 7)::INT, '%Y-%m-%d') FROM f UNION ALL SELECT year, 'thanksgiving', strftime(nov + ((11 - isodow(nov)) % 7 + 21)::INT, '%Y-%m-%d') FROM f UNION ALL SELECT year, 'christmas', year || '-12-25' FROM f""",
    "weather_words": f"SELECT CASE p_size {' '.join(f'WHEN {k} THEN {v!r}' for k, v in WEATHER.items())} ELSE 'unknown' END AS weather, count(*) AS parts FROM part GROUP BY 1",
    "first_answers": f"SELECT p_partkey, ['help', 'unit', 'currency', 'sum', 'none', 'none'][p_partkey % 6 + 1] AS kind, CASE p_partkey % 6 WHEN 1 THEN {_shown_sql('round(p_size * 0.0254::DOUBLE / 0.01::DOUBLE, 6)')} WHEN 2 THEN {_shown_sql('round(p_size * 160::DOUBLE, 6)')} WHEN 3 THEN {_shown_sql('(p_size * 7)::DOUBLE')} END AS value FROM part",
}
