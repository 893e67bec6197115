"""The filter before the residue rules lets every phrase through."""

import itertools
import re

from webloom.llm import residue

_parser = re._parser


def _shortest(parsed):
    """Shortest texts of a parsed pattern, one for each choice of alternatives."""
    parts = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "SUBPATTERN":
            parts.append(_shortest(arg[3]))
        elif op == "BRANCH":
            parts.append([t for x in arg[1] for t in _shortest(x)])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            parts.append([t * arg[0] for t in _shortest(arg[2])] if arg[0] else [""])
        elif op == "IN":
            literal = [chr(v) for k, v in arg if str(k) == "LITERAL"]
            parts.append(literal if literal and str(arg[0][0]) != "NEGATE" else ["z"])
        else:
            parts.append(["z"] if op in ("NOT_LITERAL", "ANY") else [""])
    return ["".join(x) for x in itertools.product(*parts)]


def test_every_phrase_passes_the_filter():
    words = residue.literals()
    texts = {t.replace("#", "404") for p in residue.PHRASES for t in _shortest(_parser.parse(p))}
    assert len(texts) > 200
    assert sorted(t for t in texts if not residue.may_match(t, words)) == []


def test_bare_messages_are_residue(spark):
    texts = ["Just a moment...", "Replace this with your own words", "404 -", "Our shop sells bread."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("host", residue.F.lit("velmora.example"))
    assert {r.id for r in residue.messages(df, "text", "host").collect()} == {0, 1, 2}


def test_what_recurs_in_any_wording_is_found(spark, monkeypatch):
    texts = [("Portal offline, retry connection in 12 s", f"h{i}.example") for i in range(3)] + [("System refresh, please wait", "h1.example"), ("Welcome to &lt;shop_name&gt;", "h2.example"), ("Fresh bread since 1950", "h3.example")]
    texts += [("Learn why every browser loads a page slowly, in plain words.", f"g{i}.example") for i in range(5)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, text string, host string")
    found = lambda: {r.id for r in residue.messages(df, "text", "host", whole=True).collect()}
    assert found() == {0, 1, 2, 4}
    monkeypatch.setattr(residue, "WIDE", 10**9)
    assert found() == {4}
