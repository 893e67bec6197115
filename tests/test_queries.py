"""Every core query against its SQL on the smallest data."""

import importlib
import re
import subprocess
import sys

import duckdb
import pytest

from tests.conftest import DATA, rows
from webloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = oracle.execute(catalog.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def _exact(frame):
    return sorted(frame[sorted(frame.columns)].itertuples(index=False, name=None), key=repr)


def test_page_scores_equal_sql_to_the_last_place(spark, oracle):
    got = catalog.QUERIES["page_scores"](spark, DATA).toPandas()
    assert _exact(got) == _exact(oracle.execute(catalog.SQL["page_scores"]).fetchdf())


@pytest.mark.parametrize("titles", [[f"corner x{i}" for i in range(400)], [" ".join(f"w{i}" for i in range(63))], ["\u3000Mill Lane\xa0", " Mill Lane ", "Mill\xa0Lane\n", "Mill \t", "Mill\xa0\n"]], ids=["scores", "names", "blanks"])
def test_page_scores_of_odd_titles_equal_sql(spark, tmp_path, titles):
    """Half way between two numbers of five places lie some scores, and the name of 63 of a query's 64 words; blanks are of many kinds."""
    data = [(20 * i, t, 31 * i + 31, "docs", "a.example", "en") for i, t in enumerate(titles)]
    spark.createDataFrame(data, "doc_id long, title string, n_chars long, source string, site string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["page_scores"](spark, str(tmp_path)).toPandas()
    assert _exact(got) == _exact(c.execute(catalog.SQL["page_scores"]).fetchdf())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"fitted_bias", "trained_order"}  # iterations, see test_core


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, DATA).columns


@pytest.mark.parametrize("name", ["fitted_bias", "trained_order"])
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_core_stands_alone():
    code = "import sys; sys.modules['webloom.llm'] = None; import webloom.catalog, webloom.operators.ranking"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
    importlib.import_module("__spark_entry__")


def _exploded_broadcasts(df):
    """Broadcasts in a plan of what was exploded just for them: a planner takes it for as small as it was before."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[ :+-]*", x)[0]) for x in lines]
    below = [next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)) for i in range(len(lines))]
    return [x for i, x in enumerate(lines) if "BroadcastExchange" in x and "Generate " in (under := "\n".join(lines[i : below[i]])) and "Join" not in under]


@pytest.mark.parametrize("name", ["local_first", "filled_towns", "places_around", "name_fixes", "mistyped_places", "spelling_forms"])
def test_what_is_exploded_is_not_broadcast(spark, name):
    assert not _exploded_broadcasts(catalog.QUERIES[name](spark, DATA))


def test_question_pages_of_repeated_titles_equal_sql(spark, tmp_path):
    """Many pages of one title, one page under two titles, and questions of common words alone."""
    titles = [f"{x} {y}" for x in ("Mill", "Lane", "Old Mill Lane", "Rare") for y in ("walking tours", "maps and guides", "since 1987")] * 15
    data = [(7 * i, t, i, "docs", "a.example", "en") for i, t in enumerate([*titles, "Where is Mill now", "where is it", "Unique walking tours"])] + [(140, "Another Lane", 5, "docs", "a.example", "en")]
    spark.createDataFrame(data, "doc_id long, title string, n_chars long, source string, site string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert _exact(catalog.QUERIES["question_pages"](spark, str(tmp_path)).toPandas()) == _exact(c.execute(catalog.SQL["question_pages"]).fetchdf())


def test_question_pages_sum_no_words_of_pages(spark):
    """Every word of a question isn't joined with all pages that hold it, to be summed by question and page."""
    plan = catalog.QUERIES["question_pages"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[query#\d+, page#", plan)
