"""Lines of HTML pages."""

from pyspark.sql import functions as F

from tests.conftest import DATA
from webloom.llm import boilerplate
from webloom.llm.boilerplate import html_lines


def test_fixtures_keep_and_drop_their_phrases(spark):
    r = boilerplate.p4_fixtures(spark, DATA).agg(*[F.sum(c).alias(c) for c in ("keep", "kept", "drop", "dropped")]).first()
    assert r.kept >= 0.85 * r.keep and r.dropped >= 0.7 * r["drop"]  # with ten pages; 162 of 165 and 202 of 206 with those of sf0.1


def test_classes_need_the_same_pages(spark):
    """Forms of one class stop being one where their occurrence vectors differ."""
    lines = lambda moved: [(p, "h", p, n, n, n) for p in range(20) for n in (1, 2)] + [(p, "h", p, 3, 3, 3) for p in (1, 4, 6, 9)] + [(p + (moved and p < 5), "h", p + (moved and p < 5), 4, 4, 4) for p in (1, 4, 6, 9)]
    found = lambda rows: {r.form for r in boilerplate.template_classes(spark.createDataFrame(rows, "page_id long, domain string, page long, line_no long, form long, shape long")).collect()}
    assert found(lines(False)) == {1, 2, 3, 4} and found(lines(True)) == {1, 2}


def test_html_lines():
    html = "<nav><a href='/0'>Home</a></nav><script>var x = '<p>no</p>';</script><article><p>The <b>old</b> mill.<li>Bread<div>Open daily</div><aside>Follow us</aside><p>End &amp; more"
    assert html_lines(html) == [("[Home](/0)", True), ("The old mill.", False), ("* Bread", False), ("Open daily", False), ("Follow us", True), ("End & more", False)]
    assert html_lines("<aside>Left open<p>The mill is open.") == [("Left open", False), ("The mill is open.", False)] and html_lines("") == []
