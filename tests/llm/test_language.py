"""What p6_found leaves out."""

from tests.conftest import DATA
from webloom.llm import language


def test_p6_leaves_out_what_p5_finds(spark, monkeypatch):
    found = spark.createDataFrame([], "src string, rec_id long")
    monkeypatch.setattr(language, "p5_found", lambda spark, d: found)
    ids = sorted({r.meta_id for r in language.p6_found(spark, DATA).collect()})
    assert len(ids) > 1
    found = spark.createDataFrame([("homepage_meta", ids[0]), ("anchors", ids[1])], "src string, rec_id long")
    assert {r.meta_id for r in language.p6_found(spark, DATA).collect()} == set(ids[1:])


def test_whole_languages(spark):
    models = language.Models({"en": ["the village library sells bread to the people of the town"] * 20, "de": ["die bücherei im dorf verkauft brot an die leute der stadt"] * 20})
    df = spark.createDataFrame([(1, "Velmora", "The library sells bread to the town."), (2, None, "Die Leute der Stadt"), (3, None, None), (None, "x", "y"), (4, "", " ")], "id long, title string, description string").withColumn("letters", language.F.lit(0))
    got = {r.id: r.lang for r in language.whole_languages(df, models).collect()}
    assert got == {1: "en", 2: "de", 3: None, 4: None}
