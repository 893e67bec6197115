"""Core operators on hand-made rows: nulls, ties, large groups, empty tables."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators.ranking import count_before
from webloom.plans.lineage import keep, shared_dir


def test_count_before_in_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("g"), F.col("id").alias("o"), F.lit(2).alias("n"))
    got = count_before(df, ["g"], ["o"], "n", "before").toPandas().sort_values(["g", "o"])
    want = got.groupby("g").cumcount() * 2
    assert (got["before"].to_numpy() == want.to_numpy()).all()


def test_count_before_null_keys_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 1), ("a", None, 1), ("a", 5, 1)], "g string, o int, n int")
    got = {(r.g, r.o): r.b for r in count_before(df, ["g"], ["o"], "n", "b").collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", None): 0, ("a", 5): 1}
    assert count_before(df.limit(0), ["g"], ["o"], "n", "b").count() == 0


def test_keep_gives_the_same_rows(spark):
    df = spark.range(100).withColumn("r", F.rand())
    kept = keep(df)
    assert kept.collect() == kept.collect()


class _Context:
    """A session of a cluster that names no shared folder."""

    def __init__(self, master):
        self.master, self.sparkContext, self.conf = master, self, self

    def getConf(self):
        return {}

    def get(self, key, default):
        return default


def test_a_cluster_must_name_a_shared_folder(spark):
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(_Context(master))
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert "webloom-" in shared_dir(_Context("local[2]"))


def test_words(spark):
    cases = {"Tobin's Mill": "tobins mill", "  Q&A  Corner ": "qa corner", "?!": "", "N.R. Dairy": "nr dairy", "Pâté Gärten": "pâté gärten", None: None, "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.normalize(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_match_key(spark):
    cases = {"http://www.mill.example/bread/?gclid=7&z=2&k=1": "mill.example/bread?k=1&z=2", "https://a.example": "a.example/", "nothing": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", U.match_key(F.col("u")).alias("k"))
    assert {r.u: r.k for r in df.collect()} == cases
