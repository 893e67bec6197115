"""Writers: JSON lines, compacted records, buckets, sets, reports, index tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import hashes as H
from webloom.functions import text as T
from webloom.operators.ranking import count_before
from webloom.plans.lineage import keep


def write_jsonl(df: DataFrame, path: str) -> str:
    """One JSON object a line; the folder appears whole or not at all, by the commit protocol."""
    df.write.mode("overwrite").json(path)
    return path


def compact(base: DataFrame, journal: DataFrame, key: str, order: str, path: str) -> str:
    """The base with its journal folded in (the highest order of a key wins), sorted in ranges by score where there is one."""
    both = base.unionByName(journal, allowMissingColumns=True).filter(F.col(key).isNotNull())
    one = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), F.struct(F.col(order), F.xxhash64(*both.columns))).alias("x")).select(key, "x.*")
    return write_jsonl(one.repartitionByRange(F.desc_nulls_last("weight"), key).sortWithinPartitions(F.desc_nulls_last("weight"), key) if "weight" in one.columns else one, path)


def write_buckets(sites: DataFrame, cap: int, path: str) -> str:
    """sites (domain, title, score) under the buckets of their keys: words of the title and its whole; the best `cap` of each key, one folder a bucket group."""
    words = T.words(F.col("title"))
    keys = sites.select("domain", "score", F.explode(F.array_distinct(F.concat(words, F.array(F.array_join(words, ""))))).alias("key")).filter(F.length("key") >= 2)
    best = keys.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "domain"))).filter(F.col("place") <= cap)
    out = best.withColumn("bucket", H.bucket_of(F.col("key")))
    out.withColumn("group", (F.col("bucket") % 16)).repartition("group", "bucket").write.mode("overwrite").partitionBy("group").parquet(path)
    return path


def write_set(items: DataFrame, per_part: int, path: str) -> str:
    """Items in parts of at most `per_part`, the heaviest first, and a manifest that names the parts with their lines. Gives the manifest's path."""
    ranked = count_before(items.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)).withColumn("_by", -F.coalesce("weight", F.lit(0.0))), ["_all"], ["_by", "id", "rev"], "_one", "_place")
    rows = keep(ranked.withColumn("part", F.floor(F.col("_place") / per_part).cast("int")))
    lines = rows.select("part", F.to_json(F.struct(*items.columns)).alias("value"))
    lines.repartition("part").write.mode("overwrite").partitionBy("part").text(f"{path}/parts")
    counts = rows.groupBy("part").agg(F.count("*").alias("lines")).orderBy("part").collect()  # one row a part
    manifest = {"version": 1, "parts": [{"name": f"parts/part={r.part}", "lines": r.lines} for r in counts]}
    spark = items.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
    return f"{path}/manifest.json"


def write_index(postings: DataFrame, lengths: DataFrame, path: str) -> str:
    """Postings by ranges of terms, with the largest tf of each term's file in its statistics, lengths and document frequencies beside; under a new path, so readers of the old see it whole."""
    kept = keep(postings)
    kept.repartitionByRange("term").sortWithinPartitions("term", F.desc("tf")).write.mode("overwrite").parquet(f"{path}/postings")
    kept.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("most")).write.mode("overwrite").parquet(f"{path}/terms")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    return path


def write_report(manifest: dict, cases: DataFrame, summary: DataFrame, path: str) -> str:
    """A manifest line, a line for each case, and a summary line; three folders of one report."""
    spark = cases.sparkSession
    head = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    for name, df in (("0-manifest", head), ("1-cases", cases.select(F.to_json(F.struct(*cases.columns)).alias("value"))), ("2-summary", summary.select(F.to_json(F.struct(*summary.columns)).alias("value")))):
        df.write.mode("overwrite").text(f"{path}/{name}")
    return path
