"""Core operators against brute force and on hand-made edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from webloom.functions import urls as U
from webloom.operators import answers, clicks, graph, learned, places, search, strings, understanding, vectors
from webloom.sources import readers
from webloom.streaming import epochs


def _ranks(spark, links, seeds):
    rows = graph.seeded_rank(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(s,) for s in seeds], "node string")).collect()
    return {r.node: r.rank for r in rows}


def test_seeded_rank_equals_a_plain_iteration(spark):
    rng = random.Random(3)
    links = sorted({(f"s{rng.randint(0, 30)}", f"s{rng.randint(0, 30)}") for _ in range(120)} - {(f"s{i}", f"s{i}") for i in range(31)})
    got = _ranks(spark, links, ["s1", "s2"])
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    nodes = {x for e in links for x in e} | {"s1", "s2"}
    rank = {n: 0.5 if n in ("s1", "s2") else 0.0 for n in nodes}
    for _ in range(300):
        new = dict.fromkeys(nodes, 0.0)
        followed = 0.0
        for a, bs in out.items():
            share = rank[a] / max(len(bs), 10)
            followed += share * len(bs)
            for b in bs:
                new[b] += share
        rank = {n: 0.85 * new[n] + ((1 - 0.85 * followed) / 2 if n in ("s1", "s2") else 0.0) for n in nodes}
    assert abs(sum(got.values()) - 1) < 1e-9 and max(abs(got[n] - rank[n]) for n in nodes) < 1e-6


def test_seeded_rank_without_seeds_and_links(spark):
    assert _ranks(spark, [("a", "b"), ("c", "b")], [])["b"] == max(_ranks(spark, [("a", "b"), ("c", "b")], []).values())
    assert _ranks(spark, [], ["a"]) == {"a": 1.0} and _ranks(spark, [], []) == {}


def test_redirects_are_followed_and_loops_stay(spark):
    links = spark.createDataFrame([("a", "b"), ("x", "p"), ("c", "a"), ("m", "c")], "src string, dst string")
    moves = spark.createDataFrame([("b", "c"), ("c", "d"), ("p", "q"), ("q", "p"), (None, "z"), ("s", "s")], "site string, target string")
    assert {(r.src, r.dst) for r in graph.resolved(links, moves).collect()} == {("a", "d"), ("x", "p"), ("d", "a"), ("m", "d")}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("01") for _ in range(64)) for _ in range(20)]
    prints = [(i, p) for i, p in enumerate(base)]
    for i in range(60):
        p = list(rng.choice(base))
        for j in rng.sample(range(64), rng.randint(0, 9)):
            p[j] = "1" if p[j] == "0" else "0"
        prints.append((100 + i, "".join(p)))
    got = {(r.a, r.b) for r in strings.near_copies(spark.createDataFrame(prints, "k long, print string"), "k").collect()}
    first = {}
    for k, p in prints:
        first[p] = min(first.get(p, k), k)
    one = sorted((k, p) for p, k in first.items())
    assert got == {(a, b) for a, p in one for b, q in one if a < b and sum(x != y for x, y in zip(p, q)) <= 6}


def test_exact_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(5).normal(size=(90, 6)).round(3)
    x[7] = x[3]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = {(r.id, r.near) for r in vectors.exact_neighbours(df, df.filter("id % 4 = 0"), "id", "v", 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(0, 90, 4):
        c = np.round(u @ u[i], 6)
        c[i] = -2
        want |= {(i, int(j)) for j in np.lexsort((np.arange(90), -c))[:3]}
    assert got == want
    assert vectors.exact_neighbours(df.limit(0), df.limit(0), "id", "v", 3).count() == 0


def test_position_bias_is_the_same_either_way(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for q in range(60):
        want = rng.random()
        for k in rng.choice(4, 3, replace=False):
            shown = int(rng.integers(5, 20))
            rows.append((q, 1, int(k), shown, int(rng.binomial(shown, want / (k + 1)))))
    df = spark.createDataFrame(rows + [(1, 2, 0, 0, 0)], "query long, domain long, place int, shown long, opened long")
    monkeypatch.setattr(clicks, "EM_ROUNDS", 4)
    here = {r.place: r.examine for r in clicks.position_bias(df).collect()}
    monkeypatch.setattr(clicks, "KINDS", -1)
    there = {r.place: r.examine for r in clicks.position_bias(df).collect()}
    assert all(abs(here[k] - there[k]) < 1e-9 for k in here) and here[0] == 1 and here[1] > here[3]
    assert {r.place: r.examine for r in clicks.position_bias(df.limit(0)).collect()}[1] == 0.5


def test_trees_learn_an_order(spark):
    rng = np.random.default_rng(7)
    rows = [(c, f"d{i}", int(g), float(g + rng.normal() * 0.3), float(rng.normal())) for c in range(60) for i, g in enumerate(rng.integers(0, 4, 8))]
    df = spark.createDataFrame(rows, "case_id long, domain string, grade int, a double, b double")
    trees = learned.lambda_mart(df, ["a", "b"])
    scored = df.withColumn("s", learned.ensemble(trees)).toPandas()
    assert scored[["grade", "s"]].corr(method="spearman").iloc[0, 1] > 0.8
    assert learned.lambda_mart(df.limit(0), ["a", "b"]) == [] and trees == learned.lambda_mart(df, ["a", "b"])


def test_posting_blocks_change_no_score(spark, monkeypatch):
    want = {(r.query, r.domain): round(r.score, 6) for r in search.scored(spark, DATA).collect()}
    monkeypatch.setattr(search, "BLOCK", 7)
    assert {(r.query, r.domain): round(r.score, 6) for r in search.scored(spark, DATA).collect()} == want


def test_calculator():
    cases = {"2 + 3 * 4": 14, "15% of 80": 12, "2^10": 1024, "5!": 120, "7 plus 3": 10, "sqrt(16)": 4, "(1": None, "1/0": None, "__import__('os')": None, "9^9^9^9": None, "": None, "12": None}
    assert {k: answers.calculated(k) for k in cases} == cases


def test_search_operators(spark):
    rows = [("site:Mill.example bread", "sites", ["mill.example"]), ('"old mill" bread', "phrases", ["old mill"]), ("bread -white", "excluded", ["white"]), ("a - b", "excluded", []), ("-site:.de x", "not_sites", ["de"]), ("", "sites", [])]
    for query, part, want in rows:
        df = spark.createDataFrame([(query,)], "q string")
        assert df.select(understanding.operators(F.col("q"))[part].alias("x")).first().x == want, query


def test_canonical_urls(spark):
    cases = {"HTTPS://Mill.Example:443/a/./b/../%7euser?#top": "https://mill.example/a/~user", "http://mill.example:8080": "http://mill.example:8080/", "ftp://mill.example/": None, "http://user@mill.example/": None, " http://mill.example/%e4?": "http://mill.example/%E4", "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", U.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases


def test_readers_skip_what_is_broken(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    items = put("items.json", '{"id": "a.example", "rev": 2}\nnot json\n{"domain": "b.example"}\n' + '{"id": "' + "x" * (1 << 20) + '"}\n')
    assert {r.id for r in readers.read_items(spark, items).collect()} == {"a.example", "b.example"}
    wat = put("x.wat", "WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\nx\r\n\r\nWARC/1.0\r\nWARC-Type: metadata\r\nWARC-Target-URI: https://a.example/\r\n\r\n{broken\r\n\r\n")
    assert readers.read_wat(spark, wat).count() == 0
    dump = put("d.sql", "CREATE TABLE `t`;\nINSERT INTO `t` VALUES (1,'a\\'b',NULL),(2,'c,d)',-3.5);\nINSERT INTO `u` VALUES (9);\n")
    assert [r.row for r in readers.read_sql_dump(spark, dump, "t").collect()] == [["1", "a'b", None], ["2", "c,d)", "-3.5"]]
    hosts = put("hosts", "# x\n0.0.0.0 bad.example # y\nwww.other.example\nsub.bad.example\nnohost\n")
    assert {r.domain for r in readers.read_host_list(spark, hosts).collect()} == {"bad.example", "other.example"}


def test_fold_keeps_the_latest_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3 or None, i * 10) for i in range(30)], "n long, k long, v long")
    df.repartitionByRange(5, "n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert {(r.k, r.n, r.v) for r in epochs.fold(stream, "k", ["n"], "t").collect()} == {(1, 28, 280), (2, 29, 290)}


@pytest.mark.parametrize("km", [5.0, 250.0])
def test_cells_cover_the_circle(spark, km):
    rng = random.Random(8)
    pts = [(i, rng.uniform(-85, 85), rng.choice([-179.95, 179.9, 0.0]) + rng.uniform(-0.04, 0.04)) for i in range(30)]
    near = [(100 + i, lat + rng.uniform(-0.04, 0.04), ((lon + rng.uniform(-0.1, 0.1) + 180) % 360) - 180) for i, lat, lon in pts]
    p, r = spark.createDataFrame(pts, "point long, lat double, lon double"), spark.createDataFrame(near, "place long, lat double, lon double")
    got = {(x.point, x.place) for x in places.around(p, r, km).collect()}

    def dist(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        return 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    assert got == {(i, j) for i, a, b in pts for j, c, d in near if round(dist(a, b, c, d), 3) <= km}


@pytest.mark.parametrize("km", [0.3, 60.0, 80.0])
def test_a_circle_meets_few_cells(spark, km):
    df = spark.createDataFrame([(float(lat), float(lon)) for lat in range(-80, 81, 5) for lon in (-180, -0.03, 179.99)], "lat double, lon double")
    assert df.select(F.max(F.size(places.cells_around(F.col("lat"), F.col("lon"), km)))).first()[0] <= 9


def test_near_copies_send_no_pairs_between_tasks(spark):
    """A block of rows finds each pair once, so that pairs needn't be told apart; rows of one band are cut into blocks and are all met."""
    rng = random.Random(6)
    prints = [(i, format(rng.getrandbits(12) << 40, "064b")) for i in range(3000)]
    df = spark.createDataFrame(prints, "k long, print string")
    found = strings.near_copies(df, "k")
    assert found.count() == found.distinct().count()
    one = sorted({p: k for k, p in reversed(prints)}.items(), key=lambda x: x[1])
    v, k = np.array([int(p, 2) for p, _ in one], dtype=np.uint64), [k for _, k in one]
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 6
    assert {(r.a, r.b) for r in found.collect()} == {(k[i], k[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[a#" not in plan and "translate" not in plan
