"""The training-data operators: edge cases on hand-made rows, and held-out or brute-force checks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, rows
from webloom.llm import boilerplate, catalog, language, mixing, packing, rank_fusion, reading, residue, similar_vectors, split_overlap, stuffing


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, oracle, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), oracle.execute(catalog.SQL[name]).fetchdf()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["p3_found", "p7_found", "p9_shares"])
def test_query_runs_on_the_smallest_tables(spark, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert not got.duplicated().any()


def test_median_rank_nulls_ties_repeats(spark):
    data = [(1, 10, 5.0, 1.0, "x"), (1, 11, None, 3.0, "x"), (1, 12, 1.0, 3.0, "y"), (1, 12, 2.0, None, "y"), (1, None, 1.0, 1.0, ""), (None, 3, 1.0, 1.0, ""), (2, 7, None, None, "")]
    df = spark.createDataFrame(data, "q int, s int, a double, b double, g string")
    got = {(r.q, r.s): r.place for r in rank_fusion.median_rank(df, "q", "s", {"a": ("low", 1.0), "b": ("high", 1.0)}).collect()}
    assert got == {(1, 12): 1, (1, 10): 3, (1, 11): 2, (2, 7): 1}
    assert rank_fusion.median_rank(df.limit(0), "q", "s", {"a": ("low", 1.0)}).count() == 0


def test_ranks_of_shared_values_are_the_same_when_sent(spark, monkeypatch):
    df = spark.range(200).select(F.lit(1).alias("q"), F.col("id").cast("int").alias("s"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("a"), (F.col("id") % 2).alias("b"))
    placed = lambda: {r.s: r.place for r in rank_fusion.median_rank(df, "q", "s", {"a": ("low", 1.0), "b": ("high", 1.0)}).collect()}
    want = placed()
    monkeypatch.setattr(rank_fusion, "HOT", 50)
    assert placed() == want and sorted(want.values()) == list(range(1, 201))


def test_weighted_median_follows_the_heavier_score(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 9.0), (1, 2, 2.0, 1.0)], "q int, s int, a double, b double")
    top = rank_fusion.median_rank(df, "q", "s", {"a": ("low", 3.0), "b": ("low", 1.0)}).filter("place = 1").first()
    assert top.s == 1


def _vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 96))
    v = centres[rng.integers(0, 6, n)] * 0.4 + rng.normal(size=(n, 96))
    v[: n // 3] = v[n // 3 : 2 * (n // 3)][: n // 3] + 0.15 * rng.normal(size=(n // 3, 96))
    v = np.clip(v / np.linalg.norm(v, axis=1, keepdims=True) * 127 * 2, -127, 127).astype(int)
    return [(i + 1, v[0].tolist() if i < copies else v[i].tolist()) for i in range(n)]


def test_similar_vectors_find_close_pairs_and_copies(spark):
    data = _vectors(600, 3, copies=200)
    bad = [(9001, None), (9002, [0] * 96), (9003, [1] * 48), (9004, [None] + [1] * 95), (None, [1] * 96), (5, data[4][1])]
    df = spark.createDataFrame(data + bad, "vec_id long, vec array<int>").select("vec_id", F.col("vec").cast("array<tinyint>"), F.lit(1).alias("t"))
    got = {(r.vec_id, r.near_id) for r in similar_vectors.nearest_vectors(df, "vec_id", "vec", 5, similar_vectors.CLOSE, least=0.9).collect()}
    x = np.array([v for _, v in data], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(len(x)):
        c = np.round(x @ x[i], 6)
        c[i] = -2
        want |= {(i + 1, int(j) + 1) for j in np.lexsort((np.arange(len(x)), -c))[:5] if c[j] >= 0.9}
    assert not got - want and len(got & want) >= 0.98 * len(want)
    assert similar_vectors.nearest_vectors(df.limit(0), "vec_id", "vec", 5, similar_vectors.CLOSE).count() == 0


def test_neighbours_recall(spark):
    df = spark.read.parquet(f"{DATA}/site_vectors.parquet")
    got = similar_vectors.nearest_vectors(df, "vec_id", "vec", 5, similar_vectors.WIDE, queries="vec_id % 20 = 0").toPandas()
    v = df.toPandas()
    v = v[v["vec"].map(lambda a: a is not None and len(a) == 96 and any(a))].sort_values("vec_id")
    x = np.array(v["vec"].tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hit, all_ = v["vec_id"].to_numpy(), 0, 0
    near = got.groupby("vec_id")["near_id"].apply(set).to_dict()
    for i in np.flatnonzero(ids % 20 == 0):
        c = np.round(x @ x[i], 6)
        c[i] = -2
        top = set(ids[np.lexsort((ids, -c))[:5]])
        hit, all_ = hit + len(top & near.get(ids[i], set())), all_ + 5
    assert hit >= 0.9 * all_


def test_residue_messages(spark):
    good = ["How to write {{ name }} in page templates", "A course on JavaScript for beginners, taught in the evenings.", "Our shop sells bread.", "Error messages people understand: a guide to writing them.", None, "", "  ", "* [Home](/home)"]
    bad = ["{{title}}", "Welcome to [shop_name]", "404 Not Found", "Please enable JavaScript to continue.", "Lorem ipsum dolor sit amet", "Our shop in {$CITY} sells bread and seasonal fruit every day.", "PAGE NOT FOUND", "undefined"]
    df = spark.createDataFrame([(i, t, "velmora.example") for i, t in enumerate(good + bad)], "id int, text string, host string")
    got = {r.id for r in residue.messages(df, "text", "host").collect()}
    assert got == set(range(len(good), len(good) + len(bad)))


def test_page_residue_needs_that_nothing_else_is_there(spark):
    notice = "Please enable JavaScript to continue."
    data = [(1, "a.example", "u1", notice), (2, "a.example", "u2", notice + "\nThe town museum repairs old clocks for visitors."), (3, "a.example", "u3", None), (4, None, None, "Home\n404 not found"), (5, "b.example", "u5", "ab" * 100_000)]
    df = spark.createDataFrame(data, "page_id long, domain string, url string, text string").withColumn("field", F.lit(0))
    assert {r.rec_id for r in residue.page_residue(df).collect()} == {1, 4}
    assert residue.page_residue(df.limit(0)).count() == 0


def test_boilerplate_drops_menus_and_keeps_sentences(spark):
    data, no = [], 0
    for h in range(4):
        for p in range(6):
            no += 1
            text = f"Home | News | Shop {h}\nStory of {chr(96 + no) * 5} and of the mill and the river goes on for long.\n\nShare this page\nOpening times of {chr(96 + no) * 5}\n© 2020 Host{h}. All rights reserved."
            data.append((no, f"host{h}.example", f"https://host{h}.example/{p}", f"Mill {no}", text))
    data += [(900, None, None, None, None), (901, None, None, "T", "One line only."), (902, "z.example", "u", "T", "")]
    df = spark.createDataFrame(data, "page_id long, domain string, url string, title string, text string")
    got = {(r.page_id, r.line_no): r.main for r in boilerplate.main_lines(df, []).collect()}
    assert not got[1, 1] and got[1, 2] and not got[1, 4] and not got[1, 6] and got[901, 1] and (1, 3) not in got and (900, 1) not in got
    assert boilerplate.main_lines(df.limit(0), []).count() == 0


def test_boilerplate_drops_rare_blocks_of_one_class(spark):
    data, order = [], random.Random(5)
    for p in range(20):
        lines = ["Home | News | Shop", f"Story of {chr(97 + p) * 5} and of the mill and the river goes on for long."]
        lines += ["River gauge today", "Ferry timetable", "Harbour webcam"] if p < 4 else []
        lines += order.sample(["Bring warm boots", "Dogs on a lead"], 2) if p in (3, 5, 7, 9) else []
        lines += ["Mind the step"] if p in (1, 6, 11, 16) else []
        data.append((p, "host.example", f"https://host.example/{p}", f"Mill {p}", "\n".join([*lines, "Terms of use"])))
    df = spark.createDataFrame(data, "page_id long, domain string, url string, title string, text string")
    got = {(r.page_id, r.line_no): r.main for r in boilerplate.main_lines(df, []).collect()}
    assert not any(got[0, n] for n in (1, 3, 4, 5, 6)) and not got[3, 4]
    assert got[0, 2] and got[16, 3] and got[5, 3] and got[5, 4] and got[1, 6]


def test_boilerplate_keeps_recurring_facts_of_the_body(spark):
    data = []
    for n in range(48):
        word = lambda k: "".join(chr(97 + int(c)) for c in str(1000 + 10 * n + k)) * 2
        say = lambda k: f"Story of {word(k)} and of the mill and the river goes on for long."
        fact, box = ["Moorings: 12 boats"] * (n % 4 == 0), ["Follow our kite"] * (n % 4 == 0)
        data.append((n, f"host{n // 4}.example", f"https://{n}.example/", "T", "\n".join(["Home | News | Shop", *box, say(1), *fact, say(2)])))
    df = spark.createDataFrame(data, "page_id long, domain string, url string, title string, text string")
    got = {(r.page_id, r.line_no): r.main for r in boilerplate.main_lines(df).collect()}
    assert all(got[n, 4] and not got[n, 2] and not got[n, 1] for n in range(0, 48, 4))
    assert boilerplate.line_form("Les écoles de Paris", "x")[1] == "les écoles de x"


def test_stuffed_texts(spark):
    spam = ["cheap sofa, buy sofa, best sofa, sofa sale, online sofa, top sofa", "http://a.example/x http://b.example/x http://c.example/x http://d.example/x", "#sofabuy #sofasale #sofatop #sofa24h #sofabest", "shoes size 41 shoes size 42 shoes size 43 shoes size 44 shoes size 45"]
    fine = ["We repair chairs, sofas, tables, clocks and lamps, and we collect them from your home.", "Velmora", "The village library sells bread to people who live nearby.", "Home | Shoes | Contact", None, " "]
    data = [(f"s{i}-{j}", f"h{i}.example", t.replace("sofa", w)) for i, t in enumerate(spam) for j, w in enumerate(("sofa", "boot", "lamp"))] + [(f"f{i}-{j}", f"g{j}.example", t) for i, t in enumerate(fine) for j in range(8)]
    df = spark.createDataFrame(data, "key string, host string, text string").withColumn("linkers", F.lit(-1).cast("long")).withColumn("hash", F.lit("clash"))
    got = {r.key for r in stuffing.stuffed(df).collect()}
    assert got == {k for k, _, _ in data if k[0] == "s"}
    assert stuffing.stuffed(df.limit(0)).count() == 0


def test_weak_labels():
    label = lambda t: stuffing.weak_label([*stuffing.content_features(t), 0, 0, 0])
    assert label("Nasz mały warsztat porównuje dawne pieśni tuż obok portu.") == 0 and label("sofa buy sofa sale sofa top sofa best") == 1


def test_long_texts_are_in_the_training_sample(spark):
    long = lambda w: " ".join(f"cheap {w}{i % 7}, buy {w}{i % 7}," for i in range(4000))
    df = spark.createDataFrame([*((f"a{i}", f"g{i}", long("abcdefgh"[i] * 4)) for i in range(8)), *((f"b{i}", f"h{i}", f"The village library of {'abcdefghij'[i] * 4} sells bread.") for i in range(10))], "key string, host string, text string").withColumn("linkers", F.lit(None).cast("long"))
    assert {r.key for r in stuffing.stuffed(df).collect()} == {f"a{i}" for i in range(8)}


def test_languages_held_out():
    d = pd.read_parquet(DATA.replace("0.001", "0.01") + "/homepage_meta.parquet")
    sentences = {"en": ["the village library sells bread to the people of the town", "our small workshop repairs old clocks and radios every day"], "de": ["die bücherei im dorf verkauft brot an die leute der stadt", "unsere kleine werkstatt repariert alte uhren und radios jeden tag"]}
    train = {k: v * 20 for k, v in sentences.items()}
    models = language.Models(train)
    told, sure = models.best(["the workshop sells clocks to the town", "die werkstatt verkauft uhren an die stadt", ""])
    assert told[:2] == ["en", "de"] and told[2] is None and (sure[:2] > 0.5).all() and len(d)
    assert language.Models({"en": [], "de": []}).best([]) == ([], pytest.approx(np.zeros(0)))
    assert language.segments(None, "") == []


def test_same_question():
    same = [("mill hours velmora", "velmora mill hours"), ("opening hours velmora tegi", "openign hours velmora tegi"), ("hours of velmora tegi", "hours of velmorategi"), ("hours velmora", "hours velmora please")]
    other = [("velmora model 12 hours", "velmora model 13 hours"), ("velmora opening hours", "velmora return address"), ("velmora hours", "dodarabo hours")]
    assert all(split_overlap.same_question(*p) for p in same) and not any(split_overlap.same_question(*p) for p in other)


def _rows_of_words(spark, data):
    return spark.createDataFrame([(i, s, "", t.split()) for i, s, t in data], "id long, side int, block string, words array<string>")


def test_cosine_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    data = [(i, i % 2, " ".join(rng.sample(words, 4))) for i in range(120)]
    data += [(1000 + i, 1 - s, t[1:]) for i, s, t in data[:30]] + [(5000, 0, "")]
    vectors = split_overlap.keep(split_overlap.term_vectors(_rows_of_words(spark, data)))
    unit = {r.id: (r.side, {e.term: e.w for e in r.v}) for r in vectors.collect()}
    assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for _, v in unit.values()) and len(unit) == 150
    for least, block in ((0.5, 2048), (0.12, 3)):
        monkeypatch.setattr(split_overlap, "BLOCK", block)
        got = {(r.a, r.b): r.cosine for r in split_overlap.cosine_join(vectors, least).collect()}
        want = {}
        for a, (s, x) in unit.items():
            for b, (r, y) in unit.items():
                if s == 0 and r == 1 and (v := sum(w * y.get(t, 0) for t, w in x.items())) >= least:
                    want[a, b] = v
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert split_overlap.cosine_join(vectors.limit(0), 0.5).count() == 0


def test_slips_leave_common_terms(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    noise = [(100 + i, i % 2, f"{name()} {name()} opening hours") for i in range(2000)]
    pairs = ["velmora tegisu opening hours|vlemora teigsu opening hours", "velmora tegisu opening hours|velmorategisu hours opening", "kodaru opening hours|kodaru opening hours please"]
    data = noise + [(k * 2 + s, s, x) for k, p in enumerate(pairs) for s, x in enumerate(p.split("|"))]
    got = {(r.a, r.b) for r in split_overlap.cosine_join(split_overlap.term_vectors(_rows_of_words(spark, data)), split_overlap.COSINE).collect()}
    assert {(0, 1), (0, 3), (2, 3), (4, 5)} <= got


def test_plan_is_a_whole_packing():
    rng = random.Random(4)
    for capacity in (1, 7, 512):
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(40)}
        planned, total = packing.plan(counts, capacity)
        fill, seen = {}, {}
        for length, first, n, start, each in planned:
            for r in range(n):
                seen[length, first + r] = seen.get((length, first + r), 0) + 1
                at = start + r // each
                fill[at] = fill.get(at, 0) + length
        assert sorted(seen) == sorted((x, r) for x, n in counts.items() for r in range(n)) and set(seen.values()) <= {1}
        assert set(fill) == set(range(total)) and max(fill.values()) <= capacity


def test_packed_cuts_only_what_is_too_long(spark):
    df = spark.createDataFrame([(1, 25), (2, 5), (3, 5), (4, 0), (5, None), (None, 3), (2, 5), (6, 10)], "doc_id long, tokens long")
    limits = spark.createDataFrame([(1, 10), (2, 0), (None, 5)], "pack_id int, capacity_tokens int")
    got = packing.packed(df, limits).toPandas()
    fill = got.dropna(subset=["container_id"]).groupby("container_id")["tokens"].sum()
    assert fill.max() == 10 and fill.sum() == 45 and len(fill) == 5
    assert got.groupby("doc_id").size().to_dict() == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert packing.packed(df.limit(0), limits).count() == 0


def test_mixed_reaches_shares_within_repeats(spark):
    data = [(i, "a" if i % 4 else "b", i, 10 + i % 3) for i in range(400)] + [(1000 + i, "b", i * 4 + 1, 10 + (i * 4 + 1) % 3) for i in range(20)] + [(None, "a", 1, 5), (7000, "z", 9, 5), (7001, "a", 12345, 0)]
    df = spark.createDataFrame(data, "doc_id long, source string, text_hash long, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("c", 0.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mixed(df, targets).toPandas()
    tokens = got.assign(t=got["uses"] * got["tokens"]).groupby("source")["t"].sum()
    assert abs(tokens["a"] / tokens.sum() - 0.5) < 0.02 and got[got["source"] == "a"]["uses"].max() == 1 and got[got["source"] == "b"]["uses"].max() <= 3
    assert mixing.mixed(df.limit(0), targets).count() == 0 and mixing.mixed(df, targets.limit(0)).count() == 0


def test_reading_orders_levels(spark):
    easy, hard = "The cat sat. The dog ran. We had fun.", "Notwithstanding considerable heterogeneity, the institutional reconfiguration necessitates epistemological differentiation across jurisdictions."
    docs = [(i, " ".join([easy] * 3)) for i in range(40)] + [(100 + i, f"{hard} {hard}") for i in range(2)] + [(200, None), (201, ""), (None, easy), (202, "x = load('a')\n" * 3), (203, "a" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100, 5), (101, 5), (5, None)], "doc_id long, band int")
    got = {r.doc_id: r.band for r in reading.reading_levels(df, labels).collect()}
    assert got[30] == 1 and got[100] == 5 and 200 not in got and 201 in got
    assert {r.band for r in reading.reading_levels(df, labels.limit(0)).collect()} == {None}
    assert reading.reading_levels(df.limit(0), labels).count() == 0
