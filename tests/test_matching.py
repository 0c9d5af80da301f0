"""The indexed and the threshold search of the catalogue against brute force over every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlist import constants as C
from textlist.fixtures import table
from textlist.functions.similarity import lcs_column, lcs_length, sorted_ratio, token_sort_ratio
from textlist.functions.strings import Strings, pair_lcs
from textlist.operators import match, metric_index, threshold

ITEM = "entry_id string, producer string, cuvee string, vintage string, region string, country string, grape_variety string"


def ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def pair_score(item, row):
    total = weight = 0.0
    for k, w in C.KEY_WEIGHTS.items():
        a, b = item[f"{k}_n"], row[f"{k}_norm"]
        if a:
            r = ratio(a, b)
            total += (100.0 if a == b else min(100.0, r + C.NEAR_BOOST.get(k, 0)) if r > 80 else r) * w
            weight += w
    return total / weight if weight else 0.0


@pytest.fixture(scope="module")
def sides(spark, sf):
    """Items and rows of the given tables, and odd ones."""
    rng = random.Random(2)
    odd = [("x1", None, None, None, None, None, None), ("x2", "", " ", None, None, None, None), ("x3", "Zoë " * 30, "a\u0000b", "1999", None, None, "gamay"), ("x4", "é", None, None, None, None, None)]
    odd += [(f"y{k}", "  ".join(rng.choice(["brand", "12", "house", "old"]) for _ in range(3)), rng.choice(["blue ring", "ring blue", "x"]), rng.choice([None, "1999"]), None, None, None) for k in range(30)]
    items = table(spark, sf, "items").where("cast(entry_id as bigint) % 12 = 1").select(*[c.split()[0] for c in ITEM.split(", ")]).unionByName(spark.createDataFrame(odd, ITEM))
    return match.normalize_items(items).cache(), match.normalize_catalog(table(spark, sf, "catalog")).cache()


@pytest.fixture(scope="module")
def scores(sides):
    items, rows = (df.collect() for df in sides)
    return {(i["entry_id"], r["catalog_row"]): pair_score(i, r) for i in items for r in rows}


def ranked(scores, least, k):
    best = {}
    for (i, r), s in sorted(scores.items(), key=lambda x: (-x[1], x[0][1])):
        if s >= least and len(best.setdefault(i, [])) < k:
            best[i].append((r, s))
    return best


def test_all_pairs(sides, scores):
    got = {(r["entry_id"], r["catalog_row"]): r["score"] for r in match.scored_pairs(*sides).collect()}
    assert got == pytest.approx({p: s for p, s in scores.items() if s >= C.PARTIAL}, abs=1e-9)


def test_best_match(sides, scores):
    direct = {r["entry_id"]: r["catalog_row"] for r in match.direct_match(*sides).collect()}
    for threshold in (C.PARTIAL, C.FUZZY):
        best = ranked(scores, threshold, 1)
        got = {r["entry_id"]: (r["catalog_row"], r["score"], r["provenance"]) for r in match.best_match(*sides, threshold=threshold).collect()}
        assert len(got) == sides[0].count()
        for i, found in got.items():
            if i in direct:
                assert found == (direct[i], 100.0, "direct")
            elif i in best:
                assert found[:2] == pytest.approx(best[i][0], abs=1e-9) and found[2] == ("fuzzy" if found[1] >= C.FUZZY else "partial") or found[1] == 100
            else:
                assert found == (None, None, None)


def test_suggestions(sides, scores):
    got = {}
    for r in match.suggestions(*sides).orderBy("entry_id", "rank").collect():
        got.setdefault(r["entry_id"], []).append((r["catalog_row"], r["score"]))
    want = ranked(scores, C.PARTIAL, 5)
    assert got.keys() == want.keys()
    for i in want:
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=1e-9) and {r for r, _ in got[i]} == {r for r, _ in want[i]}


def test_composite_match(sides):
    items, rows = (df.collect() for df in sides)
    keys = [(r["catalog_row"], r["composite_key"]) for r in rows if r["composite_key"].strip()]
    got = {r["entry_id"]: (r["catalog_row"], r["score"]) for r in match.composite_match(*sides).collect()}
    for i in items:
        said = " ".join(i[f"{k}_n"] for k in C.KEYS)
        best = max(((ratio(said, key), -row) for row, key in keys), default=(0, 0)) if said.split() else (0, 0)
        assert got.get(i["entry_id"]) == ((-best[1], best[0]) if best[0] >= C.PARTIAL else None)


def test_tiles_change_nothing(sides, monkeypatch):
    items, rows = sides
    keys = match.distinct_keys(items.where("producer_n <> ''").select("entry_id", *[F.col(f"{f}_n").alias(f) for f in C.KEYS]))
    cat = rows.select("catalog_row", *[F.col(f"{f}_norm").alias(f) for f in C.KEYS])
    whole = sorted(map(tuple, threshold.search(keys, cat, 3, 70).collect()))
    assert threshold.search(keys.where("false"), cat, 3, 70).count() == threshold.search(keys, cat.where("false"), 3, 70).count() == 0
    monkeypatch.setattr(metric_index, "TILE", 33)  # postings in tiles, values in an index
    monkeypatch.setattr(threshold, "DEPTH", 3)
    monkeypatch.setattr(threshold, "DEAR", 5)
    assert whole == sorted(map(tuple, threshold.search(keys, cat, 3, 70).collect())) != []


@pytest.fixture(scope="module")
def larger(spark):
    sf = "/root/testdata/sf0.01"
    return match.normalize_items(table(spark, sf, "items")).cache(), match.normalize_catalog(table(spark, sf, "catalog")).cache()


def test_searches_read_a_small_part_of_the_pairs(spark, larger):
    """The composite search meets and compares, and the weighted one reads, a small part of keys times rows, and less of it the larger the catalogue is."""
    items, rows = larger
    count = lambda df, *c: df.select(*c).distinct().count()
    meter = metric_index.Meter(*[spark.sparkContext.accumulator(0) for _ in range(2)])
    assert match.composite_match(items, rows, meter).count() > 1000
    pairs = count(items, *[f"{k}_n" for k in C.KEYS]) * count(rows, "composite_key")
    assert 0 < meter.compared.value <= meter.met.value < 0.2 * pairs and meter.compared.value < 0.05 * pairs
    read = spark.sparkContext.accumulator(0)
    assert match.scored_pairs(items, rows, 1, read).count() > 1000
    assert 0 < read.value < 0.05 * count(items, *[f"{k}_n" for k in C.KEYS]) * rows.count()


def test_a_catalogue_and_items_that_repeat_cost_no_more_pairs(spark, sides):
    """A catalogue in four copies: the same scores, the first rows of equal ones, and not more pairs read than for one copy."""
    items, rows = sides
    n, copies = rows.agg(F.max("catalog_row")).head()[0] + 1, F.explode(F.array(*map(F.lit, range(4)))).alias("copy")
    many = rows.select("*", copies).withColumn("catalog_row", F.col("catalog_row") + F.col("copy") * n).drop("copy").cache()
    said = items.select("*", copies).withColumn("entry_id", F.when(F.col("copy") > 0, F.concat_ws("#", "entry_id", "copy")).otherwise(F.col("entry_id"))).drop("copy")
    once, again = (spark.sparkContext.accumulator(0) for _ in range(2))
    pairs = lambda df: {(r["entry_id"], r["catalog_row"]): r["score"] for r in df.collect()}
    assert pairs(match.scored_pairs(items, rows, 1, once)) == pairs(match.scored_pairs(items, many, 1, again)) and 0 < again.value <= once.value
    all_pairs = pairs(match.scored_pairs(items, rows))
    assert pairs(match.scored_pairs(items, many)) == {(i, r + n * c): s for (i, r), s in all_pairs.items() for c in range(4)}
    want = ranked({(i, r + n * c): s for (i, r), s in all_pairs.items() for c in range(4)}, C.PARTIAL, 5)
    got = {}
    for r in match.suggestions(said, many).orderBy("entry_id", "rank").collect():
        got.setdefault(r["entry_id"], []).append((r["catalog_row"], r["score"]))
    assert got == {j: w for i, w in want.items() for j in (i, *(f"{i}#{c}" for c in (1, 2, 3)))}
    one = {r["entry_id"]: tuple(r)[1:] for r in match.best_match(items, rows).collect()}
    assert {r["entry_id"]: tuple(r)[1:] for r in match.best_match(said, many).collect()} == {j: w for i, w in one.items() for j in (i, *(f"{i}#{c}" for c in (1, 2, 3)))}


def test_longest_common_subsequences_of_pairs():
    rng = random.Random(8)
    texts = sorted({"".join(rng.choice("abcé 1") for _ in range(rng.choice([0, 1, 5, 30, 63, 64, 65, 128, 129, 300]))) for _ in range(60)} | {"", "a\u0000", "😀b"})
    a, b = Strings(texts), Strings(texts[::-1])
    i, j = (x.ravel() for x in np.indices((len(texts), len(texts))))
    want = [lcs_length(texts[p], texts[::-1][q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
    assert pair_lcs(a, b, i, j).tolist() == want


def test_longest_common_subsequences_in_columns(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abcé 1😀") for _ in range(rng.choice([0, 1, 5, 40, 61, 62, 63, 124, 125, 300])))
    pairs = [(text(), text()) for _ in range(60)] + [("", ""), ("a", None), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lcs_column(F.col("a"), F.col("b")).alias("n"), token_sort_ratio(F.col("a"), F.col("b")).alias("r"), sorted_ratio(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        if r["a"] is None or r["b"] is None:
            assert (r["n"], r["r"], r["s"]) == (None, None, None)
        else:
            assert r["n"] == lcs_length(r["a"], r["b"])
            assert r["r"] == pytest.approx(ratio(r["a"], r["b"]), abs=1e-9)
            assert r["s"] == pytest.approx(200.0 * r["n"] / (len(r["a"]) + len(r["b"])) if r["a"] or r["b"] else 100, abs=1e-9)


def test_reads_leave_nothing_that_reaches_the_bound():
    """Whatever a key does not read stays below its bound, for random lists."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = 4, 5
        length = rng.integers(1, m + 1, n)
        score = -np.sort(-rng.integers(1, 100, (1, n, m)).astype(float), axis=2) * (np.arange(m) < length[:, None])
        cost = rng.integers(1, 5000, (1, n, m)).astype(float) * (score > 0)
        ends = np.where(length < m, 0.0, score[:, np.arange(n), length - 1])
        bound = np.array([rng.integers(1, 350)])
        _, one, place = threshold.reads(score, cost, ends, bound)
        deep = np.bincount(one[one >= 0], minlength=n)
        left = sum(score[0, f, d] if d < length[f] else ends[0, f] for f, d in enumerate(deep.tolist()))
        assert (one < 0).any() or left < bound[0]
        assert all(sorted(place[one == f].tolist()) == list(range(d)) for f, d in enumerate(deep.tolist()))


def test_choice_of_enrichment(spark):
    cat = match.normalize_catalog(spark.createDataFrame([(1, "L1", "Brand", "blue ring", "2001", "Here", "Land", "red")], "catalog_row long, lwin string, producer_name string, wine string, vintage_config string, region string, country string, colour string"))
    items = spark.createDataFrame([("a", "brand", None, None, None, None, None), ("b", "brend", "ring", None, None, None, None), ("c", "x", None, None, None, None, None), ("d", None, "y", None, None, None, None)], ITEM)
    found = spark.createDataFrame([("a", 1, 90.0), ("b", 1, 80.0)], "entry_id string, catalog_row long, score double")
    said = spark.createDataFrame([("b", {"producer": "Said", "cuvee": None}), ("d", {"region": "There"})], "entry_id string, suggested map<string,string>")
    got = {r["entry_id"]: r for r in match.enrich_choice(items, found, said, cat).collect()}
    assert {i: r["choice"] for i, r in got.items()} == {"a": "match", "b": "suggested", "c": "none", "d": "suggested"}
    assert (got["a"]["cuvee"], got["a"]["lwin"], got["a"]["match_confidence"], got["a"]["field_confidence"]["cuvee"]) == ("blue ring", "L1", 0.9, 0.9)
    assert (got["b"]["producer"], got["b"]["cuvee"], got["b"]["lwin"], got["b"]["field_confidence"]) == ("Said", "ring", None, {"producer": 0.8})
    assert (got["d"]["region"], got["d"]["cuvee"], got["c"]["field_confidence"]) == ("There", "y", {})
