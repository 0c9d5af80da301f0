"""Values worked out by hand, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlist.functions import confidence as K
from textlist.functions import text as T
from textlist.functions.similarity import lcs_length, token_sort_ratio
from textlist.operators import match, mine, pages, rules, sample, sections, segment, tables


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "field, value, origin, base, want",
    [("vintage", "NV", "field_pattern_match", 0.8, 0.288), ("vintage", "Non-Vintage", "field_pattern_match", 0.8, 0.16), ("price", "POA", "field_pattern_match", 0.8, 0.288), ("producer", "Grand Cru House", "restaurant_rule", 1.0, 0.5), ("color", "x", "other", 1.0, 0.25)],
)
def test_field_confidence(spark, field, value, origin, base, want):
    assert one(spark, K.field_confidence(F.lit(field), F.col("v"), F.lit(origin), F.lit(base)), v=value) == pytest.approx(want)


def test_row_confidence(spark):
    assert one(spark, K.row_confidence(F.create_map(F.lit("vintage"), F.col("a"), F.lit("price"), F.lit(0.36))), a=0.32) == pytest.approx(0.58 / 1.7)
    assert one(spark, K.row_confidence(F.create_map(F.lit("unknown"), F.col("a"))), a=0.32) == 0


@pytest.mark.parametrize("text, name, ml", [("Double Magnum", "magnum", 1500), ("a 300cl bottle", "double_magnum", 3000), ("3L", "standard", 750), ("Jeroboam", "jeroboam", 3000)])
def test_bottle(spark, text, name, ml):
    got = one(spark, T.bottle(F.col("t")), t=text)
    assert (got["name"], got["ml"]) == (name, ml)


@pytest.mark.parametrize(
    "text, want",
    [("Brandy", "Br & y"), ("Saint-Émilion", "SaintÉmilion"), ("vine-\nyard", "vineyard"), ("90 €", "90€"), ("a – b", "a - b"), ("ﬁne  wine ", "fine wine"), ("L' Or", "L'Or"), ("5 $ 6 £", "5$ 6£")],
)
def test_normalize_text(spark, text, want):
    assert one(spark, T.normalize_text(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("original menu 12", False), ("Burgundy", True), ("ab", False), ("Château 1999", True), ("a plain line", False), ("special wine from italy", True)])
def test_item_lines(spark, text, want):
    assert one(spark, T.is_item(F.col("t")), t=text) is want


@pytest.mark.parametrize("text, want", [("RED WINES", 1), ("Title Case Line", 1), ("reduced", 1), ("from burgundy", 2), ("aged pinot noir", 3), ("nothing here", None)])
def test_header_level(spark, text, want):
    assert one(spark, T.header_level(F.col("t")), t=text) == want


def test_dates(spark):
    assert str(one(spark, T.date_in_filename(F.col("t")), t="x_2023-13-45_20240229.pdf")) == "2024-02-29"
    assert one(spark, T.date_in_filename(F.col("t")), t="20240230") is None


def lines(spark, *texts, file="f"):
    return spark.createDataFrame([(file, "r", 1, i, t) for i, t in enumerate(texts)], "file_id string, restaurant_id string, page int, line_no int, text string")


def test_segments_echo_the_head(spark):
    df = lines(spark, "lost line", "Domaine A 2010 50€", "(old vines)", "1999 Wine B 20")
    got = [r["raw_text"] for r in segment.segment_entries(df).orderBy("entry_no").collect()]
    assert got == ["Domaine A 2010 50€ Domaine A 2010 50€ (old vines)", "1999 Wine B 20"]
    got = [r["raw_text"] for r in segment.segment_entries(df, echo_head=False).orderBy("entry_no").collect()]
    assert got == ["Domaine A 2010 50€ (old vines)", "1999 Wine B 20"]


def test_sections_reset_below(spark):
    df = sections.with_sections(lines(spark, "from burgundy", "RED WINES", "from italy", "aged merlot", "x 1", "from germany", "WHITE"))
    got = [(r["section"], r["sub_section"], r["sub_sub_section"]) for r in df.orderBy("line_no").collect()]
    assert got == [(None, "from burgundy", None), ("RED WINES", None, None), ("RED WINES", "from italy", None), ("RED WINES", "from italy", "aged merlot"), ("RED WINES", "from italy", "aged merlot"), ("RED WINES", "from germany", None), ("WHITE", None, None)]


def test_pages(spark):
    df = lines(spark, "Table of contents", "Reds .... 3", "Reds - 4", "Whites 9x")
    assert [tuple(r) for r in pages.contents_mapping(df).collect()] == [("f", "Reds", 4)]
    assert pages.non_content_pages(lines(spark, "12", "13")).count() == 1
    assert pages.non_content_pages(lines(spark, "a long enough line", "another line here")).count() == 0


def test_later_weaker_rules_win(spark):
    df = spark.createDataFrame([("e", "f", "r", "Domaine Ring Loire 2015 90€")], "entry_id string, file_id string, restaurant_id string, raw_text string")
    got = rules.extract_fields(df).first()
    assert got["fields"]["vintage"] == "2015" and got["provenance"]["vintage"] == "field_pattern_match"
    assert got["fields"]["price"] == "201"
    assert got["field_confidence"]["vintage"] == pytest.approx(0.32)


def test_owner_rules_and_quarantine(spark):
    df = spark.createDataFrame([("e", "f", "r", "Bin 7 Foo 90"), ("g", "f", "s", "Bin 7 Foo 90")], "entry_id string, file_id string, restaurant_id string, raw_text string")
    given = spark.createDataFrame([("r", 0, r"(?P<producer>Foo)", 1.0, ["producer"], None), ("r", 1, "(?P<x", 1.0, ["x"], None)], "restaurant_id string, rule_pos int, pattern string, confidence double, fields array<string>, provenance string")
    got = {r["entry_id"]: r["provenance"].get("producer") for r in rules.extract_fields(df, given).collect()}
    assert got == {"e": "restaurant_rule", "g": None}
    assert rules.check_rules(given).where("not valid").count() == 1


def test_context_is_inherited_when_weak(spark):
    df = spark.createDataFrame([("e", "f", "r", "plain", "Rhône", "Syrah")], "entry_id string, file_id string, restaurant_id string, raw_text string, section_header string, sub_section string")
    got = rules.extract_fields(df).first()
    assert {f: got["fields"][f] for f in ("region", "country", "type", "subregion", "grape_variety")} == {"region": "Rhône", "country": "Rhône", "type": "Rhône", "subregion": "Syrah", "grape_variety": "Syrah"}


CATALOG = "catalog_row long, producer_name string, wine string, vintage_config string, region string, country string, colour string"


def test_matches(spark):
    cat = match.normalize_catalog(spark.createDataFrame([(1, "Brand 12", "blue ring", "2001", "X", "Y", "red"), (2, "Brand 12", "blue ring", "2002", "X", "Y", "red")], CATALOG))
    items = spark.createDataFrame([("a", "Brand 12", '"Blue ring"', None, None, None, None), ("b", "brand 12 & sons", "ring blue", "2002", None, None, None), ("c", None, None, None, None, None, None), ("d", "zzz", "qqq", None, None, None, None)], "entry_id string, producer string, cuvee string, vintage string, region string, country string, grape_variety string")
    got = {r["entry_id"]: (r["catalog_row"], r["provenance"]) for r in match.best_match(match.normalize_items(items), cat).collect()}
    assert got == {"a": (1, "direct"), "b": (2, "direct"), "c": (None, None), "d": (None, None)} or got["b"] == (2, "fuzzy")
    assert got["b"][0] == 2 and got["a"] == (1, "direct") and got["c"] == (None, None) == got["d"]


def test_length_pairs_lose_no_match(spark):
    cat = match.normalize_catalog(spark.createDataFrame([(i, f"house {i}", "x" * (i % 9), None, "r", "c", "red") for i in range(40)], CATALOG))
    items = match.normalize_items(spark.createDataFrame([(str(i), f"house {i % 50}", "x" * (i % 5), None, None, None, None) for i in range(40)], "entry_id string, producer string, cuvee string, vintage string, region string, country string, grape_variety string"))
    got = {r["entry_id"]: (r["catalog_row"], round(r["score"], 6)) for r in match.composite_match(items, cat).collect()}
    want = {}
    for i in items.collect():
        a = " ".join(sorted(" ".join(filter(None, (i["producer_n"], i["cuvee_n"]))).split()))
        best = max(((200 * lcs_length(a, b) / (len(a) + len(b)), -c["catalog_row"]) for c in cat.collect() for b in [" ".join(sorted(c["composite_key"].split()))]), default=(0, 0))
        if best[0] >= 70:
            want[i["entry_id"]] = (-best[1], round(best[0], 6))
    assert got == want


def test_white_space_inside_fields_loses_no_match(spark):
    cat = match.normalize_catalog(spark.createDataFrame([(1, "c a", "d", "2001", "X", "Y", "red")], CATALOG))
    items = match.normalize_items(spark.createDataFrame([("a", "a" + " " * 12 + "c", None, None, None, None, None)], "entry_id string, producer string, cuvee string, vintage string, region string, country string, grape_variety string"))
    wide = items.withColumn("producer_n", F.lit("a" + " " * 12 + "c"))  # however it was normalised
    got = [(r["entry_id"], r["catalog_row"], r["score"]) for r in match.scored_pairs(wide, cat).collect()]
    assert got == [("a", 1, 100.0)]


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs_length(a, b) == table[-1][-1] == lcs_length(b, a)


def test_ratio_of_permuted_tokens(spark):
    assert one(spark, token_sort_ratio(F.col("a"), F.lit("ring blue old")), a="old blue  ring") == 100


def test_mined_rules_match_their_texts(spark):
    df = spark.createDataFrame([("f", 1, "Domaine A. Ring 2001 90€", "Domaine A.", "Ring", 90.0, 2), ("f", 2, "nothing", None, None, None, 0)], "file_id string, rank int, text string, producer_name string, wine string, score double, n_fields int")
    got = [(r["rule_pos"], r["pattern"]) for r in mine.mine_rules(df).orderBy("rule_pos").collect()]
    assert [p for p, _ in got] == [4, 5, 6, 7] and got[2][1] == "(?P<price>200)"
    assert {tuple(r) for r in mine.mine_aliases(df).select("field", "alias", "name").collect()} == {("producer", "domaine a.", "Domaine A."), ("cuvee", "ring", "Ring")}


def test_samples(spark):
    df = spark.createDataFrame([("f", str(i), i / 10, 1, i) for i in range(8)], "file_id string, entry_id string, row_confidence double, page int, line_no int")
    assert [r["entry_id"] for r in sample.both_ends(df).orderBy("part", "rank").collect()] == ["0", "1", "2", "3", "4", "6", "7"]
    assert sample.random_pick(df, 3).collect() == sample.random_pick(df.repartition(3), 3).collect()


def test_patch_with_nothing_changes_nothing(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "id string, v string")
    patches = spark.createDataFrame([("a", {}), ("z", {"v": "q"})], "id string, changes map<string,string>")
    assert sorted(map(tuple, tables.patch_rows(df, patches, "id", ["v"]).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    nulled = tables.patch_rows(df, spark.createDataFrame([("a", {"v": None})], "id string, changes map<string,string>"), "id", ["v"])
    assert {tuple(r) for r in nulled.collect()} == {("a", None), ("b", None)}
