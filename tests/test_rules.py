"""Rules in another dialect, and which of them are tried."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textlist.operators import rules
from textlist.operators.dialect import translated

RULE = "restaurant_id string, rule_pos int, pattern string, confidence double, fields array<string>, provenance string"

#: Patterns that both dialects accept or read in different ways, with texts that show it.
ODD = [
    (r"(?P<a>abc) (?P=a)", ["abc abc", "abc abd"]),
    (r"(?P<a>abc)(?(1) abc|x)", ["abc abc", "abcx"]),
    (r"(?P<b>x)?(?P<a>y)(?(b)z|w)", ["xyz", "yw", "yz", "xyw"]),
    (r"(?P<a>[[a]bc)", ["[bc", "abc", "xbc"]),
    (r"(?P<a>a)(?#note)bc", ["abc", "a(?#note)bc"]),
    (r"(?P<a>[a&&b]c)", ["bc", "&c", "ac"]),
    (r"[(?P<a>b]", ["b", "a", "("]),
    (r"(?x) (?P<a> a \d ) # digits", ["a1", "a 1"]),
    (r"(?P<a>.+)$", ["one\rtwo\n", " x", "a\nb"]),
    (r"(?P<a>\d+)\s*€", ["12 €", "١٢ €", "x€"]),
    (r"(?i)(?P<a>CHÂTEAU) (?P<b>\w+)", ["château été", "Château x"]),
    (r"(?P<a>[^\W\d]+)", ["_é1", "12"]),
    (r"(?P<a>[^\s,]+),", ["ab, c", " ,"]),
    (r"\b(?P<a>é\w*)\b", ["xé éa", "é"]),
    (r"(?m)^(?P<a>b+)$", ["a\nbb\nc", "bb\n"]),
    (r"(?P<a>a++)b", ["aab", "aa"]),
    (r"(?P<a>(?>a|ab))c", ["abc", "ac"]),
    (r"(?P<a>a{2,3}?)", ["aaaa", "a"]),
    (r"(?<=x)(?P<a>y)(?!z)", ["xy", "xyz", "y"]),
    (r"(?P<a>a|b|)(?P<b>c)", ["ac", "c", "bc"]),
    (r"(?s)(?P<a>a.b)", ["a\nb"]),
    (r"(?a)(?P<a>\w+)", ["éab"]),
    (r"(?P<a>(?i:k)z)", ["Kz", "KZ"]),
    (r"(?P<a>[\]\-^\\]+)", ["^-]\\"]),
    (r"(?P<a>[^^]x)", ["^x", "bx"]),
]
BROKEN = [r"(?P<a>[", r"(?P<a>x)(?P<a>y)", r"*a", r"(?P=b)", r"(?<=a+)b", None]


def given(spark, patterns):
    return spark.createDataFrame([("1", i, p, 0.9, ["a", "b"], None) for i, p in enumerate(patterns)], RULE)


def test_odd_patterns_find_what_python_finds(spark):
    cases = [(str(i), p, t) for i, (p, texts) in enumerate(ODD) for t in texts]
    checked = rules.check_rules(given(spark, [p for p, _ in ODD]))
    assert checked.where("not valid").count() == 0
    rows = spark.createDataFrame(cases, "n string, pattern string, text string").join(checked.select("pattern", "java_pattern", "groups"), "pattern")
    got = rows.select("pattern", "text", *[F.expr(f"if(map_contains_key(groups, '{g}'), regexp_extract(text, java_pattern, groups['{g}']), '')").alias(g) for g in "ab"], F.expr("text rlike java_pattern").alias("hit"))
    for r in got.collect():
        found = re.search(r["pattern"], r["text"])
        want = [found.groupdict().get(g) or "" if found else "" for g in "ab"]
        assert ([r["a"], r["b"]], r["hit"]) == (want, bool(found)), (r["pattern"], r["text"])


def test_broken_patterns_are_put_aside(spark):
    checked = rules.check_rules(given(spark, BROKEN)).collect()
    assert [r["valid"] for r in checked] == [False] * len(BROKEN)
    texts = spark.createDataFrame([("e", "1", "abc bc")], "entry_id string, restaurant_id string, raw_text string")
    assert rules.extract_fields(texts, given(spark, BROKEN)).count() == 1


def test_patterns_that_only_the_other_dialect_refuses(spark):
    """Python takes them; whatever Java cannot compile is put aside as well, and no job stops."""
    wide = given(spark, ["(?P<a>x{1,4000000000})", "(?P<a>" + "(" * 90 + "x" + ")" * 90 + ")", "(?P<a>" + "|".join("abc" + str(i) for i in range(3000)) + ")"])
    texts = spark.createDataFrame([("e", "1", "xxx abc7")], "entry_id string, restaurant_id string, raw_text string")
    assert rules.check_rules(wide).where("not valid").count() == 1
    assert rules.extract_fields(texts, wide).count() == 1


@pytest.mark.parametrize("seed", range(5))
def test_needed_literals_stand_in_every_match(seed):
    rng = random.Random(seed)
    atoms = ["a", "b", "cd", r"\d", "(?:ab|c)", "(?P<{}>ab?)", "a+", "(?:bc)*", "[ab]", "(?=a)", "^", "x{2}"]
    for _ in range(200):
        pattern = "".join(rng.choice(atoms).replace("{}", f"g{i}") for i in range(rng.randrange(1, 6)))
        needs = translated(pattern).needs
        for _ in range(30):
            text = "".join(rng.choice("abcdx1") for _ in range(rng.randrange(9)))
            if re.search(pattern, text):
                assert not needs or any(n in text for n in needs), (pattern, text, needs)


def test_only_named_rules_are_tried(spark):
    """The same values as by trying every rule on every entry, with few tries for each entry."""
    patterns = [f"(?P<a>house{i} [a-z]+)" for i in range(200)] + [r"(?P<b>\d{4})"]
    entries = spark.createDataFrame([(f"e{i}", "1" if i % 3 else "2", f"house{i} red {1900 + i}") for i in range(60)], "entry_id string, restaurant_id string, text string")
    some = rules.check_rules(given(spark, patterns)).withColumn("owner", F.col("restaurant_id"))
    tries = rules.tried(entries.select(F.col("restaurant_id").alias("owner"), F.col("entry_id").alias("text_id"), "text"), some).collect()
    own = [e for e in entries.collect() if e["restaurant_id"] == "1"]
    assert len(tries) < 5 * len(own)
    got = {r["entry_id"]: {f: s["value"] for f, s in r["owner"].items()} for r in rules.owner_candidates(entries, given(spark, patterns), "restaurant_id").collect()}
    for e in own:
        want = {}
        for p in patterns:
            found = re.search(p, e["text"])
            want.update({k: v for k, v in (found.groupdict() if found else {}).items() if v})
        assert got[e["entry_id"]] == want
    assert len(got) == len(own)


def test_rules_without_texts_and_texts_without_rules(spark):
    none = given(spark, [])
    texts = spark.createDataFrame([("e", "1", "abc"), ("f", None, "abc"), ("g", "1", None)], "entry_id string, restaurant_id string, raw_text string")
    assert rules.extract_fields(texts, none).count() == 3
    assert rules.extract_fields(texts.where("false"), given(spark, ["(?P<a>a)"])).count() == 0
    assert rules.extract_fields(texts, given(spark, ["(?P<producer>abc)"]).withColumn("fields", F.array(F.lit("producer")))).where("fields['producer'] = 'abc'").count() == 1


def test_patterns_run_once_for_each_text(spark):
    """Rows that repeat three texts and a null: four rows go through the patterns, and each row gets what its text and its own heading give."""
    said = ["Domaine Ring Loire 1999  90€", 'Pinot Noir "Bolt", Old Estate, Loire 2003 12 €', "nothing here", None]
    data = [(f"e{k}", "f", "r", said[k % 4], "old head", f"sub {k % 3}" if k % 3 else None) for k in range(60)]
    entries = spark.createDataFrame(data, "entry_id string, file_id string, restaurant_id string, raw_text string, text string, sub_section string")
    assert rules.said_of(entries).count() == 4
    got = {r["entry_id"]: r for r in rules.extract_fields(entries).collect()}
    assert len(got) == 60
    for i, _, _, raw, _, sub in data:
        r = got[i]
        alone = got[f"e{said.index(raw)}"]  # e0: no heading, others: their own
        own = {f: v for f, v in r["fields"].items() if f not in ("subregion", "grape_variety")}
        assert own == {f: v for f, v in alone["fields"].items() if f not in ("subregion", "grape_variety")}
        assert (r["text"] is None) == (raw is None) and r["fields"].get("subregion") == sub
    assert got["e0"]["fields"]["vintage"] == "1999" and got["e3"]["fields"] == {}


def test_owners_that_share_a_bucket_keep_their_rules(spark):
    """600 owners in 64 buckets a task: each text meets its own owner's rules only; rules and texts without an owner meet nothing."""
    owners = [f"o{k}" for k in range(600)] + [None]
    made = rules.check_rules(spark.createDataFrame([(o, p, f"(?P<cuvee>w{k % 5}{p})") for k, o in enumerate(owners) for p in (0, 1)], "owner string, rule_pos int, pattern string"))
    texts = spark.createDataFrame([(o, f"t{k}", f"w{k % 5}1 w{(k + 1) % 5}0") for k, o in enumerate(owners)], "owner string, text_id string, text string")
    got = sorted((r["owner"], r["text_id"], r["rule_pos"]) for r in rules.tried(texts, made).collect())
    assert got == sorted((o, f"t{k}", 1) for k, o in enumerate(owners) if o)
    words, always = rules.automaton([(0, ["ab"]), (1, []), (2, ["b", "ab"])])
    assert always == [1] and sorted(i for _, own in words.iter("ab") for i in own) == [0, 2, 2]
