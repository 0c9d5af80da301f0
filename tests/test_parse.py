"""The multi-stage parse and its refinement data against a plain Python parse."""

import re

import pytest

from textlist import constants as C
from textlist.operators import rules
from textlist.plans import pipeline

ENTRY = "entry_id string, file_id string, restaurant_id string, page int, line_no int, raw_text string, section string, sub_section string, n_lines int"
CATALOG = "catalog_row long, lwin string, producer_name string, wine string, vintage_config string, region string, country string, colour string"
NAMES = [("Rosenberg Brothers Winery", "Bolt of the Old Mountain"), ("Hill House of Marlow", "Blue Ring of the Valley"), ("Stone Gate Vineyards", "Late Autumn Selection")]


def valid(field, value):
    size = len(value)
    checks = {
        "vintage": re.match(C.VINTAGE_VALUE, value), "price": re.match(C.PRICE_VALUE, value), "bottle_size": re.match(C.SIZE_VALUE, value), "country": 2 <= size <= 50, "region": 2 <= size <= 100,
        "producer": 2 <= size <= 100 and not any(w in value.lower() for w in C.RANK_WORDS), "cuvee": 1 <= size <= 100,
    }
    return bool(checks.get(field, True))


def confidence(field, value, origin, base):
    special = 0.9 if field == "vintage" and value.upper() in ("NV", "N.V.") else 0.8 if field == "price" and value.upper() == "POA" else 1.0
    return min(1.0, base * C.ORIGIN_FACTORS.get(origin, C.OTHER_ORIGIN) * (1.0 if valid(field, value) else 0.5) * special * C.FIELD_WEIGHTS.get(field, 0.5))


def parse(text, own, sub_section):
    """Values with their confidences, and the row's."""
    state = {}
    for pattern, base, fields, origin in own:
        try:
            found = re.search(pattern, text)
        except re.error:
            continue
        for f in fields if found else []:
            if found.groupdict().get(f):
                state[f] = (found.group(f), confidence(f, found.group(f), origin or "restaurant_rule", base))

    def offer(f, value, base, score):
        if value and (f not in state or state[f][1] < base):
            state[f] = (value, score)

    for pattern, base, fields in C.ENTRY_RULES:
        found = re.search(pattern, text)
        for f, value in zip(fields, found.groups(), strict=True) if found else []:
            offer(f, value, base, value and confidence(f, value, "global_rule", base))
    for f, pattern, base in C.FIELD_RULES:
        found = re.search(pattern, text)
        if found and found.group(1):
            offer(f, found.group(1), base, confidence(f, found.group(1), "field_pattern_match", base))
    for f in ("subregion", "grape_variety") if sub_section else ():
        offer(f, sub_section, 0.7, 0.7)
    whole = sum(C.FIELD_WEIGHTS[f] for f in C.FIELD_WEIGHTS if f in state)
    return {f: v for f, (v, _) in state.items()}, sum(state[f][1] * w for f, w in C.FIELD_WEIGHTS.items() if f in state) / whole if whole else 0.0


def ends(parsed):
    """The five lowest rows, and the two highest of more than six."""
    order = sorted(parsed, key=lambda e: (parsed[e][1], int(e.split("-")[1])))
    return order[:5] + [e for e in (order[-2:] if len(order) > 6 else []) if e not in order[:5]], order


@pytest.fixture(scope="module")
def parts(spark):
    texts = [f'Pinot Noir "{w}", {p}, Loire {2001 + i} {90 + i} €' for i, (p, w) in enumerate(NAMES)]
    texts += ["Domaine Hill Loire 1999 45 €", "Magnum Riserva DOCG Ring N.V. POA", "Pinot Noir 2004", "Brut Merlot 12,50 €", "nothing at all", "Rosenberg Brothers Winery Bolt of the Old Mountain 77"]
    rows = [(f"{f}-{i}", f, owner, 1, i, t, "RED", "from burgundy" if i % 2 else None, 1) for f, owner, count in (("a", "1", 9), ("b", "2", 9), ("c", "2", 4)) for i, t in enumerate(texts[:count])]
    stored = [("1", 0, r"(?P<vintage>19\d{2}|20\d{2}) +(?P<price>[0-9]{2,4})", 0.9, ["vintage", "price"], None), ("1", 1, "(?P<cuvee>[", 0.9, ["cuvee"], None), ("1", 2, r"(?P<producer>Hill House|Domaine [A-Z][a-z]+)", 0.95, ["producer", "cuvee"], "lwin_match")]
    catalog = [(i, f"L{i}", p, w, str(2001 + i), "Loire", "France", "red") for i, (p, w) in enumerate(NAMES[:2])]
    said = [("nothing at all", {"producer": "Said", "cuvee": None})]
    entries = spark.createDataFrame(rows, ENTRY)
    out = pipeline.refinement(entries, spark.createDataFrame(stored, "restaurant_id string, rule_pos int, pattern string, confidence double, fields array<string>, provenance string"), spark.createDataFrame(catalog, CATALOG), spark.createDataFrame(said, "raw_text string, suggested map<string,string>"))
    return rows, stored, {n: df.collect() for n, df in out.items()}


def test_every_stage_against_a_plain_parse(parts):
    rows, stored, got = parts
    text = {r["entry_id"]: r["text"] for r in got["final_parse"]}
    assert {i: (r["fields"], pytest.approx(r["row_confidence"])) for i, r in ((r["entry_id"], r) for r in got["initial_parse"])} == {r[0]: parse(text[r[0]], [], r[7]) for r in rows if r[1] != "a"}
    mined = {f: [(r["pattern"], r["confidence"], r["fields"], r["provenance"]) for r in sorted(got["restaurant_rules"], key=lambda r: r["rule_pos"]) if r["file_id"] == f] for f in "bc"}
    own = {"a": [r[2:] for r in stored], **mined}
    want = {r[0]: parse(text[r[0]], own[r[1]], r[7]) for r in rows}
    assert {r["entry_id"]: (r["fields"], pytest.approx(r["row_confidence"])) for r in got["final_parse"]} == want
    assert {r["entry_id"] for r in got["needs_review"]} == {e for e, (_, c) in want.items() if c < C.REVIEW_BELOW}
    assert {(r["file_id"], r["state"]) for r in got["stage"]} == {("a", "rules_exist"), ("b", "multi_stage"), ("c", "multi_stage")}


def test_mined_rules_of_samples_that_name_catalogue_rows(parts):
    rows, _, got = parts
    text = {r["entry_id"]: r["text"] for r in got["final_parse"]}
    first = {f: {r[0]: parse(text[r[0]], [], r[7]) for r in rows if r[1] == f} for f in "bc"}
    for f, parsed in first.items():
        sample, order = ends(parsed)
        want = []
        for e in sample:
            fields = parsed[e][0]
            rank = order.index(e) + 1
            if not fields:
                continue
            if fields.get("producer") in [p for p, _ in NAMES[:2]]:
                p, w = next(n for n in NAMES if n[0] == fields["producer"])
                p, w = (re.sub(r"(\W)", r"\\\1", x) for x in (p, w))
                want += [(rank * 4, rf"(?P<producer>{p})\s+(?P<cuvee>{w})"), (rank * 4 + 1, rf"(?P<producer>{p})(?:\s+[A-Za-z]+)*\s+(?P<cuvee>{w})")]
            for k, name, pattern in ((2, "price", C.PRICE), (3, "vintage", rf"{C.VINTAGE}|N\.V\.")):
                found = re.search(pattern, text[e])
                if found:
                    want.append((rank * 4 + k, f"(?P<{name}>" + re.sub(r"(\W)", r"\\\1", found.group(0)) + ")"))
        assert sorted((r["rule_pos"], r["pattern"]) for r in got["restaurant_rules"] if r["file_id"] == f) == sorted(want)
    assert any(r["provenance"] == "lwin_match" and r["file_id"] for r in got["restaurant_rules"])


def test_samples_are_enriched(parts):
    rows, _, got = parts
    text = {r["entry_id"]: r["text"] for r in got["final_parse"]}
    sample = {e for f in "bc" for e in ends({r[0]: parse(text[r[0]], [], r[7]) for r in rows if r[1] == f})[0]}
    found = {r["entry_id"]: r for r in got["enriched_sample"]}
    assert found.keys() == sample
    chosen = {e: r["choice"] for e, r in found.items()}
    assert chosen["b-7"] == "suggested" and (found["b-7"]["producer"], found["b-7"]["field_confidence"]["producer"]) == ("Said", 0.8)
    for e in ("c-0", "c-1"):
        assert chosen[e] == "match" and found[e]["lwin"] == f"L{e[-1]}" and found[e]["country"] == "France" and found[e]["match_confidence"] >= 0.85
    assert all(c == "none" for e, c in chosen.items() if e not in ("b-7", "c-0", "c-1", "b-0", "b-1"))


def test_a_row_keeps_its_text(spark):
    assert rules.extract_fields(spark.createDataFrame([("x", "Pinot Noir 2004")], "entry_id string, raw_text string")).first()["text"] == "Pinot Noir 2004"
