"""Classifiers, licenses, pages, media and mixing."""

import difflib
import hashlib
import textwrap
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from textlist.llm import flac, html_extract, license_scan, line_dedup, media, mixing, queries, quality, toxicity
from textlist.llm.common import read_table


def table(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert got == sorted(want)


def noisy(n):
    rng = np.random.default_rng(0)
    docs, labels = [(None, "text"), (-1, None), (-2, "")], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 1
        said = [str(rng.choice(["alpha", "beta", "gamma", "delta"])) + str(rng.choice(["", "s", "ed"])) for _ in range(30)]
        if toxic:
            said[3] = "vile" + str(rng.choice(["", "ness", "ly"]))
        docs.append((i, " ".join(w.upper() + "!!" if bad else w for w in said)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.mark.parametrize("op, label", [(toxicity.toxicity, 2), (quality.quality, 1)])
def test_classifier(spark, op, label):
    docs, labels = noisy(300)
    lab = table(spark, labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in op(table(spark, docs), lab).collect()}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got.values())
    truth = {r[0]: r[label] for r in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.9
    assert op(table(spark, []), lab).count() == 0
    none = op(table(spark, docs[:3]), table(spark, [], "doc_id long, quality int, toxic int")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_learns_from_every_labelled_row(spark):
    """Over 3000 rows of each class; a kind of bad text that only the last rows by md5 have is learnt from them."""
    ids = sorted(range(9000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0}
    bad = [i for i in ids if i % 2 and i not in held]
    late = set(bad[3000:]) | {i for i in held if i % 4 == 1}
    rng = np.random.default_rng(0)
    said = {i: [str(w) for w in rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 12)] for i in ids}
    docs = [(i, " ".join(w + ("" if i % 2 == 0 else "7" if i in late else "!") for w in said[i])) for i in ids]
    lab = table(spark, [(i, int(i % 2 == 0)) for i in ids], "doc_id long, quality int")
    assert len(bad) > 3400
    got = {r["doc_id"]: r["predicted"] for r in quality.quality(table(spark, docs), lab).where("held_out").collect()}
    assert set(got) == held
    assert np.mean([got[i] == 0 for i in held & late]) > 0.9 and np.mean([got[i] == (i % 2 == 0) for i in held]) > 0.9


def test_quality_learns_from_very_long_texts(spark):
    docs, labels = noisy(60)
    docs = [(i, t and (t + " ") * 700) for i, t in docs]
    assert min(len(t) for i, t in docs if (i or -1) >= 0) > 100_000
    got = {r["doc_id"]: r for r in quality.quality(table(spark, docs), table(spark, labels, "doc_id long, quality int, toxic int")).collect()}
    right = [got[i]["predicted"] == good for i, good, _ in labels]
    assert len({got[i]["score"] for i, _, _ in labels}) > 1 and np.mean(right) > 0.9


def test_pairs_of_nodes_are_all_pairs(spark):
    """Weights and threshold against Newton steps over every pair and a plain quantile, whatever the partitions."""
    rng = np.random.default_rng(1)
    y = (rng.random(230) < 0.7).astype(int)
    x = rng.normal(0, 1, (230, quality.N_FEATURES)) + 0.4 * y[:, None] * (np.arange(quality.N_FEATURES) % 3 == 0)
    x[:, 7] = 3.0
    rows = table(spark, [(int(a), b.tolist()) for a, b in zip(y, x, strict=True)], "y long, x array<double>")
    fits = [quality.fit_pairs(rows.repartition(parts, "x"))[0] for parts in (1, 7)]
    assert all(np.array_equal(a, b) for a, b in zip(*fits, strict=True))
    mean, scale, w = fits[0]
    assert np.allclose(mean, x.mean(0), atol=1e-8) and np.allclose(scale, x.std(0) + 1e-3, atol=1e-5)
    z = np.clip((x - mean) / scale, -6, 6)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, quality.N_FEATURES)
    each, want = 24 / y.sum(), np.zeros(quality.N_FEATURES)
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ want))
        want -= np.linalg.solve((d * (each * p * (1 - p))[:, None]).T @ d + 2 * np.eye(len(want)), 2 * want - each * d.T @ p)
    assert np.allclose(w, want, atol=1e-5) and np.abs(want).max() > 0.1
    s = np.r_[np.round(z @ w, 9), np.full(50, 0.25), 1e6]
    of = np.r_[y, np.zeros(51, int)]
    scored = table(spark, [(int(a), float(b)) for a, b in zip(of, s, strict=True)], "y long, z double")
    order = np.argsort(s, kind="stable")
    for share in (0.0, 0.1, 0.4, 0.9, 1.0):
        below = np.cumsum(np.where(of[order] == 1, 0.5, 2.0))
        assert quality.quantile(scored, (2.0, 0.5), share) == s[order][np.searchsorted(below, share * below[-1])]


def test_keep_good_keeps_columns(spark):
    docs, labels = noisy(300)
    rows = table(spark, [(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    kept = quality.keep_good(rows, table(spark, labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == ["doc_id", "text", "score"]
    assert 0 < kept.count() < len(docs)


def test_licenses(spark):
    docs = [
        (0, None), (1, ""), (2, "No claims here."), (3, "Intro.\nReleased under the MIT License.\nMore. Licensed under the Apache License, Version 2.0."),
        (4, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this document except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
        (5, "the word license alone says nothing"),
    ]
    got = sorted((r["doc_id"], r["license"], r["version"], r["missing"], r["extra"]) for r in license_scan.license_scan(table(spark, docs)).collect())
    assert got == [(3, "Apache", "2.0", "", ""), (3, "MIT", "", "", ""), (4, "Apache", "2.0", "file", "document")]


@pytest.mark.parametrize("width", [30, 60, 80])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_licenses(width, mark):
    scanner = license_scan.Scanner()
    for name, _, wanted, _ in scanner.templates:
        text = next(t for n, t, w, _ in scanner.templates if w is wanted).replace("<version>", "2.0")
        lines = textwrap.wrap("Some lines of prose stand above. " * 30 + text + " And others below." * 30, width, break_long_words=False, break_on_hyphens=False)
        said = "\n".join(mark + x for x in lines)
        got = [m for a, b in scanner.blocks(said) for m in scanner.confirmed(said[a:b])]
        assert [(m["license"], m["missing"], m["extra"]) for m in got] == [(name, "", "")]


def test_six_reworded_licenses_in_a_block(spark):
    change = {"MIT": ("deal", "act"), "BSD": ("provided", "so"), "ISC": ("hereby", "thus"), "GPL": ("later", "newer"), "MPL": ("distributed", "shipped"), "Apache": ("compliance", "accord")}
    texts = {n: max(license_scan.TEMPLATES[n], key=len).replace("<version>", "2.0") for n in change}
    said = "\n".join(textwrap.fill(texts[n].replace(a, b, 1), 72) for n, (a, b) in change.items())
    got = [(r["license"], r["missing"], r["extra"]) for r in license_scan.license_scan(table(spark, [(1, said)])).orderBy("char_start").collect()]
    assert got == [(n, a, b) for n, (a, b) in change.items()]


def test_licenses_of_documents_are_all_found(spark, sf):
    docs = read_table(spark, sf, "documents")
    got = sorted((r["doc_id"], r["license"]) for r in license_scan.license_scan(docs).where("license <> 'Proprietary'").collect())
    plain = {"GPL": "This work is licensed under the GNU General Public License, version ", "MIT": "Released under the MIT License.", "Apache": "Licensed under the Apache License, Version ", "CC-BY-NC": "Licensed under CC BY-NC "}
    assert got == sorted((r["doc_id"], k) for r in docs.collect() for k, v in plain.items() for _ in range(r["text"].count(v)))


@pytest.mark.parametrize("name, label, caught, kept", [("op1_toxicity", "toxic", 0.85, 0.99), ("op3_quality", "quality", 0.97, 0.97)])
def test_held_out_rows(spark, name, label, caught, kept):
    """Shares of held-out rows of label 1 and of label 0 that are told right; ten thousand documents, of which the labels cover some."""
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, sf).where("held_out").join(read_table(spark, sf, "labels"), "doc_id").select(label, "predicted").collect()
    right = lambda y: np.mean([r["predicted"] == y for r in rows if r[label] == y])
    assert len(rows) > 500 and right(1) >= caught and right(0) >= kept


def test_notices_of_one_block_are_all_found(spark):
    lines = [f"This work is licensed beneath the GNU {x}General Public License, version 3." for x in ("", "Lesser ", "Affero ")]
    lines += [f"This work is licensed beneath a Creative Commons Attribution{x} 4.0 International License." for x in ("", "-ShareAlike", "-NonCommercial")]
    lines += ["Licensed beneath the Mozilla Public License, Version 2.0.", "Licensed beneath the Apache License, Version 2.0.", "This is free and unencumbered software released beneath the public domain."]
    rows = [(1, "\n".join(lines)), (1, "\n".join(lines)), (2, None), (3, ""), (4, "word " * 200_000 + lines[0])]
    got = license_scan.license_scan(table(spark, rows)).collect()
    assert sorted(r["license"] for r in got if r["doc_id"] == 1) == sorted(2 * ["GPL", "LGPL", "AGPL", "CC-BY", "CC-BY-SA", "CC-BY-NC", "MPL", "Apache", "Unlicense"])
    assert [(r["doc_id"], r["license"]) for r in got if r["doc_id"] != 1] == [(4, "GPL")]
    assert license_scan.license_scan(table(spark, [])).count() == 0


def test_reworded_templates_against_all_places():
    """Each template with a word in twelve changed, the first one among them, is found; and the scan finds a template just where an alignment at every word does."""
    scanner, rng = license_scan.Scanner(), np.random.default_rng(6)
    for name, text, wanted, _ in scanner.templates:
        said = text.replace("<version>", "2.0").split()
        for at in range(0, len(said) // 12 * 12, 12):
            said[at] = "changed"
        block = " ".join([*rng.choice(["lead", "words"], 40), *said, *rng.choice(["more", "words"], 40)])
        found = [m["license"] for a, b in scanner.blocks(block) for m in scanner.confirmed(block[a:b])]
        assert found == [name], text
        spoken = [w for w, _, _ in license_scan.word_spans(block)]
        for _, _, other, _ in scanner.templates:
            span, said = license_scan.window_size(other), ["2.0" if w.startswith("<") else w for w in other]
            anywhere = any(
                sum(m.size for m in difflib.SequenceMatcher(None, said, spoken[i : i + span], autojunk=False).get_matching_blocks()) >= 0.85 * len(other) for i in range(len(spoken)) if license_scan.may_reach(other, set(spoken[i : i + span]))
            )
            assert anywhere or not list(license_scan.places(other, spoken))


PAGE = """<html><head><title>T</title><script>if (a < b) x("</p>")</script></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><ul><li>Home</ul></nav>
<div class="post-{n}"><article class="story"><header><h1>Head&eacute;r</h1><p>by me</p></header><p>One <a href="x">link</a>
two<br>more.<p>Three &lt;b&gt; <b>four<ul><li>a<li>b</ul><form><p>name</form><aside>see also</aside></article></div>
<section class="comments"><p>Nice!</p></section><div class="ad">buy</div><footer>f</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"https://u@h.example:80/{i}", PAGE.replace("{n}", str(i))) for i in range(3)] + [(3, None, None), (4, "", ""), (5, "//h.example", "<p>cut off <b"), (6, "x", "<div><p>left &am")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.main_text(table(spark, rows, "page_id long, url string, html string")).collect()}
    want = "Headér\nOne link two more.\nThree <b> four\na\nb"
    assert got == {0: (want, len(want)), 1: (want, len(want)), 2: (want, len(want)), 3: ("", 0), 4: ("", 0), 5: ("cut off", 7), 6: ("left &am", 8)}
    assert html_extract.main_text(table(spark, [], "page_id long, url string, html string")).count() == 0


def test_pages_without_article_keep_all_but_clutter(spark):
    long = "many words of the body " * 20
    around = '<html><body><div class="menu"><a href="x">Home</a></div><div class="wrap">{}</div><div class="sidebar">ads</div></body></html>'
    bodies = {
        0: "<h1>Head</h1><p>Lead</p><div class='text'><p>{}</div><ul><li>a<li>b</ul>",
        1: "<h1><a href='x'>Head</a></h1><blockquote>{}</blockquote><p>Said so",
        2: "<p>Lead<table><tr><td>{}</table><p>End",
        3: "<h2>Head</h2><ul><li>{}</ul><div>End</div>",
        4: "<div class='text'><p>short</div><p>{}",
    }
    want = {0: ["Head", "Lead", long, "a", "b"], 1: ["Head", long, "Said so"], 2: ["Lead", long, "End"], 3: ["Head", long, "End"], 4: ["short", long]}
    rows = [(k, f"https://h{k * own}.example/", around.format(b.format(long))) for own in (0, 1) for k, b in bodies.items()]
    rows += [(9, "https://h0.example/", f"<html><body><div class='wrap'><div class='text'><p>{long}</div></div><div class='more'>End</div></body></html>")]
    got = {(r["page_id"], r["url"]): r["text"] for r in html_extract.main_text(table(spark, rows, "page_id long, url string, html string")).collect()}
    want[9] = [long, "End"]
    assert got == {(k, url): "\n".join(" ".join(x.split()) for x in want[k]) for k, url, _ in rows}


LONG = " ".join(f"word{k}" for k in range(60))
LAYOUTS = {
    '<div class="content no-sidebar"><article>{}</article></div>': True,
    '<div class="has-menu"><article>{}</article></div><ul class="menu"><li><a href="x">Home</a></ul>': True,
    '<div class="search-results-page"><main>{}</main></div><div id="site-footer">Foot</div>': True,
    '<form id="page"><div class="mainNav">Home</div><article>{}</article></form>': True,
    '<div class="post">{}</div><div class="comments"><article class="comment"><p>nice</article><article class="comment"><p>bad</article></div>': False,
    '<div class="notice">We close at six</div><div class="widget-area sidebar-left">Links</div><div class="text">{}</div>': False,
    '<div class="warning"><div class="body">{}</div></div><div class="cookie-bar">Cookies</div>': False,
}


def test_pages_of_many_layouts(spark):
    inner = f"<h1>Head</h1><p>{LONG}</p><p class='warning lead'>Mind this</p><div class='popular-science'><p>More</p></div><section class='comment-list'><p>Nice</p></section><ul class='share-buttons'><li>Send</ul><p>End <span class='ad'>Buy</span>"
    rows = [(10 * h + k, f"https://h{h * k}.example/{k}", f"<html><body>{layout.format(inner)}</body></html>") for h in (0, 1) for k, layout in enumerate(LAYOUTS)]  # one host for all, then one for each
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(table(spark, rows * 2, "page_id long, url string, html string")).collect()}
    for h in (0, 1):
        for k, article in enumerate(LAYOUTS.values()):
            want = ["Head", LONG, *["Mind this"] * article, "More", "End"]
            assert got[10 * h + k] == "\n".join(want), (h, k)


INSIDE = {
    '<h2 id="navigation">Kept</h2>': "Kept",
    '<h2 id="menu">Kept</h2>': "Kept",
    '<h3 id="cookies">Kept</h3>': "Kept",
    '<p id="footer">Kept</p>': "Kept",
    '<section id="cookies"><h2>Kept</h2><p>Bake</p></section>': "Kept\nBake",
    '<div class="cookie-recipe"><p>Kept</p></div>': "Kept",
    '<div class="ad-hoc">Kept</div>': "Kept",
    '<div class="ad-free-reading">Kept</div>': "Kept",
    '<table class="navigation"><tr><td>a<td>b</table>': "a b",
    '<figure class="banner"><figcaption>Kept</figcaption></figure>': "Kept",
    '<p class="comment">Kept</p>': "Kept",
    '<ul class="menu"><li><a href="x">Gone</a></ul>': "",
    '<table class="navigation"><tr><td><a href="x">Gone</a></table>': "",
    '<p class="ad">Gone</p>': "",
    '<section id="comments"><p>Gone</p></section>': "",
    '<div class="newsletter-box"><p>Gone</p></div>': "",
}


@pytest.mark.parametrize("part", sorted(INSIDE))
def test_names_inside_an_article(part):
    page = f"<body><nav>n</nav><article><h1>H</h1><p>{LONG}</p>{part}<p>End</p></article><footer>f</footer>"
    for paths in ([], ["body>article"]):
        assert html_extract.extract(page, paths) == "\n".join(x for x in ("H", LONG, INSIDE[part], "End") if x)


WHOLE = {
    '<div class="sidebar-layout"><div class="inner"><p>All of it</p></div></div>': "All of it",
    '<div class="menu-page"><h1>Head</h1><p>All of it</p></div>': "Head\nAll of it",
    '<div class="sidebar"><p>All of it</p></div>': "All of it",
    "<article><h1>A</h1><p>one</p></article><article><h1>B</h1><p>two and more</p></article>": "A\none\nB\ntwo and more",
    '<article class="part one"><p>1</p></article><article class="part two"><p>2</p></article>': "1\n2",
    "<main><h1>Title</h1><article><p>one</p></article></main>": "Title\none",
    "<main><h1>Title</h1><article><h1>own</h1><p>one</p></article></main>": "own\none",
    '<article><h1>A</h1><p>one</p></article><section><article><h2><a href="x">T</a></h2><p>a teaser longer than the article</p></article></section>': "A\none",
    "<footer>f</footer>": "",
}


def test_whole_pages(spark):
    rows = [(k, f"https://h{k * own}.example/", page) for own in (0, 1) for k, page in enumerate(WHOLE)]  # one host for all, then one for each
    got = html_extract.main_text(table(spark, rows, "page_id long, url string, html string")).collect()
    assert len(got) == 2 * len(WHOLE) and all(r["text"] == list(WHOLE.values())[r["page_id"]] for r in got)


def test_doubtful_names_go_by_what_the_host_says(spark):
    page = "<article><h1>Head {0}</h1><p>Text {0}</p><div class='promo-lines'><p>Join us now</p></div><div class='ad-hoc'><p>Own words {0}</p></div><p>End</p></article>"
    rows = [(k, "https://h.example/", page.format(k)) for k in range(6)] + [(6, "https://single.example/", page.format(6))]
    got = {r["page_id"]: r["text"].split("\n") for r in html_extract.main_text(table(spark, rows, "page_id long, url string, html string")).collect()}
    for k in range(7):
        assert got[k] == [f"Head {k}", f"Text {k}", *["Join us now"] * (k == 6), f"Own words {k}", "End"]


def test_very_deep_pages():
    start = time.time()
    for part in ("<div class='a'>", "<blockquote><i class='x'>", "<ul><li>", "<span class='ad'></p>"):
        text = html_extract.extract(part * 20_000 + "<p>deep text", [])
        assert text == ("" if "ad" in part else "deep text")
    assert time.time() - start < 20


def test_votes_that_tie(spark):
    rows = [(k, "https://h.example/", f"<div class='{c}'><p>{LONG} {c}</div><div class='{d}'><p>x</div>") for k, (c, d) in enumerate((("a", "b"), ("b", "a")))]
    once = html_extract.main_text(table(spark, rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert once == html_extract.main_text(table(spark, rows[::-1], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert all(LONG in r["text"] for r in once)


def streams(*rows, **options):
    data = [np.frombuffer(r, np.uint8) for r in rows]
    return flac.encode(np.concatenate(data), np.r_[0, np.cumsum([len(d) for d in data])], **options)


@pytest.mark.parametrize("options", [{}, {"linear": True}, {"linear": False}])
def test_flac_round_trip(options):
    rng = np.random.default_rng(1)
    rows = [bytes(rng.integers(0, 256, 64 * n, dtype=np.uint8)) for n in (1, 2, 3, 4, 5, 130)] + [b"\0" * 640, b"\0" * 250 + b"\xff" * 6, b"ab" * 3200]
    got = flac.decode(streams(*rows, **options))
    assert [bytes((got.samples[a:b] + 128).astype(np.uint8)) for a, b in zip(got.offsets, got.offsets[1:], strict=False)] == rows


def plain_crc(data, poly, bits):
    c = 0
    for byte in data:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return c


def ordinary_stream(channels, depth, block, layout=None, wasted=0, seek=False):
    """A stream as other programs write it, bit by bit: verbatim, fixed and linear subframes in turn, four Rice partitions, an escaped one."""
    n, body = len(channels[0]), b""
    for number, at in enumerate(range(0, n, block)):
        cut = [c[at : at + block] for c in channels]
        m = len(cut[0])
        head = bytes([0xFF, 0xF8, 0x70, ((len(channels) - 1) if layout is None else layout) << 4]) + chr(number).encode() + (m - 1).to_bytes(2)
        bits = "".join(f"{b:08b}" for b in head + bytes([plain_crc(head, 7, 8)]))
        if layout is not None:
            a, b = cut
            cut = {8: [a, [x - y for x, y in zip(a, b)]], 9: [[x - y for x, y in zip(a, b)], b], 10: [[(x + y) >> 1 for x, y in zip(a, b)], [x - y for x, y in zip(a, b)]]}[layout]  # noqa: B905
        for c, x in enumerate(cut):
            wide = depth + (layout in (8, 10) and c == 1 or layout == 9 and c == 0) - wasted
            x = [v >> wasted for v in x]
            raw = lambda v, w: f"{v & ((1 << w) - 1):0{w}b}"
            kind = (number + c) % 3 if m % 4 == 0 else 0
            bits += "0" + f"{(1, 10, 33)[kind]:06b}" + ("1" + "0" * (wasted - 1) + "1" if wasted else "0")
            if kind == 0:
                bits += "".join(raw(v, wide) for v in x)
                continue
            rest = [x[i] - (2 * x[i - 1] - x[i - 2] if kind == 1 else (7 * x[i - 1] - 3 * x[i - 2]) >> 2) for i in range(2, m)]
            bits += raw(x[0], wide) + raw(x[1], wide) + ("" if kind == 1 else raw(5, 4) + raw(2, 5) + raw(7, 6) + raw(-3, 6)) + "01" + raw(2, 4)
            for part in range(4):
                own = rest[max(0, part * m // 4 - 2) : (part + 1) * m // 4 - 2]
                folded = [2 * v if v >= 0 else -2 * v - 1 for v in own]
                if part == 2:
                    w = max((v.bit_length() + 1 for v in own), default=1)
                    bits += raw(31, 5) + raw(w, 5) + "".join(raw(v, w) for v in own)
                else:
                    k = max(0, max(folded, default=0).bit_length() - 3)
                    bits += raw(k, 5) + "".join("0" * (v >> k) + "1" + (raw(v, k) if k else "") for v in folded)
        bits += "0" * (-len(bits) % 8)
        frame = int(bits, 2).to_bytes(len(bits) // 8)
        body += frame + plain_crc(frame, 0x8005, 16).to_bytes(2)
    flat = b"".join(v.to_bytes(-(-depth // 8), "little", signed=True) for row in zip(*channels, strict=True) for v in row)
    info = block.to_bytes(2) * 2 + bytes(6) + ((44100 << 44) | (len(channels) - 1 << 41) | (depth - 1 << 36) | n).to_bytes(8) + hashlib.md5(flat).digest()
    tables = b"\x03" + (18).to_bytes(3) + bytes(16) + block.to_bytes(2) if seek else b""
    return b"fLaC\x00" + (34).to_bytes(3) + info + tables + b"\x84" + (4).to_bytes(3) + b"note" + body


@pytest.mark.parametrize("depth, count, layout, wasted", [(8, 1, None, 0), (16, 2, None, 0), (16, 2, 8, 0), (16, 2, 9, 0), (24, 2, 10, 0), (12, 3, None, 2), (20, 8, None, 0), (16, 1, None, 5)])
def test_flac_of_other_programs(spark, depth, count, layout, wasted):
    rng = np.random.default_rng(depth + count)
    top = 1 << (depth - 1)
    channels = [[int(v) >> wasted << wasted for v in np.clip(np.cumsum(rng.integers(-top // 50 - 2, top // 50 + 3, 500)), -top, top - 1)] for _ in range(count)]
    channels[0][100:140] = [-top] * 20 + [top - (1 << wasted)] * 20
    made = [ordinary_stream(channels, depth, 192, layout, wasted, seek) for seek in (False, True)]
    got = flac.decode(made)
    want = np.array(channels).T.ravel()
    assert np.array_equal(got.samples, np.r_[want, want]) and got.channels.tolist() == [count] * 2 and got.sample[:3].tolist() == [0, 192, 384]
    rows = media.pcm_blocks(spark.createDataFrame([(1, bytearray(made[0])), (2, None), (3, bytearray(made[0][:-9])), (4, bytearray(b"no"))], "doc_id long, media binary"), on_error="skip").orderBy("block").collect()
    size = -(-depth // 8)
    assert b"".join(r["pcm"] for r in rows) == b"".join(int(v).to_bytes(size, "little", signed=True) for v in want)
    assert [(r["doc_id"], r["sample_offset"], r["n_samples"], r["channels"], r["bits"]) for r in rows] == [(1, a, min(192, 500 - a), count, depth) for a in (0, 192, 384)]
    with pytest.raises(flac.Broken):
        flac.decode([made[0][:-9]])


def test_streams_of_all_kinds_are_decoded_together(monkeypatch):
    """Many small streams of several sample sizes and channels, nulls between them, take few calls of the decoder; a fault costs only its own stream."""
    rng = np.random.default_rng(5)
    kinds = [(8, 1), (16, 2), (24, 1), (12, 3)]
    wave = lambda depth, n: [int(v) for v in rng.integers(-(1 << depth - 1), 1 << depth - 1, n)]
    made = [(d, c, channels := [wave(d, 300) for _ in range(c)], ordinary_stream(channels, d, 192, None, 0, k % 2 == 0)) for k in range(80) for d, c in [kinds[k % 4]]]
    column = pa.array([x for *_, stream in made for x in (stream, None)], pa.binary())
    calls, whole = [], flac.decode
    monkeypatch.setattr(flac, "decode", lambda streams: calls.append(len(streams)) or whole(streams))
    got = {int(at[i]): f.samples[f.offsets[i] : f.offsets[i + 1]].tolist() for at, f in media.decoded(column, "raise") for i in range(len(at))}
    assert got == {2 * k: np.array(channels).T.ravel().tolist() for k, (_, _, channels, _) in enumerate(made)}
    assert len(calls) < 5 and sum(calls) == 80
    bad = pa.array([made[0][3], made[1][3][:-9], made[2][3], b"no"], pa.binary())
    assert [at.tolist() for at, _ in media.decoded(bad, "skip")] == [[0], [2]]
    with pytest.raises(flac.Broken):
        list(media.decoded(bad, "raise"))


def test_blocks_of_streams_of_several_kinds(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for k, (depth, count) in enumerate([(8, 1), (24, 2), (16, 1), (12, 3)]):
        channels = [[int(v) for v in rng.integers(-(1 << depth - 1), 1 << depth - 1, 300)] for _ in range(count)]
        rows += [(k, bytearray(ordinary_stream(channels, depth, 192, None, 0, True)))]
        pcm = b"".join(int(v).to_bytes(-(-depth // 8), "little", signed=True) for v in np.array(channels).T.ravel())
        cut = 192 * count * -(-depth // 8)
        want += [(k, 0, 0, 192, count, depth, pcm[:cut]), (k, 1, 192, 108, count, depth, pcm[cut:])]
    got = media.pcm_blocks(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)).orderBy("doc_id", "block").collect()
    assert [(*tuple(r)[:6], bytes(r["pcm"])) for r in got] == want


def test_media_of_no_rows(spark):
    assert media.pcm_blocks(media.store(table(spark, []))).count() == media.media_digest(table(spark, [])).count() == 0


@pytest.mark.parametrize("at", [2, 20, 45, 70, -3, -1])
def test_flac_faults_are_found(at):
    bad = bytearray(streams(b"some text " * 64)[0])
    bad[at] ^= 0x11
    with pytest.raises(flac.Broken):
        flac.decode([bytes(bad)])


def test_media(spark):
    docs = [(0, None), (1, ""), (2, "é" * 1000), (3, "é" * 1000), (4, "x" * 64)]
    stored = media.store(table(spark, docs))
    back = {}
    for r in media.pcm_blocks(stored).orderBy("doc_id", "block").collect():
        assert r["sample_offset"] == len(back.get(r["doc_id"], b""))
        back[r["doc_id"]] = back.get(r["doc_id"], b"") + bytes((np.frombuffer(r["pcm"], np.int8).astype(int) + 128).astype(np.uint8))
    for i, t in docs:
        raw = (t or "").encode()
        assert back[i].rstrip(b"\0") == raw and len(back[i]) % 64 == 0 and len(back[i]) >= 64
    digest = {r["doc_id"]: r.asDict() for r in media.media_digest(table(spark, docs)).collect()}
    assert {**digest[2], "doc_id": 3} == digest[3] and digest[1]["payload_bytes"] == 64
    assert digest[4]["tail_crc32"] == zlib.crc32(b"x" * 64)


def test_mix(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3] if i % 10 else None) for i in range(200)] + [(None, None, "a"), (5, "w", "b")]
    got = mixing.mix(table(spark, rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    places = [r["position"] for r in got if r["position"] is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for r in got for p in r["positions"] or [])
    for target in {r["target"] for r in got}:
        assert abs(sum(r["taken"] for r in got if r["target"] == target) - target) <= 1
    assert abs(sum({r["target"] for r in got}) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert mixing.mix(table(spark, [], "doc_id long, text string, source string")).count() == 0


def test_inverse_of_a_schedule(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 1.0), (0.25, 3.0), (1.0, 0.0))
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "x double").select(mixing.inverse(knots, F.col("x"))).collect()]
    fine = np.linspace(0, 1, 200_001)
    run = np.cumsum(np.interp(fine, *zip(*knots, strict=True)))
    assert got == pytest.approx([0, fine[np.searchsorted(run / run[-1], 0.3)], 1], abs=1e-3)


def test_apply_bitmap_over_many_lines(spark):
    lines = [f"{i} " + "x" * 50 for i in range(200)]
    rows = [(d, "\n".join(lines if d < 5 else lines[:1])) for d in range(6)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == {0: 200, 1: 200, 2: 200, 3: 200, 4: 1, 5: 0}
