"""Near-duplicate, substring, line and benchmark operators against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textlist.llm import decontaminate, jaccard_join, line_dedup, suffix_dedup
from textlist.llm.jaccard_join import Bands, Points, RTree, count_vector, runs
from textlist.llm.common import connected_components, save
from textlist.llm.suffix_array import suffix_array

WORDS = [f"w{i}" for i in range(60)]


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(s or ""))


def shingles(s, n):
    w = words(s)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def families(seed, n=60):
    """Texts of several sizes with exact and near copies, blank ones, nulls and one that is long."""
    rng = random.Random(seed)
    out = [None, "", "  \n ", "One", "one", "one two three", "ONE two three"]
    while len(out) < n:
        base = [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(rng.choice([5, 12, 40, 90, 300]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy) if rng.random() < 0.8 else "\t".join(copy).upper())
    out.append(" ".join(rng.choice(WORDS) for _ in range(20_000)))
    return list(enumerate(out))


def components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (3, 60)])
def test_jaccard_components(spark, width, percent):
    rows = families(width)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, width, percent)


def test_jaccard_odd_inputs(spark):
    kind = "doc_id long, text string, id long, comp string"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, "a b c d e f", 1, "x"), (3, "a b c d e f", 1, "x"), (3, "a b c d e f", 1, "x"), (2, "a b c d e f", None, None)]
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, kind)).collect())
    assert got == [("2", "2"), ("3", "2"), ("3", "2"), ("None", "None")]


def test_jaccard_of_very_long_texts(spark):
    base = [f"v{k}" for k in range(100_000)]
    near = ["changed" if k % 200 == 7 else w for k, w in enumerate(base)]
    rng, rows = random.Random(4), [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"u{k}" for k in range(100_000)))]
    for i, n in ((4, 20_000), (6, 60_000), (8, 150_000)):
        own = [f"x{i}y{k}" for k in range(n)]
        rows += [(i, " ".join(own)), (i + 1, " ".join("other" if rng.random() < 0.015 else w for w in own))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8}


def test_jaccard_of_repeated_rows(spark):
    rng = random.Random(9)
    rows, clean = [], []
    for k in range(6):
        base = [f"t{k}x{j}" for j in range(400)]
        other = list(base)
        at = rng.randrange(60, 100)
        other[at : at + 65] = [f"o{k}x{j}" for j in range(65)]  # similarity 0.7
        for i, w in ((2 * k, base), (2 * k + 1, other)):
            clean.append((i, " ".join(w)))
            rows += [(i, " ".join(w))] * 8
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 5, 80).collect()
    want = components(clean, 5, 80)
    assert len(got) == len(rows) and {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, *w) for i, w in want.items()}
    assert all(i == group for i, (_, group) in want.items())


def test_ranges_of_differing_texts_of_an_id_make_no_link(spark):
    base = [f"w{j}" for j in range(400)]
    near = [base[:at] + [f"a{at}x{j}" for j in range(65)] + base[at + 65 :] for at in range(10, 330, 20)]  # each 0.7 alike
    rows = [(1, " ".join(base))] + [(2, " ".join(w)) for w in near]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 2)}


def test_tree_keeps_uncounted_points():
    n = 40
    counts = np.full((n, 256), 255, np.uint8)
    counts[::2] = 250  # counted: 64,000 shingles
    sizes = np.where(np.arange(n) % 2, 100_000, 64_000)
    tree = RTree(Points([c.tobytes() for c in counts], sizes), np.arange(n))
    near = {int(tree.order[k]): {int(x) for x in tree.order[tree.near(k, 85)]} for k in range(n)}
    assert near == {k: {j for j in range(n) if j != k and j % 2 == k % 2} for k in range(n)}


def test_bound_of_vectors_of_two_lengths():
    rng = np.random.default_rng(3)
    for na, nb in ((900, 1100), (1024, 1025), (5000, 5200), (20_000, 17_000)):
        both = np.unique(rng.integers(0, 1 << 48, na // 2, dtype=np.uint64))
        a, b = (np.unique(np.r_[both, rng.integers(0, 1 << 48, n - len(both), dtype=np.uint64)]) for n in (na, nb))
        points = Points([count_vector(a), count_vector(b)], np.array([len(a), len(b)]))
        shared = len(np.intersect1d(a, b))
        assert shared <= np.minimum(*points.at).sum() < 0.9 * min(na, nb)


def test_runs_over_a_limit_come_in_parts():
    key = np.sort(np.r_[np.zeros(3), np.ones(50), np.full(7, 2), np.full(40, 3)]).astype(np.int64)
    for size in (1, 4, 9, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size])], ["k"]) for i in range(0, len(key), size)]
        found = [(t.column("k").to_numpy(), whole) for t, whole in runs(iter(batches), "k", 10)]
        assert np.array_equal(np.concatenate([k for k, _ in found]), key)
        for value, n in ((0, 3), (1, 50), (2, 7), (3, 40)):
            parts = [whole for k, whole in found if value in k]
            assert parts == [True] if n <= 10 else not any(parts) or size > n  # never both, which would give a block two names


def test_tiles_lose_no_link(spark, monkeypatch):
    rows = families(4)
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, 4, 85)


def test_one_of_each_group(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(4, a, "p"), (2, a + " more", "q"), (2, a + " more", "q"), (2, b, "r"), (None, a, "s"), (None, a, "s"), (7, None, "t"), (8, "", "u"), (9, b, "v")]
    out = jaccard_join.one_of_each_group(spark.createDataFrame(rows, "doc_id int, text string, gone string"))
    assert out.columns == ["doc_id", "text", "gone"]
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([rows[k] for k in (1, 4, 5, 6, 7)], "doc_id int, text string, gone string").collect()))
    assert jaccard_join.one_of_each_group(spark.createDataFrame([], "doc_id long, text string, again int")).count() == 0


def test_components_of_many_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(420)] + [(700 + k, 701 + k) for k in range(150)]
    group = list(range(900))
    for _ in range(900):
        for x, y in edges:
            group[x] = group[y] = min(group[x], group[y])
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4), most=50).collect()
    assert {r["id"]: r["component"] for r in got} == {v: group[v] for e in edges for v in e if e[0] != e[1]}


def test_bands_meet():
    for percent in (60, 80, 85):
        bands = Bands(percent, 3000)
        for a in range(1, 1500, 7):
            b = a * 100 // percent
            i, j = (int(x) for x in bands.band([a, b]))
            assert j - i in (0, 1)
            assert (a + b) * (100 - percent) // (100 + percent) < bands.ranges[i] - bands.spare[i]


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(500):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - 99):
            k = b[j : j + 100]
            if k in seen:
                gone[j : j + 100] = [True] * 100
            seen.add(k)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdeé ") for _ in range(400))
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 300), (4, passage), (5, passage), (None, passage[50:260] + "null id")]
    for i in range(6, 40):
        a, b = rng.randrange(200), rng.randrange(80, 200)
        cut = passage[a : a + b]
        rows.append((i, "".join(rng.choice("xyz\n ") for _ in range(rng.randrange(300))) + cut + "q" * rng.randrange(150) + passage[b : b + 101]))
    for hot in (4096, 1):  # no gram is hot, or each one seen twice is
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=hot)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == removed(rows)
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_of_repeated_rows(spark):
    rows = [(1, "x" * 90 + "y" * 90)] * 2
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
    part = " ".join(f"w{k}" for k in range(60))
    rows = [(1, part), (2, f"a text of its own, whatever the other row of the id loses {'z' * 400}"), (2, part), (2, part), (3, "b" * 40 + part * 3000)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    own = lambda t: removed([(0, part), (1, t)])[1][1]
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == sorted([(1, 0), (2, removed(rows[1:2])[2][1]), (2, len(part)), (2, len(part)), (3, own(rows[4][1]))])


def kept_lines(rows, n_chars=40, n_docs=5):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\f\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= n_chars:
                held.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(held.get(key(x), ())) >= n_docs and i != max(held[key(x)], key=lambda d: (d is not None, d))
    return {i: "\n".join(x for x in (t or "").split("\n") if not gone(i, x)) for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [("É" if k % 2 else "A") + f" line number {k} of some length " + "pad" * 6 for k in range(12)]
    rows = [(0, None), (1, ""), (None, "\n".join(pool[:3]))]
    rows += [(i, "\n".join(rng.choice([rng.choice(pool), "\t" + rng.choice(pool).upper() + " ", "short", ""]) for _ in range(rng.choice([1, 3, 150])))) for i in range(2, 30)]
    for heavy in (2000, 3):  # with and without lines settled as heavy
        long = line_dedup.long_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 40)
        gone = {(r["doc"], r["pos"]) for r in line_dedup.dropped_lines(long, 5, heavy_rows=heavy).collect()}
        want = kept_lines(rows)
        got = {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone) for i, t in rows}
        assert got == want
    out = line_dedup.line_dedup(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keep string"))
    assert {r["doc_id"]: r["kept_text"] for r in out.collect()} == want
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_of_repeated_ids_and_clashing_names(spark):
    line = "a line that is long enough to be looked at, and stands in many"
    rows = [(1, line, 1, 2), (1, "unique text that must stay where it is, whatever the other row of the id", 3, 4), (1, line, 5, 6), (None, line, 7, 8), *[(k, f"{line}\n{k}", 9, 10) for k in range(2, 8)], (9, None, 0, 0)]
    want = sorted(["", rows[1][1], "", "", *[str(k) for k in range(2, 7)], f"{line}\n7", ""])
    for heavy in (2000, 3):  # the same by either way
        out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, _keep int, n_lines int"), heavy_rows=heavy)
        assert sorted(r["kept_text"] for r in out.collect()) == want and out.columns == ["doc_id", "text", "_keep", "n_lines", "_n_lines", "n_dropped", "kept_text"]
        out = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, kept_text int, doc int"), heavy_rows=heavy)
        assert sorted(r["text"] for r in out.collect()) == want and out.columns == ["doc_id", "text", "kept_text", "doc"]


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"line number {k} of a text with very many lines in it" for k in range(30_000)]
    rows = [(1, "\n".join(lines)), *[(k, lines[29_999]) for k in range(2, 6)]]
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["n_lines"] == 30_000 and out[1]["n_dropped"] == 1 and out[1]["kept_text"] == "\n".join(lines[:-1]) and out[5]["kept_text"] == lines[29_999]


def leaks(docs, items, width=5, percent=80):
    out = {}
    for d, t in docs:
        for i, x in items:
            w, v = words(t), words(x)
            n = min(width, len(v))
            if not v or len(w) < n:
                continue
            size = len(v) - n + 1
            a, b = ([tuple(y[k : k + n]) for k in range(len(y) - n + 1)] for y in (w, v))
            for s in range(max(1, len(a) - size + 1)):
                window = a[s : s + size]
                both = sum((Counter(window) & Counter(b)).values())
                whole = len(window) + len(b) - both
                if 100 * both >= percent * whole:
                    out[d, i] = max(out.get((d, i), 0), round(both / whole, 6))
    return out


def test_leaks(spark):
    rng = random.Random(4)
    text = lambda n: [rng.choice(WORDS) + rng.choice("abcdef") for _ in range(n)]
    items = [(k, " ".join(text(rng.randrange(12, 60)))) for k in range(8)] + [(8, "only three words"), (9, None), (10, " "), (11, "a b a b a b a b a b a b")]
    docs = [(0, None), (1, ""), (2, "Only THREE words"), (3, "z a b a b a b a b a b a b z")]
    for d in range(4, 40):
        said = words(rng.choice(items[:8])[1])
        for _ in range(rng.randrange(3)):
            said[rng.randrange(len(said))] = "changed"
        docs.append((d, " ".join(text(rng.randrange(30)) + said + text(rng.randrange(30)))))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()} == leaks(docs, items)
    assert decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0
    # the same where items are too many to broadcast
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=0)
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()} == leaks(docs, items)


def test_leaks_of_odd_rows(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(None, f"x {item}", 1, "a"), (1, f"{item} y {item}", 1, "b"), (1, "clean words of the same id", 1, "c"), (1, f"{item} y {item}", 1, "b"), (2, "clean", 1, "d"), (3, f"{'long ' * 60_000}{item}", 1, "e"), (4, None, 1, "f")]
    df, bench = spark.createDataFrame(docs, "doc_id int, text string, print int, doc string"), spark.createDataFrame([(7, item), (7, item), (None, None)], "item_id int, text string")
    got = decontaminate.leaks(df, bench)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(None, 7, 1.0, 1, 20), (1, 7, 1.0, 0, 20), (3, 7, 1.0, 60_000, 20)], got.schema).collect()))
    kept = decontaminate.clean_documents(df, bench)
    assert kept.columns == df.columns and sorted(r["doc"] for r in kept.collect()) == ["c", "d", "f"]
    assert decontaminate.clean_documents(df.where("false"), bench).count() == 0


def test_candidates_are_few_and_lose_little(spark):
    """All windows at the threshold against those that pass the parts and the radius; candidates against all pairs."""
    rng = random.Random(11)
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(40))) for k in range(60)]
    docs = []
    for d in range(300):
        said = words(rng.choice(items)[1])
        at = rng.randrange(4, 30)
        said[at] = "changed"  # five of 36 shingles: similarity 31 / 41
        if d % 2:
            said[at + 3] = "changed too"
        docs.append((d, " ".join([*(f"lead{rng.randrange(9)}" for _ in range(rng.randrange(40))), *said])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, items, 5, 70)
    got = decontaminate.leaks(df, bench, percent=70)
    assert len(want) > 100 and len({(r["doc_id"], r["item_id"]) for r in got.collect()} & set(want)) >= 0.98 * len(want)
    prints = save(decontaminate.item_prints(bench, 5), "prints")
    found = decontaminate.candidates(df, prints, 500_000).select("doc_id", "item").distinct().count()
    assert found <= 2 * 300 < 0.05 * 300 * 60


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_leaks_of_long_items(spark, broadcast_rows):
    """An item of 150,000 words, with more shingles than 16 bits count, and one of 10,000 that leaks twice in one document; one with a run of repeats."""
    rng = random.Random(5)
    long, twice = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (150_000, 10_000))
    runs = "ab " * 4000 + "end of it all"
    changed = long.split()
    for k in range(0, 150_000, 100):
        changed[k] = "other"
    docs = [(1, "lead " + " ".join(changed)), (2, f"one two {twice} between {twice}"), (3, "ab " * 9000 + "end of it all"), (4, twice[: len(twice) // 2])]
    items = [(1, long), (2, twice), (3, runs)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows)
    kept = 149_996 - 5 * 1500 + 4  # of the first item's shingles; its first word is in one only
    rows = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"], r["item_words"]) for r in got.collect()}
    assert rows == {(1, 1): (round(kept / (2 * 149_996 - kept), 6), 1, 150_000), (2, 2): (1.0, 2, 10_000), (3, 3): (1.0, 5000, 4004)}
