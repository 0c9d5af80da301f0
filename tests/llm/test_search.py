"""Vector and lexical search operators against brute force, and on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from textlist.llm import cap_filters, hard_negatives, lexical_search
from textlist.llm.common import read_table

VECTORS = "vec_id long, embedding array<double>, label int, part int, block string, x double, n int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "b", 0.5, 2) for i, v, y in rows], VECTORS)


def clean_of(rows):
    """One usable vector an id, as arrays of one length."""
    kept = {}
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    for i, v, y in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept[i] = min(kept.get(i, (v, y)), (v, y), key=lambda t: t[0])
    return {i: (np.array(list(v) + [0.0] * (width - len(v))), y) for i, (v, y) in kept.items()}


# ---- hard negatives -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (33, 17, 40), (70, 64, 129), (128, 128, 128), (20, 100, 0)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    random = np.random.default_rng(m + k + n)
    a, b = random.integers(-(1 << 28), 1 << 28, (m, k)), random.integers(-(1 << 28), 1 << 28, (k, n))
    assert (hard_negatives.strassen(a, b, leaf=4) == a @ b).all()


def test_strassen_wraps_like_a_plain_product():
    a = np.full((40, 40), 1 << 61, np.int64)
    assert (hard_negatives.strassen(a, a + 3, leaf=4) == a @ (a + 3)).all()


def mined(rows, every=100):
    whole = {i: (np.floor(256 * v).astype(np.int64), (y + 1) % 10 if i % 7 == 0 else y) for i, (v, y) in clean_of([r for r in rows if r[2] is not None]).items()}
    out = []
    for a, (v, y) in whole.items():
        if a % every:
            continue
        score = {i: int(v @ u) for i, (u, _) in whole.items()}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:5]  # noqa: B023, E731
        for p in first(i for i in whole if i != a and whole[i][1] == y):
            fit = [i for i in whole if whole[i][1] != y and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(first(fit), 1)]
    return sorted(out)


def test_hard_negatives_on_odd_rows(spark, monkeypatch):
    random = np.random.default_rng(3)
    rows = [(i, random.integers(-3, 4, 6).astype(float).tolist(), int(random.integers(0, 4))) for i in range(0, 900)]
    rows += rows[:40] + [(None, [1.0] * 6, 1), (1000, None, 1), (1001, [1.0, None], 1), (1002, [math.nan], 1), (1003, [math.inf, 1.0], 1), (1004, [1.0] * 6, None), (1100, [], 2), (1200, [0.3, 2.0], 2)]
    want = mined(rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 100)
    got = hard_negatives.hard_negatives(vectors_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == want
    assert want


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(vectors_of(spark, [])).collect() == []
    assert hard_negatives.hard_negatives(vectors_of(spark, [(100, [1.0], 3)])).collect() == []


# ---- near vectors ---------------------------------------------------------------------------------------------------


def linked(rows, cosine=0.9):
    whole = {i: v / np.linalg.norm(v) for i, (v, _) in clean_of(rows).items() if v.any()}
    ids = sorted(whole)
    near = np.array([whole[i] for i in ids]) @ np.array([whole[i] for i in ids]).T >= cosine if ids else np.zeros((0, 0), bool)
    component = {}
    for start in range(len(ids)):
        if ids[start] in component:
            continue
        todo = [start]
        component[ids[start]] = ids[start]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if ids[j] not in component:
                    component[ids[j]] = ids[start]
                    todo.append(j)
    links = {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
    return sorted((i, links.get(i, 0), component.get(i, i), component.get(i, i) == i) for i in {r[0] for r in rows if r[0] is not None})


def crowd(random, centre, n, spread, at):
    v = centre + spread * random.standard_normal((n, len(centre))) / math.sqrt(len(centre))
    return [(at + i, x.tolist(), 0) for i, x in enumerate(v)]


@pytest.mark.parametrize("tile", [4096, 16])
def test_near_vectors_with_crowds(spark, monkeypatch, tile):
    """Crowds of near copies, two of them about as far apart as a link reaches, so that their members have to be compared."""
    random = np.random.default_rng(5)
    a, b = np.linalg.qr(random.standard_normal((32, 2)))[0].T
    rows = crowd(random, a, 60, 0.12, 0) + crowd(random, math.cos(0.45) * a + math.sin(0.45) * b, 60, 0.12, 100)
    rows += [(200 + i, v.tolist(), 0) for i, v in enumerate(random.standard_normal((200, 32)))]
    rows += [(400 + i, [3 * c for c in rows[0][1]], 0) for i in range(30)] + [(500 + i, rows[7][1], 0) for i in range(30)]
    monkeypatch.setattr(cap_filters, "TILE", tile)
    got = cap_filters.near_vectors(vectors_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == linked(rows)


def test_near_vectors_on_odd_rows(spark):
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [math.nan, 1.0], 0), (6, [math.inf, 1.0], 0), (7, [1e200, 1e200], 0), (8, [2e-200, 2e-200], 0), (9, [1.0, 1.0, 0.0], 0), (9, [1.0, 1.0, 0.0], 0), (10, [-1.0, -1.0], 0), (11, [1.0], 0)]
    got = {r["vec_id"]: tuple(r)[1:] for r in cap_filters.near_vectors(vectors_of(spark, [*rows, (None, [1.0, 1.0], 0)])).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 5, 6, 10, 11)} == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)}
    assert {i: got[i] for i in (7, 8, 9)} == {7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False)}
    assert got[None][:2] == (0, None)
    assert cap_filters.near_vectors(vectors_of(spark, [])).collect() == []


@pytest.mark.parametrize("n", [500, 50_000, 2_000_000])
def test_recall_at_the_threshold(n):
    """Pairs at exactly the threshold, with the code that ``n`` vectors would get."""
    random = np.random.default_rng(n)
    filters = cap_filters.mean_filters(n)
    code = cap_filters.Code(64, cap_filters.words_of(n, filters), filters)
    u, o = random.standard_normal((2, 400, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    o -= (o * u).sum(axis=1, keepdims=True) * u
    v = 0.9 * u + math.sqrt(1 - 0.81) * o / np.linalg.norm(o, axis=1, keepdims=True)
    both = [set(zip(*(x.tolist() for x in code.decode(w)[1:]), strict=True)) for w in (u, v)]
    assert 0.7 * filters < len(both[0]) / len(u) < 1.3 * filters
    assert len({row for row, _ in both[0] & both[1]}) / len(u) > 0.95


def test_turning_keeps_lengths_and_angles():
    u = np.random.default_rng(1).standard_normal((20, 48))
    v = cap_filters.Code(48, 8, 4).turned(u)
    assert np.allclose(u @ u.T, v @ v.T)


# ---- lexical search -------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    tokens = [(d, terms_of(t)) for d, t in docs]
    n, length = sum(bool(w) for _, w in tokens), sum(len(w) for _, w in tokens)
    df = Counter(t for _, w in tokens for t in set(w))
    out = []
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(text))
    for i, own in asked.items():
        scores = []
        for d, w in tokens:
            tf = Counter(w)
            m = 10 + 90 * len(w) * n // length if length else 0
            s = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in own if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


DOCS = "doc_id long, text string, n int, m int, item_id long, terms string"


def searched(spark, docs, items):
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, 1, 2.0) for i, t in items], "item_id long, text string, w int, score double")
    return sorted(map(tuple, lexical_search.ranked_search(docs, items).collect()), key=lambda r: r[:2])


def test_search_against_brute_force(spark, sf):
    docs, items = read_table(spark, sf, "documents").select("doc_id", "text"), read_table(spark, sf, "benchmark").select("item_id", "text")
    got = sorted(map(tuple, lexical_search.ranked_search(docs, items).collect()))
    assert got == ranked([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


@pytest.mark.parametrize(("documents", "items"), [(8192, 512), (16, 2)])
def test_search_on_odd_rows(spark, monkeypatch, documents, items):
    monkeypatch.setattr(lexical_search, "DOCUMENTS", documents)
    monkeypatch.setattr(lexical_search, "ITEMS", items)
    random = np.random.default_rng(2)
    pool = ["Alpha", "beta", "ÉTÉ", "été", "x1", "日本", "of", "the", "gamma", "delta"]
    docs = [(i, " ".join(random.choice(pool, random.integers(0, 12)))) for i in range(120)]
    docs += docs[:5] + [(200, None), (201, ""), (None, "alpha alpha beta"), (202, ". ; \t"), (203, "the " * 30_000 + "alpha"), (204, "alpha-beta_gamma\x00delta")]
    asked = [(1, "alpha BETA"), (2, "été the"), (3, "日本 x1 x1"), (4, None), (5, "nowhere"), (6, " ".join(pool)), (6, "delta"), (None, "alpha")]
    assert searched(spark, docs, asked) == ranked(docs, asked)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("seed", range(6))
def test_treap_finds_the_best_columns(seed):
    random = np.random.default_rng(seed)
    height = int(random.integers(1, 8))
    side = 1 << height
    grid = np.where(random.random((side, side)) < 0.3, random.integers(1, 9, (side, side)), 0)
    grid[0, 0] = 1
    row, column = np.nonzero(grid)
    treap = lexical_search.Treap(row, column, grid[row, column], height)
    for k in (1, 3, 10):
        own = np.flatnonzero(random.random(side) < 0.5)
        sums = grid[own].sum(axis=0)
        want = sorted(((-s, c) for c, s in enumerate(sums.tolist()) if s > 0))[:k]
        got = treap.best(own, k)
        assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == [(c, -s) for s, c in want]
