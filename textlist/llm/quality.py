"""Quality: Bradley-Terry scores learnt from preference pairs.

A pair is a text of quality 1 and one of quality 0; the chance that the first is
preferred is the logistic function of the difference of their scores, and scores are linear in
features of the whole text: its mix of byte classes, word and line lengths, and repeated words.
The weights are fitted by Newton steps on all pairs of all labelled texts. The threshold is the quantile of all their scores,
weighted to the labels' own shares, that cuts off the share of texts of quality 0; scores
are shifted so that this quantile is ``cut``.

No pair is ever a row. What a Newton step sums over pairs depends on the two scores through a smooth function of their difference, so each
text is shared out among the ``ORDER`` nodes around its score by the weights of polynomial interpolation, texts are summed by class and node, and pairs
are formed of nodes: a pass is linear in the texts, and the logistic function is met to 1e-7 for every pair.

Defined results: null and empty texts have the features of a text without bytes and get one fixed
score; every row gets a result, repeated rows the same one; very long texts are read whole; without
labels of both classes every score is the share of 1 among the labels; an empty table gives an
empty result; columns other than id and text are not read. Every row with a labelled id that is not held out is learnt from,
also repeated, empty and very long ones; where an id has several labels, the largest counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .textbytes import LOWER, NOT_SPACE, text_slices, word_hashes, words
from .training import class_shares, held_out, keep_texts, labelled_rows

PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
#: Distance of two nodes, and nodes that share a score.
STEP, ORDER = 0.25, 8
#: Bins of scores that the driver reads in each round of a quantile.
BINS = 4096


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256)[:, :256].astype(float)
    size = np.maximum(1, np.diff(offsets))[:, None]
    start, end, of = words(data, offsets, NOT_SPACE)
    n_words = np.bincount(of, minlength=n)
    hashes = word_hashes(LOWER[data], start, end)
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    run = np.diff(np.r_[np.flatnonzero(new), len(order)]) if len(order) else np.zeros(0, int)
    most = np.zeros(n)
    np.maximum.at(most, of[order][new], run)
    alike = np.bincount(of[order][new], weights=run.astype(float) ** 2, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, end - start)
    last = np.isin(data[end - 1], PUNCTUATION) if len(end) else np.zeros(0, bool)
    lead = np.isin(data[start], PUNCTUATION) if len(end) else np.zeros(0, bool)
    capital = (data[start] >= 65) & (data[start] <= 90) if len(end) else lead
    per = lambda x: np.bincount(of, weights=x.astype(float), minlength=n) / np.maximum(1, n_words)
    upper, lower, digit = counts[:, 65:91].sum(1), counts[:, 97:123].sum(1), counts[:, 48:58].sum(1)
    columns = [
        upper, lower, digit, counts[:, 128:].sum(1), counts[:, :32].sum(1), counts[:, 32], *counts[:, PUNCTUATION].T,
    ]
    shares = np.sqrt(np.stack(columns, 1) / size)
    lines = counts[:, 10] + 1
    rest = np.stack([
        np.log1p(n_words), np.log1p(size[:, 0] / lines), per(end - start), np.log1p(longest), per(last), per(lead), per(capital),
        distinct / np.maximum(1, n_words), np.sqrt(most / np.maximum(1, n_words)), np.log1p(n_words) * distinct / np.maximum(1, n_words),
        np.sqrt(alike) / np.maximum(1, n_words), upper / np.maximum(1, upper + lower), (upper > lower).astype(float), (n_words == 0).astype(float),
    ], 1)
    return np.concatenate([shares, rest], 1)


N_FEATURES = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


def text_features(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the features of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column("text")):
                x = pa.ListArray.from_arrays(pa.array(np.arange(end - row + 1) * N_FEATURES, pa.int32()), pa.array(features(data, offsets).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[row:end], x], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    """The features of a batch, a row for each text."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_FEATURES)


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def preference(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores before the shift, rounded so that equal texts have equal ones in any batch."""
    mean, scale, w = model
    return np.round(scaled(x, mean, scale) @ w, 9)


def shared_out(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the ``ORDER`` nodes around each score, and what each node gets of it; a node's place is its number by ``STEP``."""
    first = np.floor(scores / STEP).astype(np.int64) - (ORDER // 2 - 1)
    at = scores / STEP - first
    part = np.ones((len(scores), ORDER))
    for k in range(ORDER):
        for other in range(ORDER):
            if other != k:
                part[:, k] *= (at - other) / (k - other)
    return first, part


def node_sums(scores: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(nodes, sums)``: the rows of ``values``, shared out by their scores."""
    first, part = shared_out(scores)
    order = np.argsort(first, kind="stable")
    first, part, values = first[order], part[order], values[order]
    new = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    nodes = np.unique(first[new][:, None] + np.arange(ORDER))
    sums = np.zeros((len(nodes), values.shape[1]))
    for k in range(ORDER):
        sums[np.searchsorted(nodes, first[new] + k)] += np.add.reduceat(part[:, k, None] * values, new)
    return nodes, sums


def vector_sums(rows: DataFrame, made: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each kind, the keys and the sums by key of what ``made`` gives for the labels and features of each batch of ``rows(y, x)``.

    A sum has a value for each feature and one more.
    """
    columns = [f"v{i}" for i in range(N_FEATURES + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for kind, at, v in made(batch.column("y").to_numpy(zero_copy_only=False), matrix(batch.column("x"))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), *(pa.array(c) for c in np.ascontiguousarray(v.T))], ["kind", "at", *columns])

    sums = rows.mapInArrow(run, "kind long, at long, " + ", ".join(f"{c} double" for c in columns)).groupBy("kind", "at").agg(*(F.sum(c).alias(c) for c in columns))
    found = sums.toArrow().sort_by([("kind", "ascending"), ("at", "ascending")])
    kind, at, v = found["kind"].to_numpy(), found["at"].to_numpy(), np.stack([found[c].to_numpy() for c in columns], 1)
    return {int(k): (at[kind == k], v[kind == k]) for k in np.unique(kind)}


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.ones(len(x))]


def fit_pairs(rows: DataFrame, per_bad: float = 24, ridge: float = 2.0) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray] | None, np.ndarray]:
    """Means, scales and weights, and the rows of each class: Newton steps on the logistic loss of ``w . (good - bad)`` over all pairs of ``rows(y, x)``.

    The pairs of a text of quality 0 weigh ``per_bad`` together. A step that raises the loss is halved. Means, scales and weights are rounded, so that the order
    in which tasks are summed does not show. Without both classes there is no model.
    """

    def moments(y: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for c in (0, 1):
            own = with_ones(x[y == c])
            yield c, np.arange(2), np.stack([own.sum(0), (own * own).sum(0)])

    first = vector_sums(rows, moments)
    n = np.array([first[c][1][0, -1] if c in first else 0.0 for c in (0, 1)])
    if not n.all():
        return None, n
    total = (first[0][1] + first[1][1])[:, :-1] / n.sum()
    mean, scale = np.round(total[0], 9), np.round(np.sqrt(np.maximum(0, total[1] - total[0] ** 2)) + 1e-3, 6)
    pair = per_bad / n[1]
    w, step, least = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.inf
    for _ in range(60):

        def by_node(y: np.ndarray, x: np.ndarray, w: np.ndarray = w) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            z = scaled(x, mean, scale)
            for c in (0, 1):
                if (y == c).any():
                    yield c, *node_sums(z[y == c] @ w, with_ones(z[y == c]))

        sums = vector_sums(rows, by_node)
        (bad, in_bad), (good, in_good) = sums[0], sums[1]
        apart = (good[:, None] - bad) * STEP
        loss = pair * (in_good[:, -1] @ np.logaddexp(0, -apart) @ in_bad[:, -1]) + ridge / 2 * w @ w
        if loss > least * (1 + 1e-6):
            step = step / 2
            w = w + step
            continue
        least = loss
        p = pair / (1 + np.exp(np.clip(apart, -500, 500)))  # chance of the wrong order
        bend = p * (1 - p / pair)
        from_good, from_bad = in_good[:, :-1], in_bad[:, :-1]
        grad = ridge * w - (p @ in_bad[:, -1]) @ from_good + (in_good[:, -1] @ p) @ from_bad
        at_node = {0: (bad, in_good[:, -1] @ bend), 1: (good, bend @ in_bad[:, -1])}

        def squares(y: np.ndarray, x: np.ndarray, w: np.ndarray = w, at_node: dict = at_node) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            z = scaled(x, mean, scale)
            weight = np.zeros(len(y))
            for c, (nodes, values) in at_node.items():
                near, part = shared_out(z[y == c] @ w)
                weight[y == c] = (part * values[np.minimum(len(nodes) - 1, np.searchsorted(nodes, near[:, None] + np.arange(ORDER)))]).sum(1)
            yield 0, np.arange(N_FEATURES), np.c_[(z * weight[:, None]).T @ z, np.zeros(N_FEATURES)]

        cross = from_good.T @ bend @ from_bad
        step = np.linalg.solve(vector_sums(rows, squares)[0][1][:, :-1] - cross - cross.T + ridge * np.eye(N_FEATURES), grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return (mean, scale, np.round(w, 6)), n


def quantile(scored: DataFrame, weight: tuple[float, float], share: float) -> float:
    """The least ``z`` of ``scored(y, z)`` up to which rows hold ``share`` of all weight; a row's weight is that of its class.

    Exact: each round counts the rows of equal bins and goes on within the bin that holds the quantile, until it holds one value.
    """
    lo, hi, ones, rows = scored.agg(F.min("z"), F.max("z"), F.sum("y"), F.count("z")).first()
    target, below = share * (weight[0] * (rows - ones) + weight[1] * ones), np.zeros(2)
    while lo < hi:
        at = F.least(F.floor((F.col("z") - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1))
        bins = scored.where(F.col("z").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("z").alias("n"), F.sum("y").alias("ones"), F.min("z").alias("lo"), F.max("z").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: r["bin"]):
            lo, hi, before = r["lo"], r["hi"], below
            below = below + [r["n"] - r["ones"], r["ones"]]
            if below @ weight >= target:
                break
        below = before
    return float(lo)


def fitted(made: DataFrame, labels: DataFrame, cut: float, share_cut: float | None) -> Callable[[np.ndarray], np.ndarray]:
    """The score of features that the labels give for ``made(doc_id, x)``; ``cut`` is the score at the quantile."""
    share = class_shares(labels, "quality")
    rows = save(labelled_rows(made, labels, "quality").select("y", "x"), "quality-rows")
    model, n = fit_pairs(rows)
    at = 0.0
    if model is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(preference(matrix(batch.column("x")), model))], ["y", "z"])

        scored = save(rows.mapInArrow(run, "y long, z double"), "quality-scores")
        at = quantile(scored, ((1 - share) / n[0], share / n[1]), 1 - share if share_cut is None else share_cut)

    def score(x: np.ndarray) -> np.ndarray:
        if model is None:
            return np.full(len(x), share)
        return 1 / (1 + np.exp(-np.clip(preference(x, model) - at + np.log(cut / (1 - cut)), -30, 30)))

    return score


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, share_cut: float | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; ``share_cut`` replaces the labels' share of 0 as the quantile.

    Texts are read once: their features are a written table, from which rows are learnt and scored.
    """
    made = save(text_features(docs), "quality-features")
    score = fitted(made, labels, cut, share_cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(matrix(batch.column("x"))))], ["doc_id", "score"])

    scored = made.mapInArrow(run, f"doc_id {made.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, share_cut: float | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality`` predicts as 1."""
    score = fitted(text_features(docs.where(~held_out(F.col("doc_id")))), labels, cut, share_cut)
    return keep_texts(docs, lambda: lambda data, offsets: score(features(data, offsets)), cut)
