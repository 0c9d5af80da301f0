"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is a run of letters in lower case. The hashes of the word and of its first bytes (so that
inflected forms share something) each pick a row of the embedding table; a word's vector is their sum. Buckets seen in
fewer than ``min_docs`` training texts share row 0. Filters of several widths run over the whole text, each filter's
``TOP`` largest different responses are kept (max pooling), and a logistic layer scores them. A part of the sample
that the network did not train on sets one threshold for each language, and scores are shifted so
that the threshold is 0.5. The language is told from the text's own function words unless a
language column is named; the query names none.

Defined results: null and empty texts have no words, pool to zeros and get one fixed score; every row
gets a result, repeated rows the same one; very long texts are scored whole, in slices of at least one
text; without labels of both classes every score is the share of 1 among the labels; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LETTERS, LOWER, mixed, text_slices, word_hashes, words
from .training import class_shares, held_out, labelled_sample, score_texts

BUCKETS = 1 << 22
#: Bytes of the word starts that are hashed beside the whole word.
STARTS = (4, 5)
WIDTHS = (1, 2, 3)
#: Largest different responses of each filter that are kept.
TOP = 3
#: Frequent function words that tell four languages apart. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with are be this".split(),
    "de": "der die und das den von zu mit sich des ist ein dem nicht".split(),
    "es": "el los que las por una con para su al como del y se".split(),
    "fr": "le les des est dans une pas pour qui sur avec ce il elle".split(),
}


def bucket_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word, a row for the whole word and each of its starts, and where each text's words begin (and end, at last)."""
    data = LOWER[data]
    start, end, row = words(data, offsets, LETTERS)
    kinds = [word_hashes(data, start, end), *(mixed(word_hashes(data, start, np.minimum(end, start + n)) + np.uint64(n)) for n in STARTS)]
    return np.stack([(x % np.uint64(BUCKETS)).astype(np.int32) for x in kinds]), np.searchsorted(row, np.arange(len(offsets)))


def language_ids() -> list[tuple[str, np.ndarray]]:
    out = []
    for lang, listed in FUNCTION_WORDS.items():
        (_, _, data, offsets) = next(text_slices(pa.array([" ".join(listed)])))
        out.append((lang, np.unique(bucket_ids(data, offsets)[0][0])))
    return out


def languages(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of the language whose function words each text has most of; the first on ties."""
    counts = []
    for _, listed in language_ids():
        hit = np.r_[0, np.cumsum(np.isin(ids[0], listed))]
        counts.append(hit[bounds[1:]] - hit[bounds[:-1]])
    return np.argmax(np.array(counts), axis=0)


@dataclass
class TextCNN:
    known: np.ndarray  # sorted buckets that have a row of their own
    table: np.ndarray  # embeddings; row 0 for all other buckets, row 1 pads short texts
    filters: list[np.ndarray]  # for each width: (width, dim, n)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # logit of the threshold for each language

    def rows(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, ids), max(0, len(self.known) - 1))
        return np.where(self.known[at] == ids, at + 2, 0).astype(np.int32) if len(self.known) else np.zeros_like(ids)


def padded(rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by padding as wide as the widest filter."""
    gap = max(WIDTHS)
    shift = np.arange(len(bounds)) * gap
    out = np.ones((len(rows), rows.shape[1] + gap * (len(bounds) - 1)), np.int32)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out[:, np.arange(rows.shape[1]) + shift[text]] = rows
    return out, bounds + shift


def packed_ids(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """``bucket_ids`` of each text as bytes."""
    ids, at = bucket_ids(data, offsets)
    return [np.ascontiguousarray(ids[:, a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def train(texts: list[bytes], y: np.ndarray, share: float, dim: int = 12, per_width: int = 12, epochs: int = 8, min_docs: int = 3, rate: float = 0.08, seed: int = 1) -> TextCNN:
    """Fit on four fifths of the sample, given as ``packed_ids``, and set thresholds on the rest. ``share``: of 1 among all labels."""
    kinds = 1 + len(STARTS)
    each = [np.frombuffer(raw, np.int32).reshape(kinds, -1) for raw in texts]
    ids, bounds = np.concatenate(each, 1), np.r_[0, np.cumsum([x.shape[1] for x in each])]
    text = np.repeat(np.arange(len(y)), np.diff(bounds))
    rng = np.random.default_rng(seed)
    fit = np.ones(len(y), bool)
    fit[4::5] = False  # the sample is in md5 order
    pairs = np.unique(np.concatenate([np.unique((kind.astype(np.int64) * len(y) + text)[fit[text]]) for kind in ids]))
    buckets, seen = np.unique(pairs // len(y), return_counts=True)
    del pairs
    net = TextCNN(buckets[seen >= min_docs], np.zeros(0), [], [], np.zeros(0), 0.0, np.zeros(len(FUNCTION_WORDS)))
    net.table = rng.normal(0, 0.1, (len(net.known) + 2, dim))
    net.table[:2] = 0
    net.filters = [rng.normal(0, 1 / np.sqrt(w * dim), (w, dim, per_width)) for w in WIDTHS]
    net.bias = [np.zeros(per_width) for _ in WIDTHS]
    net.out = rng.normal(0, 0.2, per_width * len(WIDTHS) * TOP)
    rows, bounds_p = padded(np.stack([net.rows(kind) for kind in ids]), bounds)
    del ids
    lengths = np.diff(bounds)
    squares = [np.full_like(net.table, 1e-3), [np.full_like(f, 1e-3) for f in net.filters], [np.full_like(b, 1e-3) for b in net.bias], np.full_like(net.out, 1e-3), 1e-3]
    weight = np.where(y == 1, 0.5 / max(1e-9, y[fit].mean()), 0.5 / max(1e-9, 1 - y[fit].mean()))
    order = np.flatnonzero(fit)

    def step(value: np.ndarray, square: np.ndarray, grad: np.ndarray) -> None:
        square += grad * grad
        value -= rate * grad / np.sqrt(square)

    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(order), max(1, len(order) // 48)):
            pooled = np.zeros((len(batch), len(net.out)))
            where: list[tuple[int, int, int, np.ndarray]] = []
            for i, t in enumerate(batch):
                vec = net.table[rows[:, bounds_p[t] : bounds_p[t] + lengths[t] + max(WIDTHS)]].sum(0)
                for k, w in enumerate(WIDTHS):
                    n = max(1, lengths[t] - w + 1)
                    conv = sum(vec[j : j + n] @ net.filters[k][j] for j in range(w)) + net.bias[k]
                    for top in range(TOP):
                        best = conv.argmax(0)
                        most = conv[best, np.arange(per_width)]
                        at = (k * TOP + top) * per_width
                        pooled[i, at : at + per_width] = np.maximum(0, most)
                        where.append((i, k, at, bounds_p[t] + best))
                        conv[conv >= most] = -np.inf
            z = pooled @ net.out + net.out_bias
            delta = (1 / (1 + np.exp(-z)) - y[batch]) * weight[batch] / len(batch)
            back = delta[:, None] * net.out * (pooled > 0)
            g_filters, g_bias = [np.zeros_like(f) for f in net.filters], [np.zeros_like(b) for b in net.bias]
            touched, grads = [], []
            for i, k, first, at in where:
                g = back[i, first : first + per_width]
                on = np.flatnonzero(g)
                if not len(on):
                    continue
                g_bias[k] += g
                for j in range(WIDTHS[k]):
                    r = rows[:, at[on] + j]
                    g_filters[k][j][:, on] += net.table[r].sum(0).T * g[on]
                    touched.append(r.ravel())
                    grads.append(np.tile((net.filters[k][j][:, on] * g[on]).T, (len(r), 1)))
            step(net.out, squares[3], pooled.T @ delta + 1e-4 * net.out)
            squares[4] += delta.sum() ** 2
            net.out_bias -= rate * delta.sum() / np.sqrt(squares[4])
            if touched:
                r, at = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(r), dim))
                np.add.at(g, at, np.concatenate(grads))
                keep = r > 1
                r, g = r[keep], g[keep]
                squares[0][r] += g * g
                net.table[r] -= rate * g / np.sqrt(squares[0][r])
                for k in range(len(WIDTHS)):
                    step(net.filters[k], squares[1][k], g_filters[k])
                    step(net.bias[k], squares[2][k], g_bias[k])

    net.table = net.table.astype(np.float32)
    del rows
    z, lang = np.zeros(len(y)), np.zeros(len(y), np.int64)
    check = ~fit
    kept = np.flatnonzero(check)
    for own in np.array_split(kept, max(1, len(kept) // 50)):
        if len(own):
            ids, bounds = np.concatenate([each[k] for k in own], 1), np.r_[0, np.cumsum([each[k].shape[1] for k in own])]
            z[own], lang[own] = logits(net, ids, bounds), languages(ids, bounds)
    prior = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    whole = best_threshold(z[check], y[check], prior[check])
    for k in range(len(FUNCTION_WORDS)):
        own = check & (lang == k)
        net.thresholds[k] = best_threshold(z[own], y[own], prior[own]) if min(y[own].sum(), (1 - y[own]).sum()) >= 40 else whole
    return net


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray, slack: float = 0.004) -> float:
    """Of the cuts whose weighted F1 is within ``slack`` of the best, the one nearest to 0; 0 without rows of both classes.

    A cut lies in the middle between neighbouring logits. The slack keeps a few odd rows of a well separated sample
    from moving the threshold far.
    """
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    f1 = 2 * np.cumsum(weight * y) / (np.cumsum(weight) + (weight * y).sum())
    cuts = np.r_[(z[:-1] + z[1:]) / 2, z[-1] - 1]
    good = np.flatnonzero((f1 >= f1.max() - slack) & np.r_[z[:-1] > z[1:], True])
    return float(cuts[good[np.argmin(np.abs(cuts[good]))]])


def logits(net: TextCNN, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Scores before the logistic function."""
    rows, at = padded(net.rows(ids), bounds)
    vec = sum(net.table[kind] for kind in rows)
    length = np.diff(bounds)
    pooled = []
    for k, w in enumerate(WIDTHS):
        conv = vec @ net.filters[k][0].astype(np.float32)
        for j in range(1, w):
            conv[: len(vec) - j] += vec[j:] @ net.filters[k][j].astype(np.float32)
        # a window counts where it lies in its text; a shorter text has one padded window
        end = at[:-1] + np.maximum(1, length - w + 1)
        cuts = np.stack([at[:-1], end], 1).ravel()
        own = np.repeat(np.arange(len(length)), np.diff(at))
        for top in range(TOP if len(vec) else 0):
            most = np.maximum.reduceat(conv, cuts, axis=0)[::2]
            pooled.append(np.maximum(0, most + net.bias[k]))
            if top < TOP - 1:
                conv[conv >= most[own]] = -np.inf
    if not pooled:
        return np.zeros(0)
    return np.concatenate(pooled, 1) @ net.out + net.out_bias


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_bytes: int = 100_000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``. The sample is at most ``2 * per_class`` texts of at most ``max_bytes``."""
    share = class_shares(labels, "toxic")
    texts, y = labelled_sample(docs, labels, "toxic", per_class, packed_ids, max_bytes)
    net = train(texts, y, share) if 0 < y.sum() < len(y) else None

    def scorer():  # noqa: ANN202
        def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            if net is None:
                return np.full(len(offsets) - 1, share)
            ids, bounds = bucket_ids(data, offsets)
            return 1 / (1 + np.exp(-(logits(net, ids, bounds) - net.thresholds[languages(ids, bounds)])))

        return score

    return score_texts(docs, scorer).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
