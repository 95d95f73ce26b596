"""Toxicity by classifier chains of linear models.

Categories are label columns of 0 and 1, in chain order. The model of a category is a logistic regression with
an elastic-net penalty over the words of a text and the beginnings of these words (inflected forms share them),
and, for each earlier category, that category's probability. Later models are trained with out-of-fold
probabilities of the earlier ones, so that they see these as wrong as they will be on new text; for scoring, each
model is fitted again on all training rows. A category's threshold weighs the two mistakes: over the out-of-fold
probabilities it makes the share of toxic rows caught less CLEAN times the share of clean rows rejected as large as
possible, so that a model that can't tell them apart, as of very few labels, rejects nothing.

Features are named by 64-bit hashes, so that a text of however many words meets no weight by chance, and a
model is a short sorted list of the features with a weight.

Training rows are at most `sample` labelled documents, those with the smallest hash of their id; their ids are
the only rows broadcast. The folds of a category are fitted side by side, one task each, whose size `sample`
bounds. Scoring runs over whole texts in one pass without a shuffle.

Cases: a null text has no words; a null label is 0; a document with several label rows has their largest
labels; repeated documents are scored alike; label rows without document take no part; without labels, or
without both values of a label, the category has its share of ones (0 without labels) as everyone's probability
and nothing is rejected; an empty table gives an empty result; columns that clash with a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 8_000
FOLDS = 3
#: Penalties of the sum of absolute weights and of half the sum of squares: words that a few rows share get no weight.
L1, L2 = 1.6e-3, 4e-4
ROUNDS = 150
#: Training rows that a feature occurs in at least.
MIN_ROWS = 4
#: How many shares of toxic rows kept a share of clean rows rejected weighs.
CLEAN = 2
#: Turns in which features enter a model at most.
TURNS = 4
#: Lengths of the beginnings of longer words.
STEMS = (4, 5)
WORD_CACHE = 200_000
WORD = re.compile(r"[^\W\d_]+")


def hashes_of(word: str) -> list[int]:
    """63-bit names of a word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(f) >> 1 for f in (word, *(word[:n] + "*" for n in STEMS if len(word) > n))]


class Features:
    """Distinct features of texts: all of them by hash, or those in a sorted array by their places there."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = None if known is None else {h: i for i, h in enumerate(known.tolist())}
        self.cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.cache) > WORD_CACHE:
            self.cache.clear()
        words = set(WORD.findall((text or "").lower()))
        for w in words.difference(self.cache):
            found = hashes_of(w)
            self.cache[w] = tuple(found if self.known is None else (self.known[h] for h in found if h in self.known))
        return np.array(sorted({f for t in map(self.cache.__getitem__, words) if t for f in t}), np.int64)


@dataclass
class Link:
    """One category of the chain: features (sorted hashes), their weights, then those of earlier categories and of 1; None for a constant probability."""

    name: str
    features: np.ndarray | None
    weights: np.ndarray | None
    constant: float
    threshold: float


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    ends = np.concatenate([[0.0], np.cumsum(values)])
    at = np.cumsum(sizes)
    return ends[at] - ends[at - sizes]


def _margin(weights: np.ndarray, words: np.ndarray, sizes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    dense = weights[len(weights) - earlier.shape[1] - 1 :]
    return _sums(weights[words], sizes) + earlier @ dense[:-1] + dense[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(words: np.ndarray, sizes: np.ndarray, earlier: np.ndarray, y: np.ndarray, features: int) -> np.ndarray | None:
    """Logistic regression by accelerated proximal gradient steps, each weight with a step of its own."""
    if not len(y) or y.min() == y.max():
        return None
    n, dense = len(y), earlier.shape[1] + 1
    length = features + dense
    row = np.repeat(np.arange(n), sizes)
    norm = sizes + earlier.sum(1) + 1.0
    bound = np.empty(length)  # of the curvature, by diagonal dominance
    bound[:features] = np.bincount(words, norm[row], features)
    bound[features:] = np.append((earlier * norm[:, None]).sum(0), norm.sum())
    step = 1 / (bound / (4 * n) + L2 + 1e-6)
    w = np.zeros(length)
    ahead, t = w, 1.0
    for _ in range(ROUNDS):
        error = (_sigmoid(_margin(ahead, words, sizes, earlier)) - y) / n
        slope = np.empty(length)
        slope[:features] = np.bincount(words, error[row], features)
        slope[features:] = np.append(error @ earlier, error.sum())
        z = ahead - step * (slope + L2 * ahead)
        new = np.sign(z) * np.maximum(np.abs(z) - step * L1, 0)
        new[-1] = z[-1]  # the constant has no penalty
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / faster * (new - w), new, faster
    return w


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> DataFrame:
    """Features and categories of the sample, each document once, with its fold."""
    wanted = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in categories])
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by `sample`
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("doc_id", *categories).agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))

    @F.pandas_udf("array<long>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(Features())

    # features of fewer than MIN_ROWS rows of the sample get no weight in any model: they go before rows are sent to the folds
    every = materialize(rows.select("doc_id", features("text").alias("features"), F.pmod(F.hash("doc_id"), F.lit(FOLDS)).alias("fold"), *categories), "features")
    each = every.select("doc_id", F.explode("features").alias("feature"))
    known = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS).select("feature").hint("merge")
    some = each.join(known, "feature").groupBy("doc_id").agg(F.array_sort(F.collect_list("feature")).alias("some"))
    none = F.array().cast("array<long>")
    return materialize(every.join(some.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("some", none).alias("features"), "fold", *categories), "sample")


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int64), *lists]), lists.map(len).to_numpy(np.int64)


def _places(hashes: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that are in `known`, by place, and how many of them each row has."""
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    ok = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
    return at[ok], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[ok], minlength=len(sizes))


def fit(lists: pd.Series, earlier: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Features with a weight, and the weights of these, of the earlier categories and of 1.

    Features enter in turns: those whose slope exceeds the penalty at the model so far, until there are none left.
    """
    hashes, sizes = _flat(lists)
    known, count = np.unique(hashes, return_counts=True)
    words, sizes = _places(hashes, sizes, known := known[count >= MIN_ROWS])
    row = np.repeat(np.arange(len(y)), sizes)
    active, w, margin = np.zeros(len(known), bool), None, np.full(len(y), 0.0)
    if len(y) and 0 < (share := y.mean()) < 1:
        margin += np.log(share / (1 - share))
    for _ in range(TURNS):
        slope = np.bincount(words, ((_sigmoid(margin) - y) / max(1, len(y)))[row], len(known))
        new = (np.abs(slope) > L1) & ~active
        if w is not None and not new.any():
            break
        active |= new
        place = np.cumsum(active) - 1
        inside = active[words]
        own, n = place[words[inside]], np.bincount(row[inside], minlength=len(y))
        w = fit_linear(own, n, earlier, y, int(active.sum()))
        if w is None:
            return None
        margin = _margin(w, own, n, earlier)
    some = w[: active.sum()] != 0
    return known[active][some], np.concatenate([w[: active.sum()][some], w[active.sum() :]])


def _fold_models(rows: DataFrame, name: str, earlier: list[str]) -> DataFrame:
    """Out-of-fold probabilities (doc_id, p), and the model of all rows on a row without id."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pa.default_memory_pool().release_unused()  # Arrow keeps what it has freed
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        y, before = pdf[name].to_numpy(float), pdf[earlier].to_numpy(float).reshape(len(pdf), -1)
        held = (pdf["fold"] == key[0]).to_numpy()
        model = fit(pdf["features"][~held], before[~held], y[~held])
        if key[0] < 0:
            known, weights = model or (None, None)
            return pd.DataFrame({"doc_id": [None], "p": [float(y.mean())], "features": [known], "weights": [weights]})
        if model is None:
            p = np.full(held.sum(), y[~held].mean() if (~held).any() else y.mean())
        else:
            p = _sigmoid(_margin(model[1], *_places(*_flat(pdf["features"][held]), model[0]), before[held]))
        return pd.DataFrame({"doc_id": pdf["doc_id"][held], "p": p, "features": None, "weights": None})

    every = rows.withColumn("held", F.explode(F.array(*[F.lit(k) for k in range(-1, FOLDS)])))
    return every.groupBy("held").applyInPandas(run, "doc_id long, p double, features array<long>, weights array<double>")


def best_threshold(scores: list[tuple[float, float]]) -> float:
    """Where the share of ones at or above it, less CLEAN times that of zeros, is largest; between the scores on its two sides. Over 1 without both."""
    ones = sum(y for _, y in scores)
    zeros = len(scores) - ones
    if not ones or not zeros:
        return 2.0
    best, out, hit = 0.0, 2.0, 0.0
    ranked = sorted(scores, reverse=True)
    for i, (p, y) in enumerate(ranked):
        hit += y
        after = ranked[i + 1][0] if i + 1 < len(ranked) else 0.0
        if p > after and (gain := hit / ones - CLEAN * (i + 1 - hit) / zeros) > best + 1e-12:
            best, out = gain, (p + after) / 2
    return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> list[Link]:
    rows = training_rows(docs, labels, categories, sample)
    chain: list[Link] = []
    for i, name in enumerate(categories):
        fitted = materialize(_fold_models(rows, name, [f"p_{c}" for c in categories[:i]]), f"fold-{name}")
        rows = rows.join(fitted.where("doc_id is not null").select("doc_id", F.col("p").alias(f"p_{name}")), "doc_id")
        whole = fitted.where("doc_id is null").first()
        if whole is None or whole["weights"] is None:
            chain.append(Link(name, None, None, whole["p"] if whole else 0.0, 2.0))
            continue
        scores = [(r[0], r[1]) for r in rows.select(f"p_{name}", name).collect()]  # bounded by `sample`
        chain.append(Link(name, np.array(whole["features"], np.int64), np.array(whole["weights"]), 0.0, best_threshold(scores)))
    return chain


def vocabulary(chain: list[Link]) -> np.ndarray:
    """All features with a weight, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *[c.features for c in chain if c.features is not None]]))


def probabilities(texts: list[str | None], chain: list[Link], known: np.ndarray, features: Features) -> np.ndarray:
    """A row for each text, a column for each category. `features` gives places in `known`, the chain's vocabulary."""
    each = [features(t) for t in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    found = known[np.concatenate([np.zeros(0, np.int64), *each])]
    out = np.zeros((len(texts), len(chain)))
    for i, link in enumerate(chain):
        out[:, i] = link.constant if link.weights is None else _sigmoid(_margin(link.weights, *_places(found, sizes, link.features), out[:, :i]))
    return out


def score(docs: DataFrame, chain: list[Link], text: str = "text") -> DataFrame:
    """Adds p_<category> of each link and `toxic`, whether the last link's probability reaches its threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most a few thousand features each

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = vocabulary(sent.value)
        features = Features(known)
        for texts in batches:
            parts = [probabilities(texts[at : at + 500].tolist(), sent.value, known, features) for at in range(0, len(texts), 500)]
            yield pd.Series([row for p in parts for row in p], dtype=object)

    names = [f"p_{c.name}" for c in chain]
    kept = [c for c in docs.columns if c not in (*names, "toxic")]
    out = docs.select(*kept, F.struct(scores(text).alias("p")).alias("toxic"))
    return out.select(*kept, *[F.col("toxic.p")[i].alias(n) for i, n in enumerate(names)], (F.col("toxic.p")[len(names) - 1] >= chain[-1].threshold).alias("toxic"))
