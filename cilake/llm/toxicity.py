"""Toxicity by a classifier chain.

Categories are predicted one after another, each by a logistic model over word features whose input also holds
the logits of the categories before it. In training those logits come from out-of-fold models, so a later model
sees earlier predictions as uncertain as they will be on new texts.

Features are the distinct words of a text and their prefixes of 3 to 7 characters, hashed. Each category keeps
the `N_FEATURES` features of the strongest association (log-likelihood ratio) in the sample, as far as it reaches
`LEAST_ASSOCIATION`; below that, association with a few texts is chance.

Scoring goes over windows of `WINDOW_WORDS` words that overlap by half and cover the whole text; a category's
probability is its largest over the windows. So evidence does not add up with a text's length, and a toxic passage
counts as much in a long text as alone.

Training reads a bounded sample: the `SAMPLE_ROWS` labelled documents with the smallest hash of their id. Only their
hashed features reach the driver. Scoring is one narrow pass over all whole texts; the model (some thousand
numbers) travels in the function.

The table of labels knows one category, `toxic`. `with_categories` derives two finer ones for training, from the
label and short word lists: `insult` (calls a person names) and `contempt` (calls something worthless). The chain
is insult, contempt, toxic; the verdict is the last one's.

Defined cases: a null or empty text has no features and gets the base rate; labels that are null count as 0; a
category without both classes in the sample is constant at its smoothed rate; without any labelled row every
probability is 0. Repeated rows score alike. Existing columns named like a result column are replaced by it.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.llm.common import fresh, small_batches, struct_udf

SAMPLE_ROWS = 6000
N_FEATURES = 384
#: About one in a million by chance (a chi-square of 24); some hundred thousand features are tried.
LEAST_ASSOCIATION = 12.0
WINDOW_WORDS = 96
FOLDS = 3
RIDGE = 0.5
THRESHOLD = 0.5
HASH_BITS = 24
PREFIXES = (3, 4, 5, 6, 7)
CACHED_WORDS = 100_000
CATEGORIES = ("insult", "contempt", "toxic")
WORD = re.compile(r"\w+")

#: Seed words of the two derived training categories.
SEEDS = {
    "insult": ("idiot", "moron", "clown", "loser", "scum"),
    "contempt": ("trash", "pathetic", "disgusting", "worthless", "stupid"),
}


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word as a whole and of its prefixes."""
    parts = [f"={word}", *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]
    return [xxhash.xxh32_intdigest(p) >> (32 - HASH_BITS) for p in parts]


def text_words(data: bytes | None) -> set[str]:
    return set(WORD.findall((data or b"").decode().lower()))


def half_windows(data: bytes | None, size: int = WINDOW_WORDS) -> list[list[str]]:
    """The words in runs of half a window; two neighbours make a window."""
    words = WORD.findall((data or b"").decode().lower())
    return [words[k : k + size // 2] for k in range(0, len(words), size // 2)]


def with_categories(docs: DataFrame, text: str = "text", toxic: str = "toxic") -> DataFrame:
    """`docs` with the derived label columns insult and contempt."""
    label = F.coalesce(F.col(toxic), F.lit(0)).cast("int")
    has = {c: F.coalesce(F.col(text), F.lit("")).rlike(r"(?i)\b(" + "|".join(w) + r")\b").cast("int") for c, w in SEEDS.items()}
    return docs.withColumns({c: label * h for c, h in has.items()} | {toxic: label})


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """The labelled documents with the smallest hashes of their ids, with all label columns; at most `rows`.

    The ids are chosen from the labels alone; only the chosen rows' texts go on (the choice is bounded, so it may be broadcast).
    """
    chosen = labels.dropDuplicates([doc_id]).orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    picked = docs.select(F.col(doc_id), F.col(text).alias("text")).join(chosen.withColumnsRenamed(
        {c: f"label_{c}" for c in labels.columns if c != doc_id}), doc_id)
    return picked.dropDuplicates([doc_id])


def association(x: np.ndarray, n: np.ndarray, x1: int, n_all: int) -> np.ndarray:
    """Signed log-likelihood ratio of a feature in `n` of `n_all` texts, `x` of them among the `x1` positive ones."""
    def part(a, b):
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12)), 0.0)

    want = n * x1 / n_all
    rest = n - x
    g = part(x, want) + part(rest, n - want) + part(x1 - x, x1 - want) + part(n_all - x1 - rest, n_all - x1 - n + want)
    return np.where(x >= want, g, -g)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the bias, by Newton steps with a ridge on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """Per category: chosen features with weights, weights of earlier logits, bias."""

    def __init__(self, categories=CATEGORIES):
        self.categories = tuple(categories)
        self.models: list[tuple[dict[int, float], np.ndarray, float]] = []

    def fit(self, features: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, n_features: int = N_FEATURES,
            ridge: float = RIDGE) -> Chain:
        earlier = np.zeros((len(features), 0))
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            self.models.append(self._one(features, y, earlier, n_features, ridge))
            logit = np.zeros(len(features))
            for fold in np.unique(folds):
                held = folds == fold
                rest = [f for f, h in zip(features, held, strict=True) if not h]
                model = self._one(rest, y[~held], earlier[~held], n_features, ridge)
                logit[held] = [self._logit(model, f, e) for f, e in zip((f for f, h in zip(features, held) if h), earlier[held])]
            earlier = np.hstack([earlier, logit[:, None]])
        return self

    @staticmethod
    def _one(features, y, earlier, n_features, ridge):
        n, pos = len(y), int(y.sum())
        if pos == 0 or pos == n:
            rate = (pos + 0.5) / (n + 1) if n else 0.0
            return {}, np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))) if rate else -30.0
        seen, lens = np.concatenate(features), [len(f) for f in features]
        ids, which, count = np.unique(seen, return_inverse=True, return_counts=True)
        hit = np.bincount(which, np.repeat(y, lens), len(ids))
        score = np.where(count >= 3, association(hit, count.astype(float), pos, n), -np.inf)
        best = np.argsort(-score, kind="stable")[:n_features]
        best = best[score[best] >= LEAST_ASSOCIATION]
        column = np.full(len(ids), -1)
        column[best] = np.arange(len(best))
        x = np.zeros((n, len(best)))
        rows, columns = np.repeat(np.arange(n), lens), column[which]
        x[rows[columns >= 0], columns[columns >= 0]] = 1
        w = fit_logistic(np.hstack([x, np.clip(earlier, -8, 8)]), y, ridge)
        return dict(zip(ids[best].tolist(), w[: len(best)].tolist(), strict=True)), w[len(best) : -1], float(w[-1])

    @staticmethod
    def _logit(model, features, earlier) -> float:
        weights, chain, bias = model
        return bias + sum(weights.get(int(f), 0.0) for f in features) + float(np.clip(earlier, -8, 8) @ chain)

    def combine(self, sums: list[float]) -> list[float]:
        """Probabilities from the per-category sums of feature weights of one text."""
        logits: list[float] = []
        for total, (_, chain, bias) in zip(sums, self.models, strict=True):
            logits.append(bias + total + sum(c * min(8.0, max(-8.0, z)) for c, z in zip(chain.tolist(), logits, strict=True)))
        return [1 / (1 + float(np.exp(-min(30.0, max(-30.0, z))))) for z in logits]


class Scorer:
    """Scores texts; keeps which model features each word met so far has, up to a bound."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.weights = {f: [m[0].get(f, 0.0) for m in chain.models] for m in chain.models for f in m[0]}
        self.words: dict[str, tuple[int, ...]] = {}

    def _features(self, words: list[str]) -> frozenset[int]:
        known, distinct = self.words, set(words)
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in distinct.difference(known):
            known[w] = tuple(f for f in word_features(w) if f in self.weights)
        return frozenset(f for w in distinct for f in known[w])

    def _window(self, features: frozenset[int]) -> list[float]:
        sums = [0.0] * len(self.chain.models)
        for f in features:
            sums = [a + b for a, b in zip(sums, self.weights[f], strict=True)]
        return self.chain.combine(sums)

    def __call__(self, data: bytes | None) -> list[float]:
        halves = [self._features(words) for words in half_windows(data)] or [frozenset()]
        windows = {a | b for a, b in itertools.pairwise(halves)} or set(halves)
        return [max(p) for p in zip(*map(self._window, windows), strict=True)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text",
        categories=CATEGORIES, folds: int = FOLDS) -> Chain:
    """Fit the chain on the bounded sample; `labels` holds doc_id and the categories (or `toxic`, to derive them)."""
    sample = training_rows(docs, labels, rows, doc_id, text).withColumnsRenamed(
        {f"label_{c}": c for c in labels.columns if c != doc_id})
    if not set(categories) <= set(sample.columns):
        sample = with_categories(sample)

    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({f for w in text_words((t.as_py() or "").encode()) for f in word_features(w)}) for t in texts],
                        pa.list_(pa.int32()))

    got = small_batches(sample).select(F.pmod(F.xxhash64(F.col(doc_id), F.lit("fold")), F.lit(folds)).alias("fold"),
                        hashed("text").alias("features"),
                        *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(f"y_{c}") for c in categories]).toArrow()
    if not got.num_rows:
        chain = Chain(categories)
        chain.models = [({}, np.zeros(k), -30.0) for k in range(len(categories))]
        return chain
    features = [x.values.to_numpy() for chunk in got["features"].chunks for x in chunk]
    y = np.stack([got[f"y_{c}"].to_numpy() for c in categories], axis=1)
    return Chain(categories).fit(features, y, got["fold"].to_numpy())


def probabilities(chain: Chain):
    """Column function text -> struct of one probability a category."""
    held: list[Scorer] = []

    def row(data: bytes | None) -> tuple:
        if not held:
            held.append(Scorer(chain))
        return tuple(held[0](data))

    return struct_udf([(f"p_{c}", "double", pa.float64()) for c in chain.categories], row)


def score(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with p_<category> for each category and `is_toxic` (the last category's verdict)."""
    (found,) = fresh(docs, "_scored")
    names = [f"p_{c}" for c in chain.categories]
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*names, "is_toxic"}]
    scored = small_batches(docs).withColumn(found, probabilities(chain)(F.col(text)))
    return scored.select(*rest, *[F.col(found)[n].alias(n) for n in names], (F.col(found)[names[-1]] >= threshold).alias("is_toxic"))


def keep_clean(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the chain does not call toxic, with their own columns only."""
    (found,) = fresh(docs, "_scored")
    last: Column = F.col(found)[f"p_{chain.categories[-1]}"]
    scored = small_batches(docs).withColumn(found, probabilities(chain)(F.col(text)))
    return scored.filter(last < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
