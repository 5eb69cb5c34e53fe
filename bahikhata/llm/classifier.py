"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

Each feature is cut into bins at quantiles of the training rows and has a lookup table of log-odds, a number a bin.
Training goes round the features again and again, each time fitting a shallow tree (a few cuts) to the gradient of
that feature's bins and adding a small step of it to the table. Then the pairs of features with the largest
remaining gain get two-dimensional tables, boosted the same way with four-way trees. A score is one lookup a table,
added up for all rows of a batch at once.

The training rows are the labelled ones that ``learns`` lets in, at most SAMPLE of them by the hash of their
doc_id (a documented bound; every document is scored). Scores use the text alone.

Cases: null and empty texts get the score of all-zero features; null labels are not learned from; without
labelled rows of both kinds every score is the share of label 1 (0.5 without any); repeated doc_ids are rows of
their own; texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bahikhata.llm.common import small_batches, text_of

SAMPLE = 20_000
BINS, ROUNDS, STEP, LEAF, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 120, 0.15, 20, 6, 8, 40
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "symbols", "bangs", "capitals", "digits", "stops", "bars", "distinct", "top_word", "runs", "pairs_again", "lines_again", "line_words")

_CLASS = np.zeros((256, 7), np.int64)
for _i, _signs in enumerate((b"#*$%&|<>@^~=_{}[]\\+", b"!?", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", b"|", bytes(range(97, 123)))):
    _CLASS[list(_signs), _i] = 1


def features(text: str) -> list[float]:
    """FEATURES of one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    symbols, bangs, upper, digits, stops, bars, lower = (raw @ _CLASS).tolist()
    size = sum(map(len, words))
    often = Counter(words)
    again = sum(map(str.__eq__, words, words[1:]))
    rows = [x for x in text.split("\n") if x.strip()]
    return [float(np.log1p(n)), size / n, symbols / size, bangs / size, upper / max(1, upper + lower), digits / size, stops / size, bars / n,
            len(often) / n ** 0.9, max(often.values()) / n, again / n, 1 - len(set(zip(words, words[1:]))) / max(1, n - 1), 1 - len(set(rows)) / max(1, len(rows)), float(np.log1p(n / max(1, len(rows))))]


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for i, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, x[:, i], "right")]
        for a, b, ca, cb, table in self.pairs:
            out += table[np.searchsorted(ca, x[:, a], "right"), np.searchsorted(cb, x[:, b], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return values[values > x.min()] if len(values) else values


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton steps by bin of a tree of ``leaves`` stretches of bins; each holds LEAF rows at least."""
    edges = [0, len(g)]
    gs, hs, ns = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for lo, hi in zip(edges, edges[1:]):
            k = np.arange(lo + 1, hi)
            k = k[(ns[k] - ns[lo] >= LEAF) & (ns[hi] - ns[k] >= LEAF)]
            if len(k):
                part = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1.0)
                gain = part(lo, k) + part(k, hi) - part(lo, hi)
                if (m := gain.max()) > best:
                    best, at = m, int(k[gain.argmax()])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(g))
    for lo, hi in zip(edges, edges[1:]):
        out[lo:hi] = (gs[hi] - gs[lo]) / (hs[hi] - hs[lo] + 1.0)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each side of a two-dimensional table: (gain, steps)."""
    best, out = 0.0, np.zeros_like(g)
    total = g.sum() ** 2 / (h.sum() + 1.0)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            cells = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, None)) for c, d in ((0, j), (j, None))]
            sums = [(g[s].sum(), h[s].sum()) for s in cells]
            gain = sum(a * a / (b + 1.0) for a, b in sums) - total
            if gain > best:
                best, out = gain, np.zeros_like(g)
                for s, (a, b) in zip(cells, sums):
                    out[s] = a / (b + 1.0)
    return best, out


def trained(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of (n, features) rows with labels 0 and 1."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        logit = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
        return Model(float(logit), [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, i], BINS) for i in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)]
    rows = [np.bincount(b, minlength=len(c) + 1) for b, c in zip(bins, cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    logit = np.full(len(y), base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for b, n, table in zip(bins, rows, tables):
            g, h = gradient()
            step = STEP * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), n)
            table += step
            logit += step[b]
    coarse = [_cuts(x[:, i], PAIR_BINS) for i in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        flat, (g, h) = at[i] * shape[1] + at[j], gradient()
        return np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_quarters(*sums(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:PAIRS]
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in pairs:
            step = STEP * _quarters(*sums(i, j))[1]
            table += step
            logit += step[at[i], at[j]]
    return Model(base, cuts, tables, pairs)


def learns(id_: Column) -> Column:
    """Rows that may be learned from; the others are held out."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, x): at most ``sample`` labelled rows, those with the smallest hash of the doc_id; of a repeated doc_id the text with the smallest hash."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learns(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # ``sample`` rows of two integers: a proven bound for the broadcast.
    rows = docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("_quality").alias("quality"), F.xxhash64("text").alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"].astype("int32"), "h": b["h"], "x": [features(t) for t in b["text"]]})
    found = rows.mapInPandas(run, "doc_id long, quality int, h long, x array<double>")
    return found.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min(F.struct("h", "x"))["x"].alias("x"))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a sample of labelled rows; a row a doc_id, ``sample`` at most, is all that reaches the driver."""
    found = sampled(docs, labels, sample).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return trained(x, found["quality"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and _quality_score (double, 0 to 1)."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            x = np.array([features(v) for v in t], np.float64).reshape(-1, len(FEATURES))
            yield pd.Series(np.round(model.scores(x), 9))
    return docs.withColumn("_quality_score", score(text_of()))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    return scored(docs, learned(docs, labels)).where(F.col("_quality_score") >= THRESHOLD).drop("_quality_score")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), learned(docs, labels))
    return out.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), F.col("_quality_score").alias("score"), (F.col("_quality_score") >= THRESHOLD).cast("int").alias("predicted"))
