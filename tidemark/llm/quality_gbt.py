"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one Spark projection (built-ins only) and are written once, so texts are read once and never shuffled.
The trees are fitted on the driver on at most MAX_FIT_ROWS labelled rows of a dozen numbers each (the bound is a parameter;
which rows: those with the smallest hash of doc_id). They are flattened into arrays; scoring walks all trees of an Arrow
batch at once with numpy. Labels, language, source and doc_id are never inputs of a score.

Defined results: a null or empty text has statistics of zero and gets a score like any other; rows without doc_id are scored
and are not held out; without labels, or with labels of one class, the score is the smoothed share of label 1; rows that share
a doc_id are scored each by its own text; an empty table gives an empty table; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.quality_rules import statistics

MAX_FIT_ROWS = 50_000
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "exclaims", "upper", "stop", "line_words", "ellipsis", "bullets")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and FEATURES (double)."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    per_word = {"word_length": "word_chars", "symbols": "n_symbols", "repeats": "n_repeat_words", "exclaims": "n_exclaims", "upper": "n_upper_words", "stop": "n_stop_words"}
    per_line = {"dup_lines": "n_dup_lines", "line_words": "n_words", "ellipsis": "n_ellipsis_lines", "bullets": "n_bullet_lines"}
    made = {k: F.col(c) / n for k, c in per_word.items()} | {k: F.col(c) / lines for k, c in per_line.items()} | {"log_words": F.log1p(F.col("n_words").cast("double"))}
    return statistics(docs.select("doc_id", F.col(text).alias("text")), "text").select("doc_id", *(made[k].alias(k) for k in FEATURES))


@dataclass
class Boosted:
    """Trees as arrays: node i of tree t splits on feature[t, i] at threshold[t, i]; a leaf has feature -1. Children of i: 2i+1 and 2i+2."""

    depth: int = 4
    n_trees: int = 60
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    least: int = 20
    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        n_nodes, score, trees = 2 ** (self.depth + 1) - 1, np.full(len(y), self.base), []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            tree = (np.full(n_nodes, -1, np.int32), np.zeros(n_nodes), np.zeros(n_nodes))
            at = np.zeros(len(y), np.int64)
            for node in range(n_nodes):
                rows = np.flatnonzero(at == node)
                if len(rows):
                    g, h = grad[rows].sum(), hess[rows].sum()
                    tree[2][node] = -self.rate * g / (h + self.ridge)
                    if node < 2**self.depth - 1 and (best := self._split(binned[rows], grad[rows], hess[rows], g, h, cuts)):
                        j, b = best
                        tree[0][node], tree[1][node] = j, cuts[j][b]
                        at[rows] = 2 * node + 1 + (binned[rows, j] > b)
            score += tree[2][at]
            trees.append(tree)
        self.feature, self.threshold, self.value = (np.stack(a) for a in zip(*trees, strict=True))
        return self

    def _split(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, g: float, h: float, cuts: list[np.ndarray]) -> tuple[int, int] | None:
        best, found = 1e-6, None
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gl, hl, nl = (np.bincount(binned[:, j], w, len(c) + 1).cumsum()[:-1] for w in (grad, hess, None))
            gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
            gain[(nl < self.least) | (len(grad) - nl < self.least)] = 0
            if gain.max(initial=0) > best:
                best, found = gain.max(), (j, int(gain.argmax()))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: every row of x walks every tree, level by level."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[at]
                at = np.where(j < 0, at, 2 * at + 1 + (x[rows, j] > threshold[at]))
            total += value[at]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(table: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Boosted:
    """Fits on table (doc_id and FEATURES) joined with labels (doc_id, quality), but for held-out rows."""
    known = labels.where("quality is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # A share of the hash range that holds a few more rows than the bound, so that tasks send the driver no more than these.
    share = min(1.0, 1.1 * max_rows / max(known.count(), 1))
    rows = table.join(known.where(place <= int(share * (1 << 40))), "doc_id").orderBy(place, "doc_id", *FEATURES).limit(max_rows).toPandas()
    return Boosted().fit(rows[list(FEATURES)].to_numpy(np.float64), rows["quality"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    table = written(features(docs))
    model = fit(table, labels, max_rows)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": model.score(b[list(FEATURES)].to_numpy(np.float64))})

    out = table.mapInPandas(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
