"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees over document statistics are fitted to labelled rows; every path from a
root to a node becomes a conjunctive rule; an l1-penalised logistic regression (FISTA) picks
and weighs the rules and the standardised statistics; what survives is compiled into one Spark
column expression. Fitting uses at most ``MAX_TRAIN_ROWS`` labelled rows, chosen by the hash
of the doc_id, and one pass over those rows' texts. Scoring covers every whole text.

Defined results: empty and null texts have zero statistics and are scored like any other;
without labels of both classes the score is the share of good labels (1 if there are none);
a doc_id with both labels counts with each, one with several texts with the least of their statistics. A
column ``score`` is replaced by the result; other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .statistics import NAMES, with_statistics

MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3


def grow(x: np.ndarray, residual: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, bins: list[np.ndarray], least: int):
    """A regression tree as nested (feature, threshold, left, right) or a leaf value."""
    g, h = residual[rows], hess[rows]
    leaf = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, base = None, g.sum() ** 2 / (h.sum() + 1.0)
    for f, cuts in enumerate(bins):
        if not len(cuts):
            continue
        slot = np.searchsorted(cuts, x[rows, f], side="left")
        gs, hs, ns = (np.bincount(slot, weights=w, minlength=len(cuts) + 1).cumsum()[:-1] for w in (g, h, np.ones(len(rows))))
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
        gain[(ns < least) | (ns > len(rows) - least)] = -1
        i = int(gain.argmax())
        if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
            best = (gain[i], f, float(cuts[i]))
    if best is None:
        return leaf
    _, f, cut = best
    left = x[rows, f] <= cut
    return (f, cut, grow(x, residual, hess, rows[left], depth - 1, bins, least), grow(x, residual, hess, rows[~left], depth - 1, bins, least))


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, predict(left, x), predict(right, x))


def paths(tree, so_far=()) -> list[tuple]:
    """Rules: tuples of (feature, is_at_most, threshold), one for each node but the root."""
    if not isinstance(tree, tuple):
        return [so_far] if so_far else []
    f, cut, left, right = tree
    own = [so_far] if so_far else []
    return own + paths(left, (*so_far, (f, True, cut))) + paths(right, (*so_far, (f, False, cut)))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Proximal gradient with momentum for mean logistic loss + penalty * |w|_1 (intercept free)."""
    n, k = z.shape
    w, b, v, vb, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    vec = np.ones(k) / max(k, 1) ** 0.5
    for _ in range(20):
        vec = z.T @ (z @ vec)
        norm = np.linalg.norm(vec) or 1.0
        vec /= norm
    step = 4.0 / (norm / n + 1.0) / 1.1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30)))
        g, gb = z.T @ (p - y) / n, float((p - y).mean())
        nw, nb = v - step * g, vb - step * gb
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


@dataclass
class RuleEnsemble:
    """``intercept`` + rules (weight, conditions) + linear terms (weight, feature, low, high), on the log-odds scale."""

    prior: float = 1.0
    intercept: float | None = None
    rules: list[tuple[float, tuple]] = field(default_factory=list)
    linear: list[tuple[float, int, float, float]] = field(default_factory=list)

    def score(self) -> Column:
        if self.intercept is None:
            return F.lit(float(self.prior))
        z = F.lit(self.intercept)
        for weight, rule in self.rules:
            hit = F.lit(True)
            for f, at_most, cut in rule:
                hit = hit & ((F.col(NAMES[f]) <= cut) if at_most else (F.col(NAMES[f]) > cut))
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        for weight, f, low, high in self.linear:
            z = z + F.lit(weight) * F.least(F.greatest(F.col(NAMES[f]), F.lit(low)), F.lit(high))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 1e-3, seed: int = 7) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(prior=float(y.mean()) if len(y) else 1.0)
    rng = np.random.default_rng(seed)
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, None] = {}
    least = max(2, min(20, len(y) // 50))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(10, len(y) // 2)])
        tree = grow(x, y - p, p * (1 - p), rows, depth, bins, least)
        margin += rate * predict(tree, x)
        found.update(dict.fromkeys(paths(tree)))
    rules = list(found)
    hits = np.array([np.logical_and.reduce([(x[:, f] <= cut) == at_most for f, at_most, cut in r]) for r in rules], dtype=float).T.reshape(len(y), -1)
    low, high = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
    lin = np.clip(x, low, high)
    scale = np.maximum(lin.std(axis=0), 1e-12)
    support = hits.mean(axis=0)
    spread = np.sqrt(np.maximum(support * (1 - support), 1e-3))
    z = np.hstack([(hits - support) / spread, 0.4 * (lin - lin.mean(axis=0)) / scale])
    b, w = lasso_logistic(z, y, penalty)
    wr, wl = w[: len(rules)] / spread, 0.4 * w[len(rules) :] / scale
    return RuleEnsemble(
        prior=float(y.mean()),
        intercept=float(b - (wr * support).sum() - (wl * lin.mean(axis=0)).sum()),
        rules=[(float(v), r) for v, r in zip(wr, rules) if v],
        linear=[(float(v), f, float(low[f]), float(high[f])) for f, v in enumerate(wl) if v],
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 5, is 0. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> RuleEnsemble:
    """Fit on labelled documents outside the held-out fifth."""
    spark = docs.sparkSession
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .select("doc_id", F.col("quality").cast("int").alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    ).collect()
    if not known:
        return RuleEnsemble()
    chosen = F.broadcast(spark.createDataFrame(known, "doc_id long, quality int"))
    described = with_statistics(docs.select("doc_id", "text").join(chosen, "doc_id"), keep=["doc_id", "quality"])
    once = described.groupBy("doc_id", "quality").agg(F.min(F.struct(*NAMES)).alias("s")).select("doc_id", "quality", "s.*")
    rows = once.toPandas().sort_values(["doc_id", "quality", *NAMES])
    return fit_rules(rows[NAMES].to_numpy(), rows["quality"].to_numpy(dtype=float))


def scored(docs: DataFrame, model: RuleEnsemble, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``."""
    inner = {f"_c{i}": c for i, c in enumerate(keep) if c != "score"}
    slim = docs.select(*[F.col(c).alias(i) for i, c in inner.items()], F.col(text).alias("_text"))
    out = with_statistics(slim, "_text", list(inner)).withColumn("_score", model.score())
    return out.select(*[F.col(i).alias(c) for i, c in inner.items()], F.col("_score").alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
