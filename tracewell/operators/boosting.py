"""Gradient-boosted trees by histograms, with L2, nulls of their own, and folds as a key.

Features are cut at up to ``BINS`` quantiles; rows are kept as blocks of bin numbers, a byte a value.
A level of a tree is one aggregation: each block adds up gradient, hessian and row counts per (model,
node, feature, bin), sums are combined and searched in a task per model and node, whose histogram has a
size that features and bins give, whatever the rows, and what the driver gets is the best split of each
node: nulls go to the side where they gain more. A leaf weighs -G / (H + l2).

Models of folds grow side by side: a row is in all models but that of its own fold, so a round of all
folds costs as many jobs as a round of one. Blocks keep their margins, which move on by one tree a round,
and are checkpointed every ``CUT`` rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans import scratch

#: Quantiles of a feature, at most (a byte holds a bin, one of which is for nulls); rounds between
#: checkpoints; rows of a block, at most.
BINS, CUT, ROWS = 254, 50, 16_384


def edges_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending split points of each feature: a value's bin is how many of them are below it."""
    at = F.array(*(F.lit((k + 1) / (bins + 1)) for k in range(bins)))
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    found = rows.agg(*(F.percentile_approx(value(c), at, 100_000).alias(f"e{k}") for k, c in enumerate(features))).first()
    return [np.unique(np.array(found[k] or [], float)) for k in range(len(features))]


class Trees:
    """Full trees of one model: per inner node a feature, the highest bin and value that go left, and whether nulls do."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature, self.bin, self.value, self.left, self.leaf = [], [], [], [], []

    def margins(self, x: np.ndarray, null: np.ndarray) -> np.ndarray:
        """What the trees add up to for rows of values."""
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, limit, left, leaf in zip(self.feature, self.value, self.left, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                goes = np.where(null[rows, f], left[node], x[rows, f] <= limit[node])
                node = 2 * node + 2 - goes
            out += leaf[node - len(feature)]
        return out


def _nodes(cols: np.ndarray, tree: dict, levels: int, n_bins: int) -> np.ndarray:
    """The node of each row, so many levels down; ``cols`` has a row of bin numbers per feature."""
    node, rows = np.zeros(cols.shape[1], np.int64), np.arange(cols.shape[1])
    for _ in range(levels):
        v = cols[tree["feature"][node], rows]
        node = 2 * node + 2 - np.where(v == n_bins - 1, tree["left"][node], v <= tree["bin"][node])
    return node


def _hist(block: dict, growing: list[dict], level: int, n_bins: int) -> np.ndarray:
    """(models, nodes of the level, features, bins, 3) of one block, whose rows lie together by fold."""
    cols, fold = block["bins"], block["fold"]
    nodes = 1 << level
    out = np.zeros((len(growing), nodes, len(cols), n_bins, 3))
    for k, now in enumerate(growing):
        p = 1 / (1 + np.exp(-block["margin"][k]))
        g, h = block["w"] * (p - block["y"]), block["w"] * p * (1 - p)
        at = (_nodes(cols, now, level, n_bins) - (nodes - 1)) * n_bins
        a, b = np.searchsorted(fold, [k, k + 1])  # rows of its own fold
        both = lambda x, a=a, b=b: np.concatenate((x[:a], x[b:])) if b > a else x
        g, h, at = both(g), both(h), both(at)
        for f, c in enumerate(cols):  # a feature at a time: its sums stay in the cache
            index = at + both(c)
            for i, v in enumerate((g, h, None)):
                out[k, :, f, :, i] = np.bincount(index, v, nodes * n_bins).reshape(nodes, n_bins)
    return out


def _best(hist: np.ndarray, l2: float, least: int) -> tuple | None:
    """(gain, feature, bin, nulls left) of one node's (features, bins, 3); ties to the first feature, then bin, then nulls left."""
    total = hist[0].sum(0)
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    below = np.cumsum(hist[:, :-1], axis=1)  # the last bin is for nulls
    both = np.stack([below + hist[:, -1:], below], axis=2)  # nulls left, nulls right
    rest = total - both
    gain = value(both) + value(rest) - value(total)
    fits = (both[..., 2] >= least) & (rest[..., 2] >= least)
    gain = np.where(fits, gain, -np.inf)
    gain = np.where(gain >= gain.max() - 1e-12 * abs(gain.max()), gain.max(), gain)  # sums add up in any order
    at = int(gain.argmax())
    f, b, side = np.unravel_index(at, gain.shape)
    return (gain[f, b, side], int(f), int(b), side == 0) if gain[f, b, side] > 1e-12 else None


class BoostedTrees:
    """Log loss; rows have y, weight and the features. Without folds there is one model, of all rows."""

    def __init__(self, depth: int = 3, rate: float = 0.05, rounds: int = 300, l2: float = 1.0, least: int = 20, bins: int = BINS):
        self.depth, self.rate, self.rounds, self.l2, self.least, self.bins = depth, rate, rounds, l2, least, bins

    def fit(self, rows: DataFrame, features: list[str], fold: str | None = None, whole: bool = False) -> "BoostedTrees":
        """With ``fold``, a model per distinct value of that column, of the rows with other values; and one of all rows, if ``whole``.

        Features without any value are left out.
        """
        spark = rows.sparkSession
        own = scratch.cut(rows.select(*(F.col(c).cast("double").alias(c) for c in features), F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), *([F.col(fold).alias("fold")] if fold else [])))
        found = edges_of(own, features, self.bins)
        self.features = [c for c, e in zip(features, found) if len(e)]
        self.edges = [e for e in found if len(e)]
        self.folds = (sorted(r[0] for r in own.select("fold").distinct().collect()) if fold else []) + [None] * (whole or not fold)  # few names
        number = {k: i for i, k in enumerate(self.folds)}
        sums = own.groupBy(*(["fold"] if fold else [])).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("y")).alias("wy")).collect()
        self.models = []
        for k in self.folds:
            w, wy = (sum(r[c] for r in sums if not fold or r["fold"] != k) for c in ("w", "wy"))
            p = min(max(wy / w, 1e-9), 1 - 1e-9) if w else 0.5
            self.models.append(Trees(self.depth, float(np.log(p / (1 - p)))))
        n_bins = max((len(e) for e in self.edges), default=0) + 2
        edges, names, bases = self.edges, self.features, [m.base for m in self.models]

        def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for a in range(0, len(f), ROWS):
                    part = f.iloc[a : a + ROWS]
                    x = part[names].to_numpy(float).reshape(len(part), len(names))
                    bins = np.stack([np.where(np.isnan(x[:, c]), n_bins - 1, np.searchsorted(e, x[:, c])) for c, e in enumerate(edges)], 1).astype(np.uint8)
                    of = part["fold"].map(number).to_numpy(np.int32) if fold else np.full(len(part), -1, np.int32)
                    by = np.argsort(of, kind="stable")
                    y, w = (part[c].to_numpy()[by].tobytes() for c in ("y", "weight"))
                    yield pd.DataFrame({"n": [len(part)], "bins": [np.ascontiguousarray(bins[by].T).tobytes()], "y": [y], "w": [w], "fold": [of[by].tobytes()]})

        def opened(r) -> dict:
            return {"bins": np.frombuffer(r["bins"], np.uint8).reshape(-1, r["n"]), "y": np.frombuffer(r["y"]), "w": np.frombuffer(r["w"]), "fold": np.frombuffer(r["fold"], np.int32), "margin": np.tile(np.array(bases)[:, None], (1, r["n"]))}

        # No more tasks than blocks, or than run at once: a round is as many short jobs as a tree has levels.
        blocks = max(1, min(-(-own.count() // ROWS), spark.sparkContext.defaultParallelism))
        state = own.coalesce(blocks).mapInPandas(block, "n int, bins binary, y binary, w binary, fold binary").rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
        if not self.edges:
            return self
        depth, before = self.depth, None
        used = np.zeros((len(edges), n_bins), bool)  # bins that a feature has
        for c, e in enumerate(edges):
            used[c, : len(e) + 1] = used[c, -1] = True
        for r in range(self.rounds):
            if r:
                # Margins move on by the last tree of each model; what they came from is forgotten.
                last = list(zip(grown, (m.leaf[-1] for m in self.models)))
                before, state = state, state.map(lambda b, last=last: b | {"margin": np.stack([z + leaf[_nodes(b["bins"], now, depth, n_bins) - len(now["bin"])] for z, (now, leaf) in zip(b["margin"], last)])}).persist(StorageLevel.MEMORY_AND_DISK)
                if r % CUT == 0:
                    scratch.folder(spark, "unused")
                    state.checkpoint()
            grown = [{"feature": np.zeros((1 << self.depth) - 1, np.int64), "bin": np.full((1 << self.depth) - 1, n_bins), "left": np.ones((1 << self.depth) - 1, bool)} for _ in self.models]
            sums_at: list[dict] = [{} for _ in self.models]
            for level in range(self.depth):
                for (k, j), (split, total, below) in self._splits(state, grown, level, n_bins, used):
                    node = (1 << level) - 1 + j
                    sums_at[k][node] = total
                    if split:
                        grown[k]["feature"][node], grown[k]["bin"][node], grown[k]["left"][node] = split
                    sums_at[k][2 * node + 1], sums_at[k][2 * node + 2] = below, total - below
                if before is not None:
                    before.unpersist()
                    before = None
            for m, now, at in zip(self.models, grown, sums_at):
                m.feature.append(now["feature"])
                m.bin.append(now["bin"])
                m.left.append(now["left"])
                m.value.append(np.array([self.edges[f][b] if b < len(self.edges[f]) else np.inf for f, b in zip(now["feature"], now["bin"])]))
                # A leaf whose node didn't split is the whole node, on the left.
                leaves = range((1 << self.depth) - 1, (1 << self.depth + 1) - 1)
                m.leaf.append(np.array([-self.rate * at[n][0] / (at[n][1] + self.l2) for n in leaves]))
        state.unpersist()
        return self

    def _splits(self, state, grown: list[dict], level: int, n_bins: int, used: np.ndarray) -> list[tuple]:
        """((model, node of the level), (its split, gradient and hessian, those of its left side)).

        Histograms are added up and searched in tasks, one per model and node; they don't come to the driver.
        """
        l2, least = self.l2, self.least

        def added(blocks) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            total = None
            for b in blocks:
                one = _hist(b, grown, level, n_bins)
                total = one if total is None else np.add(total, one, out=total)
            for k in range(len(grown) if total is not None else 0):
                for j in range(1 << level):
                    yield (k, j), total[k, j][used]

        def searched(own: tuple[tuple[int, int], np.ndarray]) -> tuple[tuple[int, int], tuple]:
            h = np.zeros((*used.shape, 3))
            h[used] = own[1]
            total = h[0].sum(0)
            split = _best(h, l2, least) if total[2] else None
            below = total
            if split:
                _, f, b, left = split
                below = h[f, : b + 1].sum(0) + (h[f, -1] if left else 0)
            return own[0], (split[1:] if split else None, total[:2], below[:2])

        each = state.mapPartitions(added)
        if state.getNumPartitions() > 1:
            nodes = 1 << level
            each = each.reduceByKey(lambda a, b: a + b, len(grown) * nodes, lambda key: key[0] * nodes + key[1])
        return each.map(searched).collect()

    def _probability(self, x: Column, model: Column) -> Column:
        models = self.models

        @F.pandas_udf("double")
        def score(values: pd.Series, which: pd.Series) -> pd.Series:
            x = np.array([[np.nan if v is None else v for v in row] for row in values], float).reshape(len(values), -1)
            out = np.zeros(len(x))
            for k in which.unique():
                at = (which == k).to_numpy()
                out[at] = models[k].base + models[k].margins(x[at], np.isnan(x[at]))
            return pd.Series(1 / (1 + np.exp(-out)))

        return score(x, model)

    def score(self, rows: DataFrame, out: str = "score", fold: str | None = None) -> DataFrame:
        """``rows`` with a probability; with ``fold``, by the model that has not seen the row's fold, where that is null by the one of all rows."""
        x = F.array(*(F.col(c).cast("double") for c in self.features)) if self.features else F.array(F.lit(None).cast("double"))
        model = F.lit(0)
        if fold:
            number = F.create_map(*(v for i, k in enumerate(self.folds) if k is not None for v in (F.lit(k), F.lit(i))))
            model = F.coalesce(number[F.col(fold)], F.lit(len(self.folds) - 1))
        return rows.withColumn(out, self._probability(x, model))


def out_of_fold_scores(rows: DataFrame, folds: DataFrame, features: list[str], how: BoostedTrees | None = None) -> DataFrame:
    """``rows`` of ``folds (uid, fold)`` with the score of the model that saw none of their fold; all models in one go."""
    placed = scratch.cut(rows.join(folds, "uid"))
    return (how or BoostedTrees()).fit(placed, features, "fold").score(placed, fold="fold")
