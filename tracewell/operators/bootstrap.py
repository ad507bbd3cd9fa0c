"""Bootstrap intervals: whole units are resampled, and metrics recomputed under their weights.

Rows are first counted per (set, unit, scorer, score). If those counts fit a checked bound, they are
sent to all tasks once, as arrays, and each task draws the weights of its replicates from (seed,
replicate) and computes any metric exactly, by running sums over sorted scores; metrics known by name
share a replicate's sums. Beyond the bound, the weights become
rows, and the metrics known by name are taken by running totals over value ranges, so that no task
holds all scores of a replicate. Given weights go that way in any case.

The AUROC of a replicate needs less: how often positives of one unit win against negatives of another
is a matrix that doesn't depend on the weights, and a replicate is w'Kw over its units' totals. Where
the units are few enough for that matrix, which is checked, it is made once, whatever the number of
rows and replicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import metrics
from tracewell.plans import scratch

MOST_SENT = 20_000_000
MAX_SKIPPED = 0.01

#: A metric of weighted rows with sorted scores: (positives, negatives, number of the distinct score).
#: Weights may be zero.
Metric = Callable[[np.ndarray, np.ndarray, np.ndarray], float]


def weights(n_units: int, replicate: int, seed: int) -> np.ndarray:
    """How often each unit is drawn in a replicate; the sample itself is replicate -1."""
    if replicate < 0:
        return np.ones(n_units, np.int64)
    return np.bincount(np.random.default_rng([seed, replicate]).integers(0, n_units, n_units), minlength=n_units) if n_units else np.zeros(0, np.int64)


def _sums(pos: np.ndarray, neg: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(value, pos), np.bincount(value, neg)


def _auroc(p: np.ndarray, n: np.ndarray) -> float:
    total = p.sum() * n.sum()
    return float((p * (np.cumsum(n) - n / 2)).sum() / total) if total else float("nan")


def _auprc(p: np.ndarray, n: np.ndarray) -> float:
    p, n = p[::-1], n[::-1]
    tp, fp = np.cumsum(p), np.cumsum(n)
    there = tp + fp > 0
    return float((p[there] * tp[there] / (tp + fp)[there]).sum() / tp[-1]) if len(tp) and tp[-1] else float("nan")


def _tpr_at_fpr(p: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> float:
    tp, fp = np.cumsum(p[::-1]), np.cumsum(n[::-1])
    if not len(tp) or not tp[-1] or not fp[-1]:
        return float("nan")
    return float((tp[fp / fp[-1] <= alpha] / tp[-1]).max(initial=0.0))


#: Metrics of the positives and negatives of each distinct score, from the lowest.
SUMMED = {"auroc": _auroc, "auprc": _auprc, "tpr_at_fpr": _tpr_at_fpr}


def weighted_auroc(pos: np.ndarray, neg: np.ndarray, value: np.ndarray) -> float:
    """NaN for one class."""
    return _auroc(*_sums(pos, neg, value))


def weighted_auprc(pos: np.ndarray, neg: np.ndarray, value: np.ndarray) -> float:
    """Precision at each threshold, weighted by the recall it adds; NaN without positives."""
    return _auprc(*_sums(pos, neg, value))


def weighted_tpr_at_fpr(pos: np.ndarray, neg: np.ndarray, value: np.ndarray, alpha: float = 0.05) -> float:
    """The highest true positive rate at a false positive rate of alpha at most; NaN for one class."""
    return _tpr_at_fpr(*_sums(pos, neg, value), alpha)


#: Metrics by name: of arrays, and of running counts.
METRICS: dict[str, tuple[Metric, Callable[[DataFrame, list[str]], DataFrame]]] = {
    "auroc": (weighted_auroc, metrics.auroc_of),
    "auprc": (weighted_auprc, metrics.auprc_of),
    "tpr_at_fpr": (weighted_tpr_at_fpr, metrics.tpr_at_fpr_of),
}


def unit_counts(evals: DataFrame, unit: str, sets: str, scorers) -> DataFrame:
    """(set, unit, scorer, s, pos, neg) of rows with y and a column per scorer."""
    long = evals.select(F.col(sets).cast("string").alias("set"), F.col(unit).cast("string").alias("unit"), "y", F.explode(F.array(*(F.struct(F.lit(s).alias("scorer"), F.col(s).cast("double").alias("s")) for s in scorers))).alias("x"))
    return long.groupBy("set", "unit", "x.scorer", "x.s").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))


def weighted_metric(counts: DataFrame, drawn: DataFrame, metric: str = "auroc") -> DataFrame:
    """(rep, set, scorer, value) of ``unit_counts`` under the weights ``drawn (rep, unit, w)``."""
    by = ["rep", "set", "scorer"]
    spread = counts.join(drawn, "unit").where("w > 0").groupBy(*by, "s").agg(F.sum(F.col("pos") * F.col("w")).alias("pos"), F.sum(F.col("neg") * F.col("w")).alias("neg"))
    # Ranges are those of the unweighted counts, so that no replicate is made for its bounds alone.
    running = metrics.running_totals(spread, by, "s", ["pos", "neg"], like=(counts, ["set", "scorer"])).withColumnsRenamed({"pos_total": "n_pos", "neg_total": "n_neg"})
    return METRICS[metric][1](running, by).select(*by, F.col(metric).alias("value"))


#: Units of a win matrix, bytes of all matrices, and ranges of scores that they are made by, at most.
MOST_UNITS, MOST_BYTES, RANGES = 1024, 128 << 20, 64


#: Rows, and arrays of wins, that are handled together.
SLICE, EMITTED = 1024, 64


def _wins_within(n_units: int, parts: bool = False):
    """Sorted batches of (set, scorer, part, s, i, pos, neg): wins among the rows of each part, a row per unit with positives; with ``parts``, the part's name, too."""

    def emit(key: tuple, wins: np.ndarray) -> Iterator[pd.DataFrame]:
        rows = np.flatnonzero(wins.any(1))
        for a in range(0, len(rows), EMITTED):
            at = rows[a : a + EMITTED]
            yield pd.DataFrame({"set": key[0], "scorer": key[1], **({"part": key[2]} if parts else {}), "i": at, "wins": [wins[k] for k in at]})

    def add(wins: np.ndarray, run: np.ndarray, rows: pd.DataFrame) -> None:
        v = np.unique(rows["s"].to_numpy(), return_inverse=True)[1]
        i, pos, neg = rows["i"].to_numpy(), rows["pos"].to_numpy(), rows["neg"].to_numpy()
        same = np.zeros((v.max() + 1, n_units))
        np.add.at(same, (v, i), neg)
        below = run + np.cumsum(same, axis=0) - same / 2
        for u in np.unique(i[pos > 0]):
            own = (i == u) & (pos > 0)
            wins[u] += pos[own] @ below[v[own]]
        run += same.sum(0)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, wins, run, held = None, None, None, None
        for f in (f.iloc[a : a + SLICE] for f in frames for a in range(0, len(f), SLICE)):
            for now, g in f.groupby(["set", "scorer", "part"], sort=False):
                if now != key:
                    if key is not None:
                        add(wins, run, held)
                        yield from emit(key, wins)
                    key, wins, run, held = now, np.zeros((n_units, n_units)), np.zeros(n_units), g.iloc[:0]
                g = pd.concat([held, g]) if len(held) else g
                # Equal scores may go on in the next frame.
                last = g["s"].to_numpy() == g["s"].iloc[-1]
                if not last.all():
                    add(wins, run, g[~last])
                held = g[last]
        if key is not None:
            add(wins, run, held)
            yield from emit(key, wins)

    return scan


def _wins_between(n_units: int):
    """Sorted batches of (set, scorer, part, i, pos, neg), a row per part and unit: wins of parts over those below."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = part = None
        for f in frames:
            for now, p, i, pos, neg in zip(zip(f["set"], f["scorer"]), f["part"], f["i"], f["pos"], f["neg"]):
                if now != key:
                    if key is not None:
                        yield pd.DataFrame({"set": key[0], "scorer": key[1], "i": np.arange(n_units), "wins": list(wins)})
                    key, part = now, None
                    wins, run, ahead = np.zeros((n_units, n_units)), np.zeros(n_units), np.zeros(n_units)
                if p != part:
                    run, ahead, part = run + ahead, np.zeros(n_units), p
                ahead[i] += neg
                if pos:
                    wins[i] += pos * run
        if key is not None:
            yield pd.DataFrame({"set": key[0], "scorer": key[1], "i": np.arange(n_units), "wins": list(wins)})

    return scan


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, total = None, 0
    for f in frames:
        for s, scorer, i, wins in zip(f["set"], f["scorer"], f["i"], f["wins"]):
            if (s, scorer, i) != key:
                if key is not None:
                    yield pd.DataFrame({"set": [key[0]], "scorer": [key[1]], "i": [key[2]], "wins": [total]})
                key, total = (s, scorer, i), 0
            total = total + np.asarray(wins)
    if key is not None:
        yield pd.DataFrame({"set": [key[0]], "scorer": [key[1]], "i": [key[2]], "wins": [total]})


def win_rows(counts: DataFrame, units: list[str]) -> DataFrame:
    """(set, scorer, i, wins): per unit i, in the order of ``units``, how often its positives are above each unit's negatives, ties half."""
    spark, by = counts.sparkSession, ["set", "scorer"]
    place = spark.createDataFrame(list(enumerate(units)), "i int, unit string")  # as few as the caller has checked
    bounds = counts.groupBy(*by).agg(F.percentile_approx("s", F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), 10_000).alias("bounds"))
    part = F.size(F.filter("bounds", lambda b: b < F.col("s")))  # equal scores are in one part
    placed = counts.join(F.broadcast(place), "unit").join(F.broadcast(bounds), by).withColumn("part", part).select(*by, "part", "s", "i", "pos", "neg")
    schema, n = "set string, scorer string, i int, wins array<double>", len(units)
    within = placed.repartition(*by, "part").sortWithinPartitions(*by, "part", "s").mapInPandas(_wins_within(n), schema)
    sums = placed.groupBy(*by, "part", "i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    between = sums.repartition(*by).sortWithinPartitions(*by, "part").mapInPandas(_wins_between(n), schema)
    both = within.unionByName(between).repartition(*by, "i").sortWithinPartitions(*by, "i")
    return both.mapInPandas(_added, schema)


def win_blocks(counts: DataFrame, size: int | None = None) -> DataFrame:
    """(set, scorer, won, lost, wins), a row per pair of units with wins, by blocks of units.

    A task adds up one block of winning units against one of losing units at a time, row by row in the
    order of scores: what it holds is a matrix of a block's side, however many units there are. The
    pairs are as many as units with positives times units with negatives.
    """
    from tracewell.operators.folds import ranked

    size, by = size or MOST_UNITS, ["set", "scorer"]
    names = counts.select("unit").distinct().withColumn("__order", F.md5("unit"))
    at = F.col("nth") - 1
    place = scratch.cut(ranked(names, "__order", ["unit"]).select("unit", F.floor(at / size).cast("int").alias("block"), (at % size).cast("int").alias("i")))
    n_blocks = (place.agg(F.max("block")).first()[0] or 0) + 1
    n = min(size, place.where("block = 0").count())
    placed = counts.join(place, "unit")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    cell = lambda a, b: F.struct(a.alias("a"), b.alias("b")).alias("part")
    own, other, zero = F.col("block"), F.col("__other"), F.lit(0.0)
    spread = placed.withColumn("__other", every)
    won = spread.where("pos > 0").select(*by, cell(own, other), "s", "i", "pos", zero.alias("neg"))
    lost = spread.where("neg > 0").select(*by, cell(other, own), "s", "i", zero.alias("pos"), "neg")
    both = won.unionByName(lost).select(*by, (F.col("part.a").cast("long") * n_blocks + F.col("part.b")).alias("part"), "s", "i", "pos", "neg")
    wins = both.repartition(*by, "part").sortWithinPartitions(*by, "part", "s").mapInPandas(_wins_within(n, True), "set string, scorer string, part long, i int, wins array<double>")
    # Names come to a row of wins, not to each of its pairs.
    first = place.select("block", "i", F.col("unit").alias("won"))
    every_name = F.transform(F.array_sort(F.collect_list(F.struct("i", "unit"))), lambda x: x["unit"])
    second = place.groupBy(F.col("block").alias("__other")).agg(every_name.alias("names"))  # a block's names, no more
    rows = wins.select(*by, F.floor(F.col("part") / n_blocks).cast("int").alias("block"), "i", (F.col("part") % n_blocks).cast("int").alias("__other"), "wins")
    named = rows.join(F.broadcast(first), ["block", "i"]).join(F.broadcast(second), "__other")
    pairs = named.select(*by, "won", "names", F.posexplode("wins").alias("j", "wins")).where("wins > 0")
    return pairs.select(*by, "won", F.col("names")[F.col("j")].alias("lost"), "wins")


def _by_wins(counts: DataFrame, reps: DataFrame, units: list[str], seed: int) -> DataFrame:
    """(rep, set, scorer, value): the AUROC of each replicate from the win matrices."""
    n, number = len(units), {u: k for k, u in enumerate(units)}
    totals: dict[tuple, np.ndarray] = {}
    for r in counts.groupBy("set", "scorer", "unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():  # a row per unit
        totals.setdefault((r["set"], r["scorer"]), np.zeros((2, n)))[:, number[r["unit"]]] = r["pos"], r["neg"]
    wins = {key: np.zeros((n, n)) for key in totals}
    for r in win_rows(counts, units).toLocalIterator():
        wins[r["set"], r["scorer"]][r["i"]] = r["wins"]
    sent = counts.sparkSession.sparkContext.broadcast([(s, scorer, wins[s, scorer], *totals[s, scorer]) for s, scorer in sorted(totals)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 256):
                ids = f["id"].iloc[a : a + 256].to_numpy()
                w = np.stack([weights(n, int(rep), seed) for rep in ids]).astype(float)
                for s, scorer, k, pos, neg in sent.value:
                    pairs = (w @ pos) * (w @ neg)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        yield pd.DataFrame({"rep": ids, "set": s, "scorer": scorer, "value": np.where(pairs > 0, ((w @ k) * w).sum(1) / pairs, np.nan)})

    got = reps.mapInPandas(run, "rep int, set string, scorer string, value double")
    return got.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def replicates(evals: DataFrame, n: int, seed: int, metric: str | Metric = "auroc", unit: str = "task_group", sets: str = "t", scorers=("score",)) -> DataFrame:
    """(rep, set, scorer, value) on shared resamples of units; rep -1 is the sample itself.

    ``metric`` is a name of ``METRICS`` or a function of weighted rows; the latter needs counts that fit the bound.
    """
    return _values(unit_counts(evals, unit, sets, scorers), n, seed, [metric]).drop("metric")


def _values(counts: DataFrame, n: int, seed: int, wanted: list[str | Metric]) -> DataFrame:
    """(metric, rep, set, scorer, value) of all metrics; a function's is ``own``. A resample is summed once for all of them."""
    spark = counts.sparkSession
    reps = spark.range(-1, n, 1, max(1, min(n // 50, 400)))
    counts, parts = scratch.cut(counts), []
    if "auroc" in wanted:
        kinds = counts.select("set", "scorer").distinct().count()
        n_units = counts.select("unit").distinct().count()
        if n_units <= MOST_UNITS and 8 * n_units * n_units * kinds <= MOST_BYTES:
            units = sorted(r[0] for r in counts.select("unit").distinct().collect())
            parts.append(_by_wins(counts, reps, units, seed).withColumn("metric", F.lit("auroc")))
            wanted = [m for m in wanted if m != "auroc"]
    if wanted:
        parts.append(_by_sums(counts, n, reps, seed, wanted) if counts.count() <= MOST_SENT else _by_rows(counts, n, reps, seed, wanted))
    return reduce(DataFrame.unionByName, parts)


def _numbered(counts: DataFrame, order: str) -> DataFrame:
    """(i, unit): places from 0 in the order of a column of hexadecimal digits."""
    from tracewell.operators.folds import ranked

    none = F.raise_error(F.lit("a row without a unit"))
    names = counts.select(F.coalesce("unit", none).alias("unit")).distinct().withColumn("__order", F.expr(order))
    return ranked(names, "__order", ["unit"]).select((F.col("nth") - 1).cast("int").alias("i"), "unit")


def _by_rows(counts: DataFrame, n: int, reps: DataFrame, seed: int, wanted: list) -> DataFrame:
    """By weights as rows, where the counts don't fit the bound."""
    if any(map(callable, wanted)):
        raise ValueError(f"a metric of its own needs {MOST_SENT} counts at most; name one of {sorted(METRICS)}")
    placed = _numbered(counts, "md5(unit)")  # by ranges of their names' digests, not by one sort
    n_units = placed.count()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for rep in f["id"]:
                w = weights(n_units, int(rep), seed)
                at = np.flatnonzero(w)
                for a in range(0, len(at), 100_000):
                    part = at[a : a + 100_000]
                    yield pd.DataFrame({"rep": int(rep), "i": part, "w": w[part]})

    drawn = reps.repartition(n + 1).mapInPandas(draw, "rep int, i long, w long").join(placed, "i").select("rep", "unit", "w")
    return reduce(DataFrame.unionByName, (weighted_metric(counts, drawn, m).withColumn("metric", F.lit(m)) for m in wanted))


def _by_sums(counts: DataFrame, n: int, reps: DataFrame, seed: int, wanted: list) -> DataFrame:
    """By counts of a checked size, which all tasks get as arrays: per set and scorer, places of units and of distinct scores."""
    spark = counts.sparkSession
    kinds = sorted((r["set"], r["scorer"]) for r in counts.select("set", "scorer").distinct().collect())  # few names
    placed = _numbered(counts, "hex(unit)")
    n_units = placed.count()
    kind = spark.createDataFrame([(k, *names) for k, names in enumerate(kinds)], "k int, set string, scorer string")
    pdf = counts.join(placed, "unit").join(F.broadcast(kind), ["set", "scorer"]).select("k", "i", "s", "pos", "neg").toArrow().to_pandas()
    cells, own = [], any(map(callable, wanted))
    for k, g in pdf.groupby("k"):
        g = g.sort_values("s", kind="stable")
        i, v = g["i"].to_numpy(), np.unique(g["s"].to_numpy(), return_inverse=True)[1].astype(np.int32)
        sides = []
        for c in ("pos", "neg"):
            x = g[c].to_numpy()
            at = np.flatnonzero(x)
            sides.append((i[at], None if (x[at] == 1).all() else x[at], v[at]))
        cells.append((*kinds[k], sides, int(v[-1]) + 1, (g["pos"].to_numpy(), g["neg"].to_numpy(), i, v) if own else None))
    sent = spark.sparkContext.broadcast(cells)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rep in f["id"]:
                w = weights(n_units, int(rep), seed).astype(float)
                for s, scorer, sides, size, rows in sent.value:
                    p, m = (np.bincount(v, w[i] if x is None else w[i] * x, size) for i, x, v in sides)
                    for name in wanted:
                        value = name(rows[0] * w[rows[2]], rows[1] * w[rows[2]], rows[3]) if callable(name) else SUMMED[name](p, m)
                        out.append(("own" if callable(name) else name, int(rep), s, scorer, value))
            yield pd.DataFrame(out, columns=["metric", "rep", "set", "scorer", "value"])

    got = reps.mapInPandas(run, "metric string, rep int, set string, scorer string, value double")
    return got.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def intervals(values: DataFrame, n: int, by=("scorer",), strict: bool = True, most_skipped: float = MAX_SKIPPED) -> DataFrame:
    """Per set, and for the mean over sets: point, lo, hi, n_skipped.

    A replicate in which any set lacks the metric is left out. If too many are, the query fails, or,
    unless ``strict``, the interval is undefined: its ends are null.
    """
    by = list(by)
    n_sets = values.select("set").distinct().count()
    whole = values.groupBy("rep", *by).agg(F.count("value").alias("__n"), F.avg("value").alias("value")).where(F.col("__n") == n_sets).drop("__n")
    per_set = values.join(whole.select("rep", *by), ["rep", *by], "left_semi")
    every = per_set.select("rep", "set", *by, "value").unionByName(whole.withColumn("set", F.lit("mean")).select("rep", "set", *by, "value"))
    drawn = F.col("rep") >= 0
    q = F.percentile(F.when(drawn, F.col("value")), F.array(F.lit(0.025), F.lit(0.975)))  # of replicates
    out = every.groupBy("set", *by).agg(F.max(F.when(~drawn, F.col("value"))).alias("point"), q.alias("__q"), (F.lit(n) - F.count_if(drawn)).alias("n_skipped"))
    fine = F.col("n_skipped") <= most_skipped * n
    few = F.raise_error(F.lit("too many replicates with one class only")) if strict else F.lit(None)
    ends = [F.when(fine, F.col("__q")[k]).otherwise(few).alias(name) for k, name in enumerate(("lo", "hi"))]
    return out.select("set", *by, "point", *ends, "n_skipped")


def paired_difference(values: DataFrame, a: str, b: str) -> DataFrame:
    """Scorer b minus scorer a on the same resamples."""
    x = values.where(F.col("scorer") == a).select("rep", "set", F.col("value").alias("__a"))
    y = values.where(F.col("scorer") == b).select("rep", "set", F.col("value").alias("__b"))
    return x.join(y, ["rep", "set"]).select("rep", "set", F.lit(f"{b}-{a}").alias("scorer"), (F.col("__b") - F.col("__a")).alias("value"))


def median_difference(values: DataFrame, reference: str) -> DataFrame:
    """Per replicate: the median over the other scorers (fits, say) of their mean over sets, less the reference's."""
    mean = values.groupBy("rep", "scorer").agg(F.avg("value").alias("value"))
    base = mean.where(F.col("scorer") == reference).select("rep", F.col("value").alias("__base"))
    rest = mean.where(F.col("scorer") != reference).join(base, "rep")
    return rest.groupBy("rep").agg(F.median(F.col("value") - F.col("__base")).alias("value")).select("rep", F.lit("mean").alias("set"), F.lit(f"median-{reference}").alias("scorer"), "value")


def matched_step_ci(evals: DataFrame, n: int, seed: int, scorers=("score",), metric: str | Metric = "auroc") -> DataFrame:
    """Cluster-bootstrap intervals of a metric at each step and their mean."""
    return intervals(replicates(evals, n, seed, metric, scorers=scorers), n)


def headline(evals: DataFrame, n: int, seed: int, a: str, b: str, unit: str = "task_group", sets: str = "t", names=tuple(METRICS)) -> DataFrame:
    """(metric, set, scorer, point, lo, hi, n_skipped): two scorers and their difference, by each metric."""
    both = scratch.cut(_values(unit_counts(evals, unit, sets, (a, b)), n, seed, list(names)))  # read several times
    out = None
    for name in names:
        values = both.where(F.col("metric") == name).drop("metric")
        one = intervals(values.unionByName(paired_difference(values, a, b)), n, strict=False).withColumn("metric", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
