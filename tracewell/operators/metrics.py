"""Rank and calibration metrics, per group of rows.

Scores are first counted per distinct value, and running counts over them are taken in two steps:
inside value ranges whose bounds come from an approximate quantile sketch, and over the ranges'
totals. So no task sorts all scores of a group, however few groups there are, and the results are
exact, since the bounds only say how the work is dealt.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans import scratch

#: Value ranges that a group's distinct scores are dealt to at least, and at most: as many as shuffle partitions in between.
RANGES, MOST_RANGES = 64, 512
#: Groups whose bounds, 4 KB each, are sent to all tasks, at most.
MOST_BOUNDS = 2_000


def matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with the columns of b for equal keys, null equal to null; without keys, b is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    other = b.select(*(F.col(k).alias(f"__key_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys))
    return a.join(other, on, how).drop(*(f"__key_{k}" for k in keys))


def running_totals(counts: DataFrame, by: list[str], x: str, sums: list[str], ranges: int | None = None, like: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """``counts`` (one row per group and distinct x) with ``<c>_below``, the sum of c over smaller x, and
    ``<c>_total`` of the group, for each c of ``sums``.

    Ranges are cut by the groups' own values, or by those of ``like``, rows and the keys of theirs that ``by`` holds.
    """
    ranges = ranges or min(MOST_RANGES, max(RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = [k / ranges for k in range(1, ranges)]
    source, keys = like or (counts, by)
    # The sketch depends on the order in which tasks end: made twice, rows and totals would be of different ranges.
    bounds = scratch.cut(source.groupBy(*keys).agg(F.percentile_approx(x, cuts, 1000).alias("__bounds")))
    dealt = matched(counts, F.broadcast(bounds) if bounds.count() <= MOST_BOUNDS else bounds, keys)
    dealt = dealt.withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(x)))).drop("__bounds")
    own = Window.partitionBy(*by, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = dealt.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    bases = totals.select(*by, "__range", *(zero(F.sum(f"__{c}").over(before)).alias(f"__{c}_base") for c in sums), *(F.sum(f"__{c}").over(Window.partitionBy(*by)).alias(f"{c}_total") for c in sums))
    inside = matched(dealt.withColumns({f"__{c}_in": zero(F.sum(c).over(own)) for c in sums}), bases, [*by, "__range"])
    return inside.select(*counts.columns, *((F.col(f"__{c}_in") + F.col(f"__{c}_base")).alias(f"{c}_below") for c in sums), *(f"{c}_total" for c in sums))


def running_counts(df: DataFrame, by: list[str], score: str = "score", label: str = "y", ranges: int | None = None) -> DataFrame:
    """Per distinct score: pos, neg, pos_below, neg_below, and the group's n_pos, n_neg."""
    counts = df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    return running_totals(counts, by, "s", ["pos", "neg"], ranges).withColumnsRenamed({"pos_total": "n_pos", "neg_total": "n_neg"})


def auroc_of(counts: DataFrame, by: list[str]) -> DataFrame:
    """The share of (positive, negative) pairs in the right order, ties half; null for one class."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return counts.groupBy(*by).agg(F.try_divide(wins, F.first("n_pos").cast("double") * F.first("n_neg")).alias("auroc"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))


def auroc(df: DataFrame, by: list[str], score: str = "score", label: str = "y") -> DataFrame:
    return auroc_of(running_counts(df, by, score, label), by)


def curve(df: DataFrame, by: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Per threshold (a distinct score): tp, fp of the rows at or above it, and tpr, fpr, precision."""
    c = running_counts(df, by, score, label)
    tp, fp = F.col("n_pos") - F.col("pos_below"), F.col("n_neg") - F.col("neg_below")
    return c.select(*by, "s", "pos", tp.alias("tp"), fp.alias("fp"), F.try_divide(tp, F.col("n_pos")).alias("tpr"), F.try_divide(fp, F.col("n_neg")).alias("fpr"), (tp / (tp + fp)).alias("precision"), "n_pos", "n_neg")


def auprc_of(counts: DataFrame, by: list[str]) -> DataFrame:
    """Of running counts: precision at each threshold, weighted by the recall it adds; null without positives."""
    tp, fp = F.col("n_pos") - F.col("pos_below"), F.col("n_neg") - F.col("neg_below")
    return counts.groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), F.col("n_pos")) * F.try_divide(tp, tp + fp)).alias("auprc"))


def tpr_at_fpr_of(counts: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Of running counts: the highest true positive rate at a false positive rate of alpha at most; null for one class."""
    tpr, fpr = F.try_divide(F.col("n_pos") - F.col("pos_below"), F.col("n_pos")), F.try_divide(F.col("n_neg") - F.col("neg_below"), F.col("n_neg"))
    best = F.coalesce(F.max(F.when(fpr <= F.lit(float(alpha)), tpr)), F.lit(0.0))
    return counts.groupBy(*by).agg(F.when((F.first("n_pos") > 0) & (F.first("n_neg") > 0), best).alias("tpr_at_fpr"))


def auprc(df: DataFrame, by: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Precision at each threshold, weighted by the recall it adds."""
    c = curve(df, by, score, label)
    return c.groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), F.col("n_pos")) * F.col("precision")).alias("auprc"))


def tpr_at_fpr(df: DataFrame, by: list[str], alpha: float, score: str = "score", label: str = "y") -> DataFrame:
    """The highest true positive rate at a false positive rate of alpha at most; no interpolation."""
    c = curve(df, by, score, label)
    return c.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("fpr") <= F.lit(float(alpha)), F.col("tpr"))), F.lit(0.0)).alias("tpr_at_fpr"))


def ece(df: DataFrame, by: list[str], n_bins: int = 10, score: str = "score", label: str = "y") -> DataFrame:
    """Expected calibration error over equal bins; 1 is in the last. Scores outside [0, 1] fail."""
    p = F.when(F.col(score).between(0, 1), F.col(score)).otherwise(F.raise_error(F.lit("not a probability")))
    binned = df.withColumn("__p", p).withColumn("__bin", F.least(F.floor(F.col("__p") * n_bins), F.lit(n_bins - 1)))
    bins = binned.groupBy(*by, "__bin").agg(F.sum(label).alias("sy"), F.sum("__p").alias("sp"), F.count("*").alias("n"))
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece"))


def mean_over_checkpoints(per_t: DataFrame, value: str, checkpoints, by=()) -> DataFrame:
    """The unweighted mean over the checkpoints; null unless each has a value."""
    return per_t.where(F.col("t").isin(*checkpoints)).groupBy(*by).agg(F.when(F.count(value) == len(checkpoints), F.avg(value)).alias(f"mean_{value}"))


def univariate_auroc(wide: DataFrame, features: list[str], by: list[str], label: str = "y") -> DataFrame:
    """AUROC of each feature on its own, nulls ranked lowest."""
    long = wide.select(*by, label, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("__f")).select(*by, label, "__f.feature", "__f.x")
    least = long.groupBy("feature").agg((F.min("x") - 1).alias("__least"))
    filled = long.join(F.broadcast(least), "feature").withColumn("score", F.coalesce("x", "__least", F.lit(-1.0)))
    return auroc(filled, ["feature", *by], "score", label)


def quantiles(df: DataFrame, by: list[str], x: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linear quantiles per group, a column each, from running counts; nulls are left out.

    No task holds all values of a group.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    ranked = running_totals(counts, by, "__x", ["__n"])
    here = lambda rank: (F.col("__n_below") <= rank) & (rank < F.col("__n_below") + F.col("__n"))
    parts = {}
    for name, p in probabilities.items():
        at = (F.col("__n_total") - 1) * F.lit(float(p))
        parts[name] = F.max(F.when(here(F.floor(at)), F.col("__x"))), F.max(F.when(here(F.ceil(at)), F.col("__x"))), F.first(at - F.floor(at))
    out = ranked.groupBy(*by).agg(*(c.alias(f"__{k}_{name}") for name, three in parts.items() for k, c in enumerate(three)))
    between = {n: F.col(f"__0_{n}") + (F.col(f"__1_{n}") - F.col(f"__0_{n}")) * F.col(f"__2_{n}") for n in probabilities}
    return out.select(*by, *(c.alias(n) for n, c in between.items()))


def spearman(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Correlation of mid-ranks, from counts of distinct pairs; rows with a null are left out."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, x.alias("__a"), y.alias("__b")).agg(F.count("*").alias("__w"))

    def ranked(side: str) -> DataFrame:
        counts = cells.groupBy(*by, side).agg(F.sum("__w").alias("__n"))
        return running_totals(counts, by, side, ["__n"]).select(*by, side, (F.col("__n_below") + (F.col("__n") + 1) / 2.0).alias(f"__r{side}"))

    j = matched(matched(cells, ranked("__a"), [*by, "__a"]), ranked("__b"), [*by, "__b"])
    w, u, v = F.col("__w").cast("double"), F.col("__r__a"), F.col("__r__b")
    sums = j.groupBy(*by).agg(*(F.sum(c).alias(n) for n, c in {"__n": w, "__u": w * u, "__v": w * v, "__uu": w * u * u, "__vv": w * v * v, "__uv": w * u * v}.items()))
    cov = F.col("__uv") - F.col("__u") * F.col("__v") / F.col("__n")
    spread = F.sqrt((F.col("__uu") - F.col("__u") * F.col("__u") / F.col("__n")) * (F.col("__vv") - F.col("__v") * F.col("__v") / F.col("__n")))
    return sums.select(*by, F.try_divide(cov, spread).alias("spearman"))


def per_fold_mean(per_fold: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The mean over folds that have a value."""
    return per_fold.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"), F.count(value).alias("n_folds"))
