"""Features re-expressed against healthy runs: mid-rank percentiles and z-scores.

A long table (grp, t, feature, value) is the reference. Percentiles come from running counts over
distinct values of reference and probes together, taken range by range, not from a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.metrics import running_totals


def unpivoted(prefix: DataFrame, features: list[str], keep=("uid", "t")) -> DataFrame:
    """(uid, t, feature, x), NaN as null."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("x")) for f in features))
    return prefix.select(*keep, F.explode(pairs).alias("__p")).select(*keep, "__p.feature", "__p.x")


def with_group(long: DataFrame, runs: DataFrame, by: str) -> DataFrame:
    """The run's group as ``grp``; a row of an unknown run fails the query."""
    g = runs.select("uid", F.col(by).alias("grp"), F.col("failure_class").isNull().alias("healthy"))
    joined = long.join(g, "uid", "left")
    return joined.withColumn("grp", F.when(F.col("healthy").isNotNull(), F.col("grp")).otherwise(F.raise_error(F.concat(F.lit("unknown run "), "uid"))))


def fit_reference(long: DataFrame, runs: DataFrame, by: str) -> DataFrame:
    """(grp, t, feature, value) of healthy runs; nulls stay out. by is family or corpus."""
    if by not in ("family", "corpus"):
        raise ValueError(f"a reference is per family or per corpus, not {by}")
    return with_group(long, runs, by).where("healthy and x is not null").select("grp", "t", "feature", F.col("x").alias("value"))


def reference_sizes(reference: DataFrame) -> DataFrame:
    return reference.groupBy("grp", "t", "feature").agg(F.count("*").alias("n"))


def _known(probes: DataFrame, reference: DataFrame) -> DataFrame:
    """Probes of a group and step without any healthy run fail the query."""
    pairs = reference.select("grp", "t").distinct().withColumn("__known", F.lit(True))
    joined = probes.join(pairs, ["grp", "t"], "left")
    return joined.where(F.when(F.col("__known"), F.lit(True)).otherwise(F.raise_error(F.lit("no healthy reference for a group and step")))).drop("__known")


def percentile(probes: DataFrame, reference: DataFrame, keys=("grp", "t", "feature")) -> DataFrame:
    """``probes`` with pct = (#reference < x + #reference <= x) / 2n; null for null x or no reference."""
    keys = list(keys)
    h = reference.groupBy(*keys, F.col("value").alias("x")).agg(F.count("*").alias("h"))
    p = probes.where("x is not null").groupBy(*keys, "x").agg(F.lit(0).cast("long").alias("h"))
    merged = h.unionByName(p).groupBy(*keys, "x").agg(F.sum("h").alias("h"))
    ranked = running_totals(merged, keys, "x", ["h"])
    pct = F.try_divide(2.0 * F.col("h_below") + F.col("h"), 2.0 * F.col("h_total"))
    return probes.join(ranked.select(*keys, "x", pct.alias("pct")), [*keys, "x"], "left")


def percentile_transform(probes: DataFrame, reference: DataFrame) -> DataFrame:
    return percentile(_known(probes, reference), reference)


def zscore_transform(probes: DataFrame, reference: DataFrame, std_floor: float) -> DataFrame:
    """(x - mean) / max(population standard deviation, floor)."""
    if std_floor <= 0:
        raise ValueError("the floor must be positive")
    stats = reference.groupBy("grp", "t", "feature").agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    z = (F.col("x") - F.col("__m")) / F.greatest(F.col("__s"), F.lit(float(std_floor)))
    return _known(probes, reference).join(stats, ["grp", "t", "feature"], "left").withColumn("z", z).drop("__m", "__s")


def cross_fitted_percentile(long: DataFrame, runs: DataFrame, folds: DataFrame) -> DataFrame:
    """(uid, t, feature, x, fold, pct): each run against healthy runs of the other folds only.

    ``folds`` are (uid, fold) of one family. Healthy values go to every fold but their own.
    """
    placed = long.join(folds, "uid")
    healthy = placed.join(runs.where("failure_class is null").select("uid"), "uid", "left_semi").where("x is not null")
    every = folds.select(F.collect_set("fold").alias("__folds"))
    spread = healthy.join(F.broadcast(every)).withColumn("fold", F.explode(F.array_except("__folds", F.array("fold"))))
    reference = spread.select("fold", "t", "feature", F.col("x").alias("value"))
    return percentile(placed, reference, ("fold", "t", "feature"))
