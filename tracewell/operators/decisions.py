"""Gates, verdicts and readings of result rows, and picks among draws and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _passes(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "PASS").otherwise("FAIL")


def gap_gate(rows: DataFrame, min_gap: float) -> DataFrame:
    """``rows`` with a_point, a_hi, b_point, b_lo and diff_lo: the gap, and whether either rule passes.

    The outcome is that of the paired rule: the gap is wide enough, and the paired interval above 0.
    """
    gap = F.col("b_point") - F.col("a_point")
    paired, apart = (gap >= min_gap) & (F.col("diff_lo") > 0), (gap >= min_gap) & (F.col("b_lo") > F.col("a_hi"))
    return rows.select("*", gap.alias("gap"), _passes(apart).alias("apart"), _passes(paired).alias("outcome"))


def lower_bound_gate(rows: DataFrame, above: float) -> DataFrame:
    """Passes where the interval's lower end is above the bound."""
    return rows.withColumn("outcome", _passes(F.col("lo") > above))


def drop_verdict(rows: DataFrame, max_drop: float) -> DataFrame:
    """``rows`` with reference and value: holds if the drop is small enough."""
    drop = F.col("reference") - F.col("value")
    return rows.withColumns({"drop": drop, "outcome": F.when(drop <= max_drop, "HOLDS").otherwise("FAILS")})


def seed_sweep(rows: DataFrame, threshold: float, overturned_at: float, holds_min: int) -> DataFrame:
    """One row of ``rows (gap, hi)`` per seed: whether a claim of no gap holds over the seeds."""
    s = rows.agg(F.percentile("gap", 0.5).alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.count_if(F.col("hi") < threshold).alias("n_below"), F.count_if(F.col("gap") >= threshold).alias("n_at_least"), F.count("*").alias("n_seeds"))
    outcome = F.when(F.col("median_gap") >= overturned_at, "CLAIM OVERTURNED").when(F.col("n_below") >= holds_min, "CLAIM HOLDS").otherwise("SEED-SENSITIVE")
    return s.withColumn("outcome", outcome)


def excess_reading(rows: DataFrame, falls_share: float, no_fall: float) -> DataFrame:
    """``rows`` with r, excess, lo and hi: whether an excess of false alarms falls."""
    known = F.col("r").isNotNull() & F.col("excess").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull()
    falls = (F.col("r") >= falls_share * F.col("excess")) & ~((F.col("lo") <= 0) & (F.col("hi") >= 0))
    return rows.withColumn("reading", F.when(~known, "UNDEFINED").when(falls, "FALLS").when(F.col("r") > no_fall, "PARTIAL").otherwise("DOES NOT FALL"))


def fold_reading(folds: DataFrame, high: float, band: tuple[float, float], by: list[str]) -> DataFrame:
    """``folds`` with fa (null if not rated) and pooled: high, nominal, or folds that offset each other."""
    inside = F.col("fa").between(*band)
    s = folds.groupBy(*by).agg(F.count("fa").alias("n_rated"), F.count_if(~inside).alias("n_outside"), F.first("pooled").alias("pooled"))
    return s.withColumn("reading", F.when(F.col("n_rated") == 0, "UNRATED").when(F.col("pooled") > high, "HIGH").when(F.col("n_outside") == 0, "NOMINAL").otherwise("OFFSETTING"))


def upper_median(rows: DataFrame, value: str, by: list[str], tie: str) -> DataFrame:
    """The row at place floor(n / 2) of each group in the order of a value."""
    w = Window.partitionBy(*by)
    return rows.withColumns({"__k": F.row_number().over(w.orderBy(value, tie)), "__n": F.count("*").over(w)}).where(F.col("__k") == F.floor(F.col("__n") / 2) + 1).drop("__k", "__n")


def top_features(aurocs: DataFrame, k: int) -> DataFrame:
    """The k features whose AUROC is furthest from one half."""
    return aurocs.orderBy(F.desc(F.abs(F.col("auroc") - 0.5)), "feature").limit(k)


def dominant_group(evals: DataFrame, group: str = "task_group") -> DataFrame:
    return evals.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(1)


def expectations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, holds) for conditions over a single row of results."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in checks.items()))
    return rows.select(F.explode(pairs).alias("c")).select("c.*")
