"""Data-audit aggregates and reconciliation of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.metrics import matched, quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), null as ``none``."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("none")).alias("value")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Count, mean, standard deviation, extremes and exact quartiles."""
    x = F.col(column).cast("double")
    out = df.groupBy(*by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(df, by, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return matched(out, q, by, "left").select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def nested_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def spread_keys(df: DataFrame, key: str, over: str) -> DataFrame:
    """(key, n) of the keys that occur with several values of ``over``."""
    return df.groupBy(key).agg(F.countDistinct(over).alias("n")).where("n > 1")


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """The share of rows with both in which they are equal."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"), F.count("*").alias("n"))


def same_partition(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two keys group rows alike: no value of one occurs with several of the other."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    wide = lambda x: pairs.groupBy(x).count().where("count > 1")
    return wide(a).select(F.lit("left").alias("side")).unionByName(wide(b).select(F.lit("right").alias("side"))).agg(F.count_if(F.col("side") == "left").alias("split_left"), F.count_if(F.col("side") == "right").alias("split_right"))


def roster(df: DataFrame, by: str, items: str) -> DataFrame:
    """Per group: the different items of an array column, and how many different rosters."""
    kinds = df.groupBy(by).agg(F.countDistinct(F.array_sort(items)).alias("n_rosters"))
    members = df.select(by, F.explode(items).alias("item")).groupBy(by).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return kinds.join(members, by, "left")


def key_sets(df: DataFrame, json: str, k: int = 5) -> DataFrame:
    """The most common sets of keys of a JSON column."""
    keys = F.concat_ws(",", F.array_sort(F.json_object_keys(json)))
    return df.groupBy(keys.alias("keys")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keys").limit(k)


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def quantile_table(df: DataFrame, column: str, by: list[str], low: float = 0.05) -> DataFrame:
    """10th, 50th and 90th percentile, and the share below ``low``."""
    x = F.col(column).cast("double")
    out = df.groupBy(*by).agg(F.avg((x < low).cast("int")).alias("share_low"), F.count("*").alias("n"))
    return matched(out, quantiles(df, by, column, {"q10": 0.1, "q50": 0.5, "q90": 0.9}), by, "left").select(*by, "q10", "q50", "q90", "share_low", "n")


def cost_table(calls: DataFrame, price_in: float, price_out: float, by: list[str]) -> DataFrame:
    """Latency percentiles, mean tokens and cost per call."""
    cost = F.col("input_tokens") * price_in + F.col("output_tokens") * price_out
    return calls.groupBy(*by).agg(F.percentile("latency_s", 0.5).alias("p50"), F.percentile("latency_s", 0.95).alias("p95"), F.avg("input_tokens").alias("input_tokens"), F.avg("output_tokens").alias("output_tokens"), F.avg(cost).alias("cost"), F.sum(cost).alias("spent"))


def channel_attribution(steps: DataFrame, channels: list[str], by: list[str]) -> DataFrame:
    """How often each channel holds the highest running maximum at a step; ``tie`` if several do."""
    from tracewell.operators.steps import so_far

    tops = steps.withColumns({f"__{c}": F.max(c).over(so_far()) for c in channels})
    best = F.greatest(*(F.col(f"__{c}") for c in channels))
    holders = F.filter(F.array(*(F.when(F.col(f"__{c}") == best, F.lit(c)) for c in channels)), lambda x: x.isNotNull())
    named = F.when(F.size(holders) > 1, F.lit("tie")).otherwise(F.get(holders, F.lit(0)))
    return tops.withColumn("holder", named).groupBy(*by, "holder").agg(F.count("*").alias("n"))


def differences(ours: DataFrame, theirs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer reconciliation: keys on one side only, and the largest absolute difference per value."""
    a = ours.select(*keys, *(F.col(v).alias(f"__a_{v}") for v in values), F.lit(True).alias("__ours"))
    b = theirs.select(*keys, *(F.col(v).alias(f"__b_{v}") for v in values), F.lit(True).alias("__theirs"))
    j = a.join(b, keys, "full_outer")
    gaps = [F.max(F.abs(F.col(f"__a_{v}") - F.col(f"__b_{v}"))).alias(f"max_diff_{v}") for v in values]
    return j.agg(F.count_if(F.col("__theirs").isNull()).alias("only_ours"), F.count_if(F.col("__ours").isNull()).alias("only_theirs"), F.count_if(F.col("__ours") & F.col("__theirs")).alias("both"), *gaps)


def filled_left(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A left join with missing values as zero."""
    return left.join(right.select(*keys, *values), keys, "left").fillna(0, values)


def shares(df: DataFrame, by: list[str], conditions: dict) -> DataFrame:
    """Per group: how many rows, and the share of them for which each condition holds; null counts as no."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in conditions.items()))


def family_summary(runs: DataFrame, by: str = "family") -> DataFrame:
    """Per family: runs, task groups, runs of unknown group, and how many share a group with another family."""
    spread = runs.groupBy("task_group").agg(F.min(by).alias("__least"), F.max(by).alias("__most"))
    marked = runs.join(spread.select("task_group", (F.col("__least") != F.col("__most")).alias("__shared")), "task_group")
    return marked.groupBy(by).agg(F.count("*").alias("n_runs"), F.countDistinct("task_group").alias("n_groups"), F.count_if(F.col("task_group").startswith("unknown:")).alias("n_unknown"), F.count_if("__shared").alias("n_shared"))


def onset_audit(runs: DataFrame, early: int = 2) -> DataFrame:
    """Per failure class: runs, mean and spread of the onset and the length, and the share of onsets at ``early``."""
    return runs.groupBy(F.coalesce("failure_class", F.lit("none")).alias("failure_class")).agg(
        F.count("*").alias("n"), F.avg("tau").alias("tau_mean"), F.stddev_samp("tau").alias("tau_std"), F.avg((F.col("tau") == early).cast("int")).alias("share_early"), F.avg("len").alias("len_mean"), F.stddev_samp("len").alias("len_std")
    )


def key_sets(df: DataFrame, json: str) -> DataFrame:
    """(keys, n): which sets of top-level keys a JSON column has, and how often."""
    keys = F.array_join(F.array_sort(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))), ",")
    return df.groupBy(keys.alias("keys")).agg(F.count("*").alias("n"))


def truthy_keys(df: DataFrame, json: str, names: list[str]) -> DataFrame:
    """(key, n_there, n_true) of label-like keys of a JSON column: how often there, and how often neither null, false, 0 nor empty."""
    found = F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.get_json_object(json, f"$.{n}").alias("value")) for n in names)))
    rows = df.select(found.alias("f")).select("f.*")
    return rows.groupBy("key").agg(F.count("value").alias("n_there"), F.count_if(F.col("value").isNotNull() & ~F.col("value").isin("", "false", "0", "0.0", "null")).alias("n_true"))
