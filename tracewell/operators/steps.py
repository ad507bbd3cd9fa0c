"""Step tables and causal per-step features.

Every window is partitioned by run, or by run and more, so one shuffle by ``uid`` serves all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracewell.functions.scalars import call_key, changed_chars, hidden_result, log1p_or_null, starts_with_error, step_label
from tracewell.schema import FEATURES, TEXT_DIM

def in_run() -> WindowSpec:
    return Window.partitionBy("uid").orderBy("step_idx")


def so_far() -> WindowSpec:
    """The run's steps up to this one."""
    return in_run().rowsBetween(Window.unboundedPreceding, 0)


def last3() -> WindowSpec:
    return in_run().rowsBetween(-2, 0)


def blinded(steps: Column) -> Column:
    """Steps with each tool result, in the text and in the event, replaced by filler of its length."""

    def blind(s: Column) -> Column:
        event = only_event(s["tool_events"])
        events = F.transform(s["tool_events"], lambda e: e.withField("result", F.repeat(F.lit("x"), F.length(e["result"]))))
        return F.when(event.isNotNull(), s.withField("text", hidden_result(s["text"], event["result"])).withField("tool_events", events)).otherwise(s)

    return F.transform(steps, blind)


def blinding_counts(episodes: DataFrame) -> DataFrame:
    """Per corpus: steps whose text blinding changes, and by how many characters."""
    both = episodes.select("corpus", F.explode(F.arrays_zip(F.col("steps").alias("a"), blinded(F.col("steps")).alias("b"))).alias("s"))
    changed = both.withColumn("n", changed_chars(F.col("s.a.text"), F.col("s.b.text")))
    return changed.groupBy("corpus").agg(F.count_if(F.col("n") > 0).alias("blinded_steps"), F.sum("n").alias("changed_chars"))


def tool_calls(steps: Column) -> Column:
    """Number of tool events in all steps; missing lists are empty."""
    return F.aggregate(steps, F.lit(0), lambda n, s: n + F.coalesce(F.size(s["tool_events"]), F.lit(0)))


def drop_runs_without_tool_calls(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs with a tool call, number of dropped runs per corpus)."""
    marked = episodes.withColumn("calls", F.coalesce(tool_calls(F.col("steps")), F.lit(0)))
    dropped = marked.where("calls = 0").groupBy("corpus").agg(F.count("*").alias("dropped"))
    return marked.where("calls > 0").drop("calls"), dropped


def only_event(events: Column) -> Column:
    """A step's tool event, null without one; more than one fails the query."""
    n = F.coalesce(F.size(events), F.lit(0))
    return F.when(n <= 1, F.get(events, F.lit(0))).otherwise(F.raise_error(F.lit("more than one tool event in a step")))


def step_table(episodes: DataFrame) -> DataFrame:
    """One row per step of runs with parsed steps."""
    s = episodes.select("uid", "corpus", "family", "failure_class", "tau", "len", F.posexplode("steps").alias("step_idx", "s"))
    event = only_event(F.col("s.tool_events"))
    return s.withColumn("event", event).select(
        "uid", "corpus", "family", "failure_class", "tau", "len", "step_idx",
        step_label(F.col("failure_class"), F.col("tau"), F.col("step_idx")).alias("label"),
        F.col("s.action").alias("action"), F.col("s.text").alias("text"), F.col("s.task").alias("task"), F.col("s.error").alias("error"),
        F.col("s.latency_s").alias("latency_s"), F.col("s.output_tokens").alias("output_tokens"), F.col("s.token_logprobs").alias("token_logprobs"),
        F.coalesce(F.size("s.tool_events"), F.lit(0)).alias("n_tool_events"), F.transform("s.tool_events", lambda e: e["name"]).alias("tool_names"),
        F.col("event.name").alias("tool_name"), F.col("event.args").alias("args"), F.col("event.result").alias("result"), F.col("event.result_chars").alias("result_chars"),
        F.coalesce("event.is_error", F.lit(False)).alias("tool_error"), F.col("event.latency_s").alias("tool_latency_s"),
    )


def with_constant_latency(steps: Column, seconds: float) -> Column:
    return F.transform(steps, lambda s: s.withField("latency_s", F.lit(float(seconds))))


def step_features(steps: DataFrame) -> DataFrame:
    """The step table with all scalar features; each depends on the run's steps so far only.

    Reads uid, step_idx, tool_name, args, tool_error, result, result_chars, latency_s,
    output_tokens, text, token_logprobs and tool_latency_s.
    """
    call = F.col("tool_name").isNotNull()
    keyed = steps.withColumn("__key", call_key(F.col("tool_name"), F.col("args")))
    same = F.col("__key").eqNullSafe(F.lag("__key").over(in_run())) & (F.col("step_idx") > 0)
    last_error = F.max(F.when(F.col("is_error") == 1, F.col("step_idx"))).over(so_far())
    in_order = lambda *by: F.row_number().over(Window.partitionBy("uid", *by).orderBy("step_idx"))
    surprisal = F.transform("token_logprobs", lambda x: -x)
    n = F.size("token_logprobs")
    return (
        keyed.withColumn("is_error", (F.coalesce("tool_error", F.lit(False)) & call).cast("int"))
        .withColumn("__island", F.sum(F.when(same, 0).otherwise(1)).over(so_far()))
        .withColumn("steps_since_error", F.col("step_idx") - F.coalesce(last_error, F.lit(-1)))
        .withColumns(
            {
                "is_tool_call": call.cast("int"),
                "exact_repeat": (call & (in_order("__key") > 1)).cast("int"),
                "new_tool": (call & (in_order("tool_name") == 1)).cast("int"),
                "consecutive_identical": F.when(call, in_order("__island")).otherwise(0),
                "result_error_prefix": (call & starts_with_error(F.col("result"))).cast("int"),
                "n_arg_keys": F.when(call, F.coalesce(F.size(F.json_object_keys("args")), F.lit(0))),
                "result_chars_bucket": F.when(call, F.floor(F.log1p(F.col("result_chars").cast("double")))),
                "step_index": F.col("step_idx"),
                "log_latency": log1p_or_null(F.col("latency_s")),
                "log_output_tokens": log1p_or_null(F.col("output_tokens")),
                "synth_text_log_chars": F.when(~call, F.log1p(F.length(F.coalesce("text", F.lit(""))).cast("double"))),
                "surprisal_mean": F.when(n > 0, F.aggregate(surprisal, F.lit(0.0), lambda a, x: a + x) / n),
                "surprisal_max": F.when(n > 0, F.array_max(surprisal)),
                "tool_log_latency": F.when(call, log1p_or_null(F.col("tool_latency_s"))),
            }
        )
        .drop("__key", "__island")
    )


def hashed_runs(text: str | None, dim: int = TEXT_DIM) -> np.ndarray:
    """Counts of a text's hashed 3-character runs in ``dim`` buckets, at unit length."""
    c = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(dim)
    code = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    counts = np.bincount(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % dim, minlength=dim)
    return counts / np.sqrt((counts * counts).sum())


def text_hash(text: Column, dim: int = TEXT_DIM) -> Column:
    """``hashed_runs`` of a column. An Arrow UDF: nested array lambdas would hash anew per bucket."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_runs(t, dim))

    return run(text)


def with_text_hash(steps: DataFrame, dim: int = TEXT_DIM) -> DataFrame:
    hashed = steps.withColumn("__hash", text_hash(F.col("text"), dim))
    return hashed.withColumns({f"text_hash_{k:02d}": F.col("__hash")[k] for k in range(dim)}).drop("__hash")


def running_max(steps: DataFrame, score: str, out: str = "running_max") -> DataFrame:
    """Highest score so far; nulls are skipped, and it is null until there is one."""
    return steps.withColumn(out, F.max(score).over(so_far()))


def cusum(steps: DataFrame, excess: str, out: str = "cusum") -> DataFrame:
    """max(0, previous + excess), from its closed form over running sums."""
    total = F.sum(F.coalesce(F.col(excess), F.lit(0.0))).over(so_far())
    return steps.withColumn("__total", total).withColumn(out, F.col("__total") - F.least(F.lit(0.0), F.min("__total").over(so_far()))).drop("__total")


def masked_at_onset(steps: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Hide features at the step of the onset: as null, or carried over from the step before.

    Only continuous features can be null, as a count over a null is no count. The position is never
    hidden; steps since the last error go on as the carried error says. An onset at the first step has
    nothing before it and fails the query; one beyond the run's last step hides nothing.
    """
    if how not in ("nan", "carry"):
        raise ValueError(f"unknown way to mask: {how}")
    if how == "nan" and (counts := [c for c in columns if FEATURES.get(c, ("", "continuous"))[1] != "continuous"]):
        raise ValueError(f"only continuous features can be null, not {counts}")
    before = lambda c: F.lag(c).over(in_run())
    first = (F.col("tau") < 1) & (F.col("step_idx") == 0)
    checked = F.when(first, F.raise_error(F.lit("an onset at the first step can't be masked"))).otherwise(F.col("step_idx") == F.col("tau"))
    hidden = {c: before(c) if how == "carry" else F.lit(None) for c in columns if c not in ("step_index", "steps_since_error")}
    if how == "carry" and "steps_since_error" in columns:
        hidden["steps_since_error"] = F.when(before("is_error") == 1, F.lit(0)).otherwise(before("steps_since_error") + 1)
    marked = steps.withColumn("__at", checked)
    return marked.withColumns({c: F.when(F.col("__at"), v).otherwise(F.col(c)) for c, v in hidden.items()}).drop("__at")
