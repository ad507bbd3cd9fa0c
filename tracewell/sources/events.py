"""Agent runs out of an event log: a week of a user's events is a run, an event is a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The same in SQL, as leading common table expressions: ``steps`` and ``runs``.
CTES = """
ev AS (SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS VARCHAR) AS uid FROM events),
st AS (SELECT uid, user_id, row_number() OVER (PARTITION BY uid ORDER BY ts, event_id) - 1 AS step_idx, event_type, value, props FROM ev),
rn AS (SELECT uid, max(user_id) AS user_id, CAST(count(*) AS INTEGER) AS len, CAST(min(CASE WHEN event_type = 'error' AND value > 25 THEN step_idx END) AS INTEGER) AS tau FROM st GROUP BY uid),
runs AS (SELECT uid, len, tau, CASE tau % 3 WHEN 0 THEN 'looping' WHEN 1 THEN 'goal_drift' WHEN 2 THEN 'context_corruption' END AS failure_class,
    CASE user_id % 3 WHEN 0 THEN 'qwen' WHEN 1 THEN 'llama' ELSE 'gemini' END AS family,
    CASE user_id % 3 WHEN 0 THEN 'qwen' WHEN 1 THEN 'llama' ELSE 'gemini' END || '_' || CAST(user_id % 4 AS VARCHAR) AS corpus,
    'g' || CAST(CAST(floor(user_id / 2) AS BIGINT) AS VARCHAR) AS task_group, user_id FROM rn),
steps AS (SELECT uid, step_idx, CASE WHEN event_type <> 'signup' THEN event_type END AS tool_name, CASE WHEN event_type <> 'signup' THEN props END AS args,
    event_type = 'error' AS tool_error, CASE WHEN event_type = 'error' THEN ' Error: ' || props WHEN event_type <> 'signup' THEN event_type || ' ' || props END AS result,
    value AS latency_s, CAST(floor(value) AS DOUBLE) AS output_tokens, props AS text FROM st)
"""


def event_steps(events: DataFrame) -> DataFrame:
    """uid, step_idx, tool_name, args, tool_error, result, result_chars, latency_s, output_tokens, text, token_logprobs, tool_latency_s."""
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    uid = F.concat_ws("-", F.col("user_id").cast("string"), week.cast("string"))
    order = Window.partitionBy("uid").orderBy("ts", "event_id")
    call = F.col("event_type") != "signup"
    failed = F.col("event_type") == "error"
    result = F.when(failed, F.concat(F.lit(" Error: "), "props")).when(call, F.concat_ws(" ", "event_type", "props"))
    return events.withColumn("uid", uid).select(
        "uid",
        "user_id",
        (F.row_number().over(order) - 1).alias("step_idx"),
        F.when(call, F.col("event_type")).alias("tool_name"),
        F.when(call, F.col("props")).alias("args"),
        failed.alias("tool_error"),
        result.alias("result"),
        F.length(result).alias("result_chars"),
        F.col("value").alias("latency_s"),
        F.floor("value").cast("double").alias("output_tokens"),
        F.col("props").alias("text"),
        F.lit(None).cast("array<double>").alias("token_logprobs"),
        F.when(call, F.col("value")).alias("tool_latency_s"),
    )


def event_runs(steps: DataFrame) -> DataFrame:
    """uid, len, tau, failure_class, family, corpus, task_group of each run."""
    onset = F.min(F.when(F.col("tool_error") & (F.col("latency_s") > 25), F.col("step_idx"))).cast("int")
    runs = steps.groupBy("uid").agg(F.max("user_id").alias("user_id"), F.count("*").cast("int").alias("len"), onset.alias("tau"))
    family = F.when(F.col("user_id") % 3 == 0, "qwen").when(F.col("user_id") % 3 == 1, "llama").otherwise("gemini")
    kind = F.when(F.col("tau") % 3 == 0, "looping").when(F.col("tau") % 3 == 1, "goal_drift").when(F.col("tau") % 3 == 2, "context_corruption")
    return runs.select("uid", "user_id", "len", "tau", kind.alias("failure_class"), family.alias("family"), F.concat_ws("_", family, (F.col("user_id") % 4).cast("string")).alias("corpus"), F.concat(F.lit("g"), F.floor(F.col("user_id") / 2).cast("string")).alias("task_group"))


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(runs, steps)."""
    steps = event_steps(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return event_runs(steps), steps
