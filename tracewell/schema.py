"""Schemas and fixed values of the agent-run data model."""

from __future__ import annotations

from pyspark.sql import types as T

TOOL_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("args", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("result_chars", T.IntegerType()),
        T.StructField("result_truncated", T.BooleanType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("latency_s", T.DoubleType()),
    ]
)
STEP = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("token_logprobs", T.ArrayType(T.DoubleType())),
        T.StructField("logprobs_available", T.BooleanType()),
        T.StructField("action", T.StringType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("output_tokens", T.DoubleType()),
        T.StructField("error", T.BooleanType()),
        T.StructField("task", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("tool_events", T.ArrayType(TOOL_EVENT)),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("provenance", T.StructType([T.StructField(n, T.StringType()) for n in ("task_sha256", "task_name", "requested_class")] + [T.StructField("tools", T.ArrayType(T.StringType())), T.StructField("requested_tau", T.IntegerType())])),
        T.StructField("trace_sha256", T.StringType()),
        T.StructField("accepted_because", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("expected_total", T.DoubleType()),
    ]
)
EPISODE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("uid", "episode_id", "corpus", "model", "failure_class")]
    + [T.StructField("tau", T.DoubleType()), T.StructField("T", T.IntegerType()), T.StructField("has_logprobs", T.BooleanType()), T.StructField("n_steps", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("steps", "metadata")]
)

# Model name prefixes and their family; classes by group; checkpoints.
FAMILIES = {"qwen2.5": "qwen", "llama3.1": "llama", "gemini-2.5": "gemini"}
EVAL_ONLY = ("gemini",)
HEADLINE_CLASSES = ("looping", "goal_drift", "context_corruption")
ERROR_CLASSES = ("tool_cascade", "rate_limit", "timeout")
API_CLASSES = ("malformed_json", "wrong_document")
TRAIN_CHECKPOINTS = (2, 3, 4, 5, 6, 7, 8)
SCORE_CHECKPOINTS = (2, 3, 4)
PRIMARY_CHECKPOINTS = (3, 4)

# Step features, by group and kind.
TEXT_DIM = 32
FEATURES = {
    "is_tool_call": ("tl", "binary"),
    "exact_repeat": ("tl", "binary"),
    "new_tool": ("tl", "binary"),
    "is_error": ("tl", "binary"),
    "result_error_prefix": ("tl", "binary"),
    "consecutive_identical": ("tl", "continuous"),
    "n_arg_keys": ("tl", "continuous"),
    "result_chars_bucket": ("tl", "continuous"),
    "steps_since_error": ("tl", "state"),
    "step_index": ("tl", "state"),
    "log_latency": ("ms", "continuous"),
    "log_output_tokens": ("ms", "continuous"),
    "synth_text_log_chars": ("ms", "continuous"),
    "surprisal_mean": ("ms", "continuous"),
    "surprisal_max": ("ms", "continuous"),
    "tool_log_latency": ("env", "continuous"),
}
AGGREGATES = {"binary": ("count", "rate", "last3"), "continuous": ("mean", "max", "last", "last3_mean"), "state": ("last",), "vector": ("mean", "last")}


def prefix_columns(group: str | None = None, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[str]:
    """Names of the prefix features, of one group (tl, ms, env, text) or of all: 118.

    ``without`` and ``only`` name step features, or parts of their names.
    """
    text = {f"text_hash_{k:02d}": ("text", "vector") for k in range(TEXT_DIM)}
    named = {n: f for n, f in (FEATURES | text).items() if group in (None, f[0]) and not any(w in n for w in without) and (not only or any(o in n for o in only))}
    out = [f"{g}__{name}__{a}" for name, (g, kind) in named.items() for a in AGGREGATES[kind]]
    return out + ["tl__distinct_tools_per_call"] * (group in (None, "tl") and not only)


def ablations(group: str = "ms", part: str = "surprisal") -> dict[str, list[str]]:
    """A group's columns: all, without a part, and the part alone."""
    return {"all": prefix_columns(group), f"without_{part}": prefix_columns(group, (part,)), f"only_{part}": prefix_columns(group, only=(part,))}


def without_channel(channels: dict[str, list[str]], name: str) -> dict[str, list[str]]:
    """A monitor's channels without one of them."""
    if name not in channels:
        raise ValueError(f"no channel {name}")
    return {k: v for k, v in channels.items() if k != name}
