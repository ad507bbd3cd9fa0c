"""Prefix aggregates: one row per run and checkpoint, from the run's steps up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.steps import last3, masked_at_onset, so_far, step_features, with_text_hash
from tracewell.schema import AGGREGATES, FEATURES, TEXT_DIM


def prefix_features(rows: DataFrame, checkpoints, text: bool = False) -> DataFrame:
    """(uid, t, 54 columns, or 118 with the text's) at each checkpoint that a run reaches.

    All windows share one frame order, so they are computed in one pass per run; the checkpoint
    filter comes after them.
    """
    features = dict(FEATURES)
    if text:
        features |= {f"text_hash_{k:02d}": ("text", "vector") for k in range(TEXT_DIM)}
    made = {}
    for name, (group, kind) in features.items():
        x = F.col(name)
        all_of = {
            "count": lambda x=x: F.sum(x).over(so_far()),
            "rate": lambda x=x: F.sum(x).over(so_far()) / (F.col("step_idx") + 1),
            "last3": lambda x=x: F.sum(x).over(last3()),
            "mean": lambda x=x: F.avg(x).over(so_far()),
            "max": lambda x=x: F.max(x).over(so_far()),
            "last": lambda x=x: x,
            "last3_mean": lambda x=x: F.avg(x).over(last3()),
        }
        for a in AGGREGATES[kind]:
            made[f"{group}__{name}__{a}"] = all_of[a]().cast("double")
    made["tl__distinct_tools_per_call"] = F.try_divide(F.sum("new_tool").over(so_far()), F.sum("is_tool_call").over(so_far())).cast("double")
    wide = rows.select("uid", F.col("step_idx").alias("t"), *(v.alias(k) for k, v in made.items()))
    return wide.where(F.col("t").isin(*checkpoints))


def prefix_table(steps: DataFrame, checkpoints, text: bool = False) -> DataFrame:
    """Prefix features straight from steps. All frames look back only, so later steps are left out first."""
    early = steps.where(F.col("step_idx") <= max(checkpoints))
    return prefix_features(with_text_hash(step_features(early)) if text else step_features(early), checkpoints, text)


def masked_prefix_features(rows: DataFrame, columns: list[str], how: str, checkpoints) -> DataFrame:
    """Prefix features with some step features hidden at the onset, and at no later step; ``rows`` have ``tau``."""
    return prefix_features(masked_at_onset(rows, columns, how), checkpoints)
